"""Model-call control flow over pages with a pluggable backend (M1, M2, M3, M4, M6); the default replays stored responses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.markup import response_blocks

STATUSES = ("ok", "truncated", "bad_request", "parse_error", "unreachable", "http_error")
#: Connection errors and timeouts are 'unreachable', any HTTP status error but a bad request is 'http_error': both are tried again.
RETRIED = ("unreachable", "http_error")
_OUT = "page_id string, status string, attempts int, blocks array<struct<bbox:array<double>,category:string,text:string,level:int>>"


def replay(row: dict) -> tuple[str, str]:
    """(status, response) of the stored response."""
    return ("ok", row["html"]) if row.get("html") else ("bad_request", "")


def recognise(responses: DataFrame, backend: Callable[[dict], tuple[str, str]] = replay, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """One call per page inside the partition: what RETRIED names is tried again with doubled waits and ends as unreachable, all else is final."""
    cols = responses.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for values in b.itertuples(index=False, name=None):
                row = dict(zip(cols, values))
                for n in range(1, attempts + 1):
                    status, body = backend(row)
                    if status not in RETRIED or n == attempts:
                        break
                    time.sleep(wait * 2 ** (n - 1))
                status = "unreachable" if status in RETRIED else status
                blocks = []
                if status == "ok":
                    blocks = [dict(zip(("bbox", "category", "text", "level"), x)) for x in response_blocks(body, int(row["input_width"]), int(row["input_height"]))]
                out.append((row["page_id"], status, n, blocks))
            yield pd.DataFrame(out, columns=["page_id", "status", "attempts", "blocks"])

    return responses.mapInPandas(run, _OUT)


def outcomes(results: DataFrame, by: str) -> DataFrame:
    """M4: per group whether a page failed for good, and whether the run must stop."""
    return results.groupBy(by).agg(F.bool_or(F.col("status").isin("truncated", "bad_request", "parse_error")).alias("failed"), F.bool_or(F.col("status") == "unreachable").alias("stopped"))
