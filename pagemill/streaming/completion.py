"""Keyed completion of exams from out-of-order page results (D1, D2, D3, D4, D5, D6, D7): a batch query and its streaming twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "exam_id string, n_done int, total int"


def completed(results: DataFrame, totals: DataFrame) -> DataFrame:
    """Exams whose distinct good pages reach their total; repeated results count once, late ones change nothing.

    Two aggregations (distinct pages, then a count), so that one exam's hot key is combined before the shuffle.
    """
    done = results.where("ok and page_id is not null").select("exam_id", "page_id").distinct().groupBy("exam_id").agg(F.count(F.lit(1)).cast("int").alias("n_done"))
    return done.join(totals, "exam_id").where("total > 0 and n_done >= total").select("exam_id", "n_done", F.col("total").cast("int").alias("total"))


def seeded(results: DataFrame, stored: DataFrame) -> DataFrame:
    """The results with those that are stored already put before them; `stored` has exam_id and page_id."""
    rows = results.select("exam_id", "page_id", "ok")
    return stored.select("exam_id", "page_id", F.lit(True).alias("ok")).unionByName(rows)


class Completion(StatefulProcessor):
    """Per exam: which pages are done (a map, so that one page touches one entry), how many, and whether it is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page_id string", "done boolean")
        self.tally = handle.getValueState("tally", "n int, concluded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, concluded = self.tally.get() if self.tally.exists() else (0, False)
        total = 0
        for b in rows:
            if concluded:
                continue  # late results change nothing
            total = max(total, int(b["total"].max()))
            for page in b.loc[b["ok"] & b["page_id"].notna(), "page_id"]:
                if not self.pages.containsKey((page,)):
                    self.pages.updateValue((page,), (True,))
                    n += 1
        over = not concluded and 0 < total <= n
        if over:
            self.pages.clear()  # all an exam that is over must remember is that it is over
        self.tally.update((n, concluded or over))
        if over:
            yield pd.DataFrame([(key[0], n, total)], columns=["exam_id", "n_done", "total"])

    def close(self) -> None:
        pass


def completion_stream(results: DataFrame, totals: DataFrame) -> DataFrame:
    """Each exam once, when its distinct good pages reach the total. `results` is a stream, `totals` static.

    State is kept by page in the RocksDB store, which the session must name (`with_state_store`).
    """
    joined = results.join(totals, "exam_id").select("exam_id", "page_id", "ok", F.col("total").cast("int").alias("total"))
    return joined.groupBy("exam_id").transformWithStateInPandas(Completion(), OUT, "append", "none")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that map states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def drain(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Runs a stream until its input is used up, into parquet at `path`; restarts go on from the checkpoint."""
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()


def on_change(changes: DataFrame, recompute, checkpoint: str, seconds: int | None = None):
    """Calls recompute(batch_id) whenever rows arrive; polls every `seconds`, or once over what is there."""
    w = changes.writeStream.foreachBatch(lambda df, i: None if df.isEmpty() else recompute(i)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()
