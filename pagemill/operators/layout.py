"""Columns and sections of a page (inventory L1, L2, L3, L4, L5, L8, L9).

Blocks are taken in reading order (block_idx) throughout. Sections and column breaks are running
counts in windows over one page; only the cost-minimal column split is a Python function, applied to
one page at a time as an array column, so that no page's blocks are shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cost weights, thresholds, order of the one-hot categories and the labels they stand for.
COVERAGE, ALIGNMENT, COLUMN_PENALTY = 0.95, 0.05, 0.65
MAX_X_OVERLAP, MIN_Y_OVERLAP = 0.1, 0.6
CATEGORIES = ("text", "other", "caption", "equation", "sub-title", "table", "title", "section-title", "footnote", "figure")
LABEL_TO_CATEGORY = {
    "Text": "text", "Caption": "caption", "Formula": "equation", "Table": "table", "Title": "title", "Footnote": "footnote", "Picture": "figure",
    "Section-header": "section-title", "List-item": "other",
}
EPS = 1e-6


def split_columns(x1: np.ndarray, x2: np.ndarray, page_width: float) -> np.ndarray:
    """L1, L2: the column number of each block under the cheapest split into runs.

    The cost of a run is COVERAGE times the share of its span its blocks leave free, summed, plus
    ALIGNMENT times the harmonic mean of the variances of left edges and centres, plus a penalty per
    column. Sums and squares are prefix sums, spans are running extremes, so a row of the
    programme is vectorised and the whole takes O(n^2). Ties go to the longest last column.
    """
    n = len(x1)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    left, mid, width = x1 / page_width, (x1 + x2) * 0.5 / page_width, x2 - x1
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (left, left**2, mid, mid**2, width)]
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    cost[0] = 0.0
    for i in range(1, n + 1):
        k = i - np.arange(i)  # sizes of the runs j..i-1
        lo, hi = np.minimum.accumulate(x1[:i][::-1])[::-1], np.maximum.accumulate(x2[:i][::-1])[::-1]
        span = np.where(hi - lo > 0, hi - lo, EPS)
        sl, sl2, sm, sm2, sw = (s[i] - s[:i] for s in sums)
        a, b = np.maximum(sl2 / k - (sl / k) ** 2, 0), np.maximum(sm2 / k - (sm / k) ** 2, 0)
        run = COVERAGE * (k - sw / span) + ALIGNMENT * 2 * a * b / (a + b + EPS) + COLUMN_PENALTY
        total = np.round(cost[:i] + run, 12)
        back[i] = int(np.argmin(total))
        cost[i] = total[back[i]]
    out, i, c = np.zeros(n, dtype=np.int32), n, 0
    while i > 0:
        out[back[i] : i] = c
        i, c = back[i], c + 1
    return c - 1 - out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def columns_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x1, x2, w in batches:
        yield pd.Series([split_columns(np.asarray(a, float), np.asarray(b, float), float(p)).tolist() if a is not None and p and p > 0 else None for a, b, p in zip(x1, x2, w)])


def with_columns(pages: DataFrame) -> DataFrame:
    """page_id, block_idx, column_idx of the boxed main blocks of every page."""
    lay = F.transform("ocr_text.layouts", lambda b, i: F.struct(i.alias("block_idx"), b["category"].alias("category"), b["bbox"].alias("bbox")))
    main = F.filter(lay, lambda b: (F.size(b["bbox"]) == 4) & ~F.coalesce(b["category"].isin("Page-header", "Page-footer"), F.lit(False)))
    src = pages.select(F.col("id").alias("page_id"), F.col("ocr_text.origin_width").cast("double").alias("w"), main.alias("m")).where(F.size("m") > 0)
    cols = columns_of(F.transform("m", lambda b: b["bbox"][0]), F.transform("m", lambda b: b["bbox"][2]), F.col("w"))
    src = src.withColumn("c", cols).where("c is not null")
    z = F.arrays_zip(F.transform("m", lambda b: b["block_idx"]).alias("block_idx"), F.col("c").alias("column_idx"))
    return src.select("page_id", F.inline(z)).toDF("page_id", "block_idx", "column_idx")


def side_by_side(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """L3: two column boxes stand side by side: hardly any overlap across, much overlap in height."""
    overlap = lambda a1, a2, b1, b2: F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0))
    share = lambda o, a, b: F.when(F.least(a, b) > 0, o / F.least(a, b)).otherwise(0.0)
    x = share(overlap(ax1, ax2, bx1, bx2), ax2 - ax1, bx2 - bx1)
    y = share(overlap(ay1, ay2, by1, by2), ay2 - ay1, by2 - by1)
    return (x <= MAX_X_OVERLAP) & (y >= MIN_Y_OVERLAP)


def sections_of(columns: DataFrame, page: str = "page_id", order: str = "column_idx") -> DataFrame:
    """L3, L4: section_idx of column boxes: neighbours side by side share a section.

    Only neighbours are ever united, so sections are runs: a running count of the breaks.
    """
    w = Window.partitionBy(page).orderBy(order)
    p = {c: F.lag(c).over(w) for c in ("x1", "y1", "x2", "y2")}
    same = side_by_side(p["x1"], p["y1"], p["x2"], p["y2"], F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    brk = F.when(p["x1"].isNull() | same, 0).otherwise(1)
    return columns.withColumn("_brk", brk).withColumn("section_idx", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_brk")


def features(b: DataFrame) -> DataFrame:
    """page_id, block_idx and 18 numbers per boxed block: left, right and centre across, the same down, width, height, a one-hot category (zeros when unmapped)."""
    w, h = F.col("ow").cast("double"), F.col("oh").cast("double")
    geo = [F.col("x1") / w, F.col("x2") / w, (F.col("x1") + F.col("x2")) / 2 / w, F.col("y1") / h, F.col("y2") / h, (F.col("y1") + F.col("y2")) / 2 / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h]
    cat = F.create_map(*[F.lit(x) for kv in LABEL_TO_CATEGORY.items() for x in kv])[F.col("category")]
    hot = [F.coalesce((cat == c).cast("double"), F.lit(0.0)) for c in CATEGORIES]
    return b.where("x1 is not null and ow > 0 and oh > 0").select("page_id", "block_idx", F.array(*geo, *hot).alias("features"))


def sections_from_gaps(b: DataFrame, gap: str, page: str = "page_id", order: str = "block_idx") -> DataFrame:
    """section_idx and column_idx from the label of the gap after each block.

    'section-break' starts a section (and its first column), 'column-break' a column; the label after
    the last block of a page counts for nothing.
    """
    w = Window.partitionBy(page).orderBy(order)
    run = lambda by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.withColumn("_before", F.lag(gap).over(w))
    count = lambda label, by: F.sum(F.when(F.col("_before") == label, 1).otherwise(0)).over(run(by)).cast("int")
    out = out.withColumn("section_idx", count("section-break", [page]))
    return out.withColumn("column_idx", count("column-break", [page, "section_idx"])).drop("_before")


def gap_label(b: DataFrame, page: str = "page_id", order: str = "block_idx") -> DataFrame:
    """A rule-based gap classifier with the interface of a learned one: a jump upwards is a column break, a heading starts a section."""
    w = Window.partitionBy(page).orderBy(order)
    up = F.lead("y1").over(w) < F.col("y1")
    head = F.lead("category").over(w).isin("Section-header", "Title")
    label: Column = F.when(F.coalesce(head, F.lit(False)), "section-break").when(F.coalesce(up, F.lit(False)), "column-break").otherwise("no-break")
    return b.withColumn("gap", label)
