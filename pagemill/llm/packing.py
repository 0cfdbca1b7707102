"""Filling fixed-capacity containers with documents, as little unused as possible.

A document larger than the capacity gives full containers of its own and one rest; rests and all
other documents are items. Items count by size only, and there are at most `capacity` sizes, so a
plan is made on the driver from the histogram alone, whatever the number of documents:

1. sizes are put into BINS classes; patterns of one to three classes whose sizes fill a container
   well are enumerated; how often each pattern is used is fitted to the class counts by non-negative
   least squares, and rounded down;
2. each use is made exact: the largest sizes of its classes, and then the largest size that still
   fits, repeated as often as the counts allow;
3. what is left is packed by the same rule, largest first (best fit), which uses up every item.

A plan step says "n containers, each with these sizes", and uses up at least one size or one
pattern count, so there are at most a few steps per size.

Documents are scanned once, for ids and sizes. Assigning them is a rank within each size and a binary search in the
plan. A rank has two levels: a size is split into as many buckets as its count asks for (RANK_ROWS each), so a size that
a third of all documents share is spread over tasks of the same length as any other; ranks run inside
a bucket and are shifted by the counts of the buckets before it.

Defined results: a null or negative size is taken from the text (UTF-8 bytes and an end token); null
text without a size counts as one token; a document of size 0 takes no room but is assigned; empty tables
give an empty assignment; equal sizes are interchangeable and ranked by bucket and id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BINS = 48
#: Documents of one size that are ranked in one window at most, on average.
RANK_ROWS = 100_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that (nearly) minimises |a x - b|, by cyclic coordinate descent on the normal equations."""
    g, h = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    grad = -h.astype(float)
    diag = np.maximum(np.diag(g), 1e-12)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - grad[j] / diag[j])
            d = new - x[j]
            if d:
                x[j] = new
                grad += d * g[:, j]
                moved = max(moved, abs(d))
        if moved < 1e-3 * (1 + x.max(initial=0)):
            break
    return x


class Stock:
    """Counts by size with 'largest size <= limit' in logarithmic time."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def largest(self, limit: int, least: int = 0) -> int | None:
        i = bisect_right(self.sizes, limit) - 1
        return self.sizes[i] if i >= 0 and self.sizes[i] >= least else None

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)


def _fill(stock: Stock, room: int, sizes: list[int]) -> dict[int, int]:
    """{size: items}: `sizes` and the largest sizes that still fit, as long as any does."""
    used: dict[int, int] = {}
    for s in sizes:
        used[s] = used.get(s, 0) + 1
    limit = room
    while room >= 0:
        s = stock.largest(min(room, limit))
        if s is None:
            break
        left = stock.n[s] - used.get(s, 0)
        k = left if s == 0 else min(left, room // s)
        if k > 0:
            used[s] = used.get(s, 0) + k
            room -= s * k
        limit = s - 1
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(number of containers, {size: items of it in each})], using every item exactly once."""
    stock = Stock(counts)
    steps: list[tuple[int, dict[int, int]]] = []

    def emit(per: dict[int, int], most: int | None) -> int:
        k = min(stock.n[s] // m for s, m in per.items())
        k = k if most is None else min(k, most)
        for s, m in per.items():
            stock.take(s, k * m)
        steps.append((k, per))
        return k

    width = max(1, -(-capacity // BINS))
    cls = lambda s: min(BINS - 1, (max(s, 1) - 1) // width)
    b = np.zeros(BINS)
    for s, c in stock.n.items():
        b[cls(s)] += c
    have = [i for i in range(BINS) if b[i]]
    pats = []
    for k in (1, 2, 3):
        for p in combinations_with_replacement(have, k):
            top = sum((i + 1) * width for i in p)
            # A class stands for its largest size; up to one class a document of overshoot is made up by exact sizes.
            if capacity - width < top <= capacity + (k - 1) * width:
                pats.append(p)
    if pats:
        a = np.zeros((BINS, len(pats)))
        for j, p in enumerate(pats):
            for i in p:
                a[i, j] += 1
        for p, x in sorted(zip(pats, np.floor(nnls(a, b)).astype(int)), key=lambda t: (-max(t[0]), t[0])):
            left = int(x)
            while left > 0:
                chosen: list[int] = []
                room = capacity
                for i in sorted(p, reverse=True):
                    s = stock.largest(min(room, (i + 1) * width), i * width + 1)
                    if s is None or stock.n[s] <= chosen.count(s):
                        break
                    chosen.append(s)
                    room -= s
                if len(chosen) < len(p):
                    break
                # The last document is chosen again, exactly: the largest that fits whatever its class.
                last = chosen.pop()
                room += last
                left -= emit(_fill(stock, room, chosen), left)
    while stock.sizes:
        s = stock.sizes[-1]
        emit(_fill(stock, capacity - s, [s]), None)
    return steps


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, size: n_tokens, or UTF-8 bytes of the text and an end token where it is missing."""
    own = F.when(F.col("n_tokens") >= 0, F.col("n_tokens").cast("long"))
    return docs.select("doc_id", F.coalesce(own, F.octet_length("text").cast("long") + 1, F.lit(1).cast("long")).alias("size"))


def pieces(sized: DataFrame, capacities: list[int]) -> DataFrame:
    """capacity, doc_id, part, size: parts of documents for each capacity; only documents above it have more than one."""
    per = sized.select("doc_id", "size", F.explode(F.array(*[F.lit(c).cast("long") for c in capacities])).alias("capacity"))
    size, cap = F.col("size"), F.col("capacity")
    n_full = F.when(size > cap, F.floor(size / cap)).otherwise(F.lit(0)).cast("int")
    rest = size - n_full * cap
    last = F.when((rest > 0) | (n_full == 0), F.array(F.struct(n_full.alias("part"), rest.alias("size")))).otherwise(F.array().cast("array<struct<part:int,size:bigint>>"))
    full = F.when(n_full > 0, F.transform(F.sequence(F.lit(0), n_full - 1), lambda i: F.struct(i.alias("part"), cap.alias("size")))).otherwise(F.array().cast("array<struct<part:int,size:bigint>>"))
    return per.select("capacity", "doc_id", F.inline(F.concat(full, last)))


def assign_all(docs: DataFrame, capacities: list[int], rank_rows: int = RANK_ROWS) -> DataFrame:
    """capacity, doc_id, part, size, container: every document in containers of each capacity."""
    from pagemill.session import cut_lineage

    items = pieces(cut_lineage(sizes_of(docs)), capacities)
    # The histogram: at most `capacity` rows for each capacity, whatever the number of documents.
    counts = items.groupBy("capacity", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    by_size: dict[int, dict[int, int]] = {c: {} for c in capacities}
    for r in counts.collect():
        by_size[r["capacity"]][r["size"]] = r["n"]
    # (capacity, size) -> (first rank of each step, first container, items of the size in each container)
    table: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {}
    for c, sizes in by_size.items():
        seen: dict[int, int] = {}
        container = 0
        for k, per in plan(sizes, c):
            for s, m in per.items():
                rank = seen.get(s, 0)
                for column, v in zip(table.setdefault((c, s), ([], [], [])), (rank, container, m)):
                    column.append(v)
                seen[s] = rank + k * m
            container += k
    bc = docs.sparkSession.sparkContext.broadcast({s: tuple(np.array(x) for x in t) for s, t in table.items()})
    split = counts.select("capacity", "size", F.ceil(F.col("n") / rank_rows).alias("buckets"))
    bucket = F.pmod(F.xxhash64("doc_id", "part"), F.col("buckets")).cast("int")
    placed = items.join(split, ["capacity", "size"]).withColumn("bucket", bucket).drop("buckets")
    by = ["capacity", "size", "bucket"]
    before = Window.partitionBy("capacity", "size").orderBy("bucket")
    shift = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("shift", F.sum("n").over(before) - F.col("n")).drop("n")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "part")) - 1).join(shift, by)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = bc.value
        for b in batches:
            out = np.empty(len(b), dtype=np.int64)
            for key, rows in b.groupby(["capacity", "size"]).indices.items():
                first, cont, m = table[key]
                r = b["rank"].to_numpy()[rows]
                i = np.searchsorted(first, r, side="right") - 1
                out[rows] = cont[i] + (r - first[i]) // m[i]
            yield b[["capacity", "doc_id", "part", "size"]].assign(container=out)

    ranks = ranked.select("capacity", "doc_id", "part", "size", (F.col("rank") + F.col("shift")).alias("rank"))
    return ranks.mapInPandas(run, f"capacity long, doc_id {id_type}, part int, size long, container long")


def assign(docs: DataFrame, capacity: int, rank_rows: int = RANK_ROWS) -> DataFrame:
    """doc_id, part, size, container: every document in containers of `capacity` tokens."""
    return assign_all(docs, [capacity], rank_rows).drop("capacity")


def pack_all(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, container, doc_id, part, size for every capacity of `targets` (a few rows, read on the driver)."""
    wanted = targets.where("capacity_tokens > 0").select("target_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    capacities = sorted({r["capacity"] for r in wanted.collect()})
    if not capacities:
        return docs.sparkSession.createDataFrame([], "target_id int, container long, doc_id long, part int, size long")
    got = assign_all(docs.select("doc_id", "text", "n_tokens"), capacities)
    return got.join(wanted, "capacity").select("target_id", "container", "doc_id", "part", "size")


def pack_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: containers, tokens, share of room used, the lower bound of containers."""
    # Parts of a container are counted first, so that the distinct counts run over few rows.
    per = assigned.groupBy("target_id", "container").agg(F.sum("size").alias("size"), F.count_if(F.col("part") == 0).alias("docs"))
    t = per.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("size").alias("n_tokens"), F.sum("docs").alias("n_docs"))
    c = targets.select("target_id", "target_name", "capacity_tokens")
    room = F.col("n_containers") * F.col("capacity_tokens")
    return t.join(c, "target_id").select(
        "target_id", "target_name", "n_docs", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("n_tokens") / room, 6).alias("used")
    )


def pack_totals(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target what no packing may change: documents, parts, tokens, parts of documents above the capacity, and no container above it."""
    c = targets.select("target_id", F.col("capacity_tokens").alias("capacity"))
    load = assigned.groupBy("target_id", "container").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("parts"), F.count_if(F.col("part") == 0).alias("docs"))
    t = load.join(c, "target_id").groupBy("target_id").agg(F.sum("docs").alias("n_docs"), F.sum("parts").alias("n_parts"), F.sum("load").alias("n_tokens"), F.count_if(F.col("load") > F.col("capacity")).alias("n_overfull"))
    return t.select("target_id", "n_docs", "n_parts", "n_tokens", "n_overfull")
