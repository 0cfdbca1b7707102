"""Sinks and mutations, each as a function from old tables to new ones (inventory K1, K2, K3, K4, K5, K7, K8, K10, K12, F14, F15, S17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut_lineage

CHUNK = 100


def merge_fields(rows: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """K1: rows with the non-key columns of `deltas` put in where a delta for the key exists (nulls set too)."""
    fields = [c for c in deltas.columns if c != key]
    d = deltas.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit")).dropDuplicates([key])
    out = rows.join(d, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K2: the last row per key (idempotent overwrite)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clear_where(rows: DataFrame, column: str, cond: Column) -> DataFrame:
    """K3: the column nulled where cond holds."""
    return rows.withColumn(column, F.when(~F.coalesce(cond, F.lit(False)), F.col(column)))


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, fk: str) -> tuple[DataFrame, DataFrame]:
    """K4: both tables without the deleted parents and their children (ids has the column `key`)."""
    gone = ids.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, fk), fk, "left_anti")


def positions(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """`rows` with their zero-based place in the whole table under a total order, without a window over it.

    Rows are range-partitioned, so that the rows of a hot group spread over as many partitions as they need, and sorted there; a
    place is the partition's offset and the row's number in it. The sorted rows are written once: offsets and rows see the
    same partitions.
    """
    local = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", local)
    ordered = cut_lineage(ordered.withColumns({"_pid": F.shiftrightunsigned("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m"))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # A row per partition, whatever the number of rows.
    start = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_start"))
    return ordered.join(start, "_pid").withColumn(out, F.col("_r") + F.col("_start")).drop("_pid", "_r", "_start")


def chunks(paths: DataFrame, column: str, size: int = CHUNK) -> DataFrame:
    """K5: a chunk number for each path in path order, so that at most `size` paths share one."""
    pos = positions(paths.select(column).distinct(), [F.col(column)], "_at")
    return pos.select(column, F.floor(F.col("_at") / size).alias("chunk"))


def failed_deletes(wanted: DataFrame, echoed: DataFrame, column: str) -> DataFrame:
    """K5: paths that weren't echoed back as deleted."""
    return wanted.select(column).distinct().join(echoed.select(column), column, "left_anti")


def numbered(rows: DataFrame, group: list[str], order: list[Column], out: str = "page_order") -> DataFrame:
    """1-based numbers in the given order (total within a group), also where one group holds most rows."""
    at = positions(rows, [*map(F.col, group), *order], "_at")
    same = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_g{i}") for i, g in enumerate(group)]
    null = [F.col(g).isNull().alias(f"_z{i}") for i, g in enumerate(group)]
    keys = [f"_g{i}" for i in range(len(group))] + [f"_z{i}" for i in range(len(group))]
    at = at.select("*", *same, *null)
    first = at.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return at.join(first, keys).withColumn(out, (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_first", *keys)


def reorder(rows: DataFrame, wanted: DataFrame, key: str, group: str, order: str, keep_unlisted: bool) -> DataFrame:
    """Rows renumbered in the order of `wanted` (group, key, pos).

    Unknown keys are ignored. Unlisted rows follow in their old order, or go when keep_unlisted is False.
    """
    w = wanted.groupBy(group, key).agg(F.min("pos").alias("pos"))
    joined = rows.join(w, [group, key], "left" if keep_unlisted else "inner")
    return numbered(joined.withColumnRenamed(order, "_old"), [group], [F.asc_nulls_last("pos"), F.asc_nulls_last("_old"), F.col(key)], order).select(*rows.columns)


def older_than(files: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows strictly older than `days` before now."""
    return files.where(F.col(column) < now - F.expr(f"interval {int(days)} days"))
