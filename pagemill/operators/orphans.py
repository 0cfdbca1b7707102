"""References to records that don't exist: direct orphans, and the cascade below them.

The tables and their foreign keys form a graph. Round 0 finds the direct orphans of every key of the graph at
once: a reference is judged by its key, so all evidence about a key (who refers to it, whether it exists and since
when, whether it was deleted) is brought together in one aggregation on (reference, key), with map-side combine: a key
that a third of all rows refer to costs one row per task. Only keys with a problem go back to the referring rows: they
are sent to the tasks when their number allows, else salted, so that a hot missing key spreads over SALT tasks.

From there the cascade goes down the graph to a fixpoint: children of records orphaned in the last round (the frontier)
are orphaned too, found by semi-joins of the same kind. It ends when a round finds nothing new. Frontiers are checkpointed in
the shared folder.

Defined results: a null reference is none; keys are compared as the tables give them (normalise first); repeated rows
count once; when a parent row comes in several versions the earliest birth counts; a null birth or landing time is
never late; of a row that comes with several times the earliest counts; empty tables give empty results; cycles end,
since a row is taken once, and direct orphans stay direct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut_lineage

SALT = 16
#: Keys that are sent to the tasks at most; each is an id or a path.
SENT_ROWS = 200_000
#: States of a direct orphan whose children are orphaned too; a late parent is there in the end.
LASTING = ("deleted", "missing")
_FOUND = "table string, row_key string, field string, state string, at timestamp, round int"


@dataclass(frozen=True)
class ForeignKey:
    """child.column refers to parent.key; `entity` names the parent's keys in the deletion log."""

    child: str
    column: str
    parent: str
    key: str
    entity: str = ""

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _salted(hot: DataFrame) -> DataFrame:
    return hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _meet(rows: DataFrame, hot: DataFrame, keys: list[str], how: str, spread: list[str]) -> DataFrame:
    """`rows` joined with `hot` (written, unique by `keys`): sent to the tasks when its counted rows allow, else salted by `spread`."""
    if hot.count() <= SENT_ROWS:
        return rows.join(F.broadcast(hot), keys, how)
    return rows.withColumn("salt", _salt(*spread)).join(_salted(hot), [*keys, "salt"], how).drop("salt")


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALT)).cast("int")


def direct_orphans(tables: dict[str, DataFrame], keys: list[ForeignKey], log: DataFrame | None = None) -> DataFrame:
    """table, row_key, field, state, at of every reference without a counterpart when its row came.

    Every table has `row_key` (what identifies a row), `at` (when it came), and the columns the keys name. `log` has
    entity and key of deleted parents. State is deleted, missing or late.
    """
    none = F.lit(None).cast("timestamp")
    ref = lambda k: tables[k.child].select(F.lit(k.name).alias("ref"), F.col(k.column).alias("key"), "row_key", "at")
    refs = _union([ref(k) for k in keys]).where("key is not null and row_key is not null")
    parts = [refs.select("ref", "key", F.col("at").alias("landed"), none.alias("born"), F.lit(0).alias("there"), F.lit(0).alias("gone"), F.lit(1).alias("refs"))]
    for k in keys:
        parts.append(tables[k.parent].select(F.lit(k.name).alias("ref"), F.col(k.key).alias("key"), none.alias("landed"), F.col("at").alias("born"), F.lit(1).alias("there"), F.lit(0).alias("gone"), F.lit(0).alias("refs")))
        if log is not None and k.entity:
            parts.append(log.where(F.col("entity") == k.entity).select(F.lit(k.name).alias("ref"), "key", none.alias("landed"), none.alias("born"), F.lit(0).alias("there"), F.lit(1).alias("gone"), F.lit(0).alias("refs")))
    evidence = _union(parts).where("key is not null").groupBy("ref", "key").agg(F.min("landed").alias("landed"), F.min("born").alias("born"), *[F.max(c).alias(c) for c in ("refs", "there", "gone")])
    bad = evidence.where("refs = 1 and (there = 0 or born > landed)").select(
        "ref", "key", "born", F.when(F.col("there") == 1, "late").when(F.col("gone") == 1, "deleted").otherwise("missing").alias("state")
    )
    hit = _meet(refs, cut_lineage(bad), ["ref", "key"], "inner", ["row_key", "at"]).where("state <> 'late' or born > at")
    place = F.split("ref", r"\.")
    return hit.groupBy("ref", "row_key").agg(F.min(F.struct(F.col("state"), F.col("at"))).alias("s")).select(
        place[0].alias("table"), "row_key", place[1].alias("field"), "s.state", "s.at"
    )


def orphan_cascade(tables: dict[str, DataFrame], keys: list[ForeignKey], log: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """table, row_key, field, kind, state, at, round of every orphan reference (direct) and of every row below an orphan (inherited).

    Rounds run until nothing new is found; a chain longer than `max_rounds` is an error, never a shorter result. A direct orphan has a
    row for each of its bad references; an inherited one a single row, with the key that led to it (the first by name) and
    the state 'inherited'.
    """
    found = cut_lineage(direct_orphans(tables, keys, log).withColumn("round", F.lit(0)))
    frontier = found.where(F.col("state").isin(*LASTING))
    for r in range(1, max_rounds + 2):
        grown = []
        # At most one name for each table.
        present = {x["table"] for x in frontier.select("table").distinct().collect()}
        for k in keys:
            if k.parent not in present:
                continue
            up = frontier.where(F.col("table") == k.parent).select("row_key").distinct()
            if k.key != "row_key":
                up = tables[k.parent].select("row_key", F.col(k.key).alias("key")).join(up, "row_key", "left_semi").drop("row_key")
            up = cut_lineage(up.toDF("key").where("key is not null").distinct())
            rows = tables[k.child].where("row_key is not null").select("row_key", "at", F.col(k.column).alias("key"))
            grown.append(_meet(rows, up, ["key"], "left_semi", ["row_key"]).select(F.lit(k.child).alias("table"), "row_key", F.lit(k.column).alias("field"), "at"))
        if not grown:
            break
        first = _union(grown).groupBy("table", "row_key").agg(F.min("field").alias("field"), F.min("at").alias("at"))
        new = first.join(found.select("table", "row_key"), ["table", "row_key"], "left_anti").select("table", "row_key", "field", F.lit("inherited").alias("state"), "at", F.lit(r).alias("round"))
        new = cut_lineage(new)
        if new.isEmpty():
            break
        if r > max_rounds:
            raise RuntimeError(f"orphans go on below round {max_rounds}")
        found, frontier = found.unionByName(new), new
    return found.select("table", "row_key", "field", F.when(F.col("round") == 0, "direct").otherwise("inherited").alias("kind"), "state", "at", "round")


def orphan_report(cascade: DataFrame) -> DataFrame:
    """Numbers of orphans per table, field, month of landing, kind (direct or inherited) and state."""
    return cascade.groupBy("table", "field", F.date_format("at", "yyyy-MM").alias("month"), "kind", "state").agg(F.count(F.lit(1)).alias("n"))
