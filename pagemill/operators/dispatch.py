"""Order-dependent operators: budgeted admission as a prefix rule, work dispatch, in-flight sets (Q1, Q2, Q3, Q4, Q5, Q6, Q9, Q10, Q12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admit_under_budget(requests: DataFrame, run: str, pos: str, size: str, eligible: str, budget: int, used: int = 0) -> DataFrame:
    """Adds `running` and `admitted`: requests of a run are taken in order while they fit the budget.

    The first eligible request that doesn't fit closes the run: whatever comes later is refused, even
    if it would fit. So only a prefix matters and a running sum says all. Windows are partitioned
    by run; runs are independent, and a run is one short request batch.
    """
    w = Window.partitionBy(run).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.coalesce(F.col(eligible), F.lit(False))
    out = requests.withColumn("running", F.lit(used) + F.sum(F.when(ok, F.col(size)).otherwise(0)).over(w))
    over = F.max((ok & (F.col("running") > budget)).cast("int")).over(w)
    return out.withColumn("admitted", ok & (over == 0))


def request_reasons(requests: DataFrame, run: str, pos: str, status: str, found: str, size: str, budget: int) -> DataFrame:
    """`requests` with `queued` and `reason`, the first that holds of: queue is full (after the first overflow), not found, status, capacity."""
    first = Window.partitionBy(run, "exam_id").orderBy(pos)
    again = F.row_number().over(first) > 1
    eligible = F.col(found) & (F.col(status) == "pending") & ~again
    out = requests.withColumn("_ok", F.coalesce(eligible, F.lit(False))).withColumn("_again", again)
    out = admit_under_budget(out, run, pos, size, "_ok", budget)
    before = Window.partitionBy(run).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    over = F.col("_ok") & (F.col("running") > budget)
    full = F.coalesce(F.max(over.cast("int")).over(before), F.lit(0)) == 1
    shown = F.when(F.col("_again") & (F.col(status) == "pending"), "processing").otherwise(F.col(status))
    reason = (
        F.when(full, "queue is full").when(~F.col(found), "not found").when(~F.col("_ok"), F.concat(F.lit("status is '"), shown, F.lit("', expected 'pending'")))
        .when(over, F.concat(F.lit("over capacity "), F.lit(budget).cast("string")))
    )
    return out.withColumn("reason", reason).withColumn("queued", F.col("admitted")).drop("_ok", "_again", "running", "admitted")


def page_queue(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """Q10: the pages without a result of queued exams: queue order, then page order.

    `queue` has exam_id and queue_pos. Ranks are per exam (rank_in_exam); the global order is the pair.
    """
    from pagemill.operators.mutations import numbered

    todo = pages.where("ocr_text is null").select("exam_id", "page_id", "page_order")
    ranked = numbered(queue.join(todo, "exam_id"), ["exam_id"], [F.asc_nulls_last("page_order"), F.col("page_id")], "rank_in_exam")
    return ranked.select("queue_pos", "rank_in_exam", "exam_id", "page_id")


def not_in_flight(rows: DataFrame, queued: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Q9: rows whose key is neither queued nor tracked (two anti joins)."""
    return rows.join(queued.select(key), key, "left_anti").join(tracked.select(key), key, "left_anti")


def ledger(events: DataFrame, group: str, amount: str) -> DataFrame:
    """Q4, Q5, Q12: what is charged per group, never below zero."""
    return events.groupBy(group).agg(F.greatest(F.sum(amount), F.lit(0)).alias("charged"))
