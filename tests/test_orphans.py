import datetime as dt

import pytest

from pagemill.operators import orphans
from pagemill.operators.orphans import ForeignKey

T0, T1, T2 = (dt.datetime(2025, 1, d) for d in (1, 2, 3))
KEYS = [ForeignKey("pages", "exam_id", "exams", "row_key", "exam"), ForeignKey("pages", "file_path", "objects", "row_key", "object"), ForeignKey("results", "exam_id", "exams", "row_key", "exam"), ForeignKey("results", "page_id", "pages", "row_key")]


def frames(spark, pages, exams, objects, log, results=()):
    parents = "row_key string, at timestamp, state string, kind string"
    clash = lambda rows: [(*r, "clash", "clash") for r in rows]
    tables = {
        "pages": spark.createDataFrame(clash(pages), "row_key string, exam_id string, file_path string, at timestamp, key string, ref string"),
        "exams": spark.createDataFrame(clash(exams), parents), "objects": spark.createDataFrame(clash(objects), parents),
        "results": spark.createDataFrame(clash(results), "row_key string, exam_id string, page_id string, at timestamp, salt string, field string"),
    }
    return tables, KEYS, spark.createDataFrame(clash(log), "entity string, key string, gone string, there string")


PLANTED = (
    [("a", "e1", "x/1.png", T1), ("a", "e1", "x/1.png", T1), ("b", "e2", "x/2.png", T1), ("c", None, None, T1), ("d", "e3", "x/3.png", T1), ("e", "e1", "x/1.png", None), (None, "e9", None, T1)],
    [("e1", T0), ("e1", T2), ("e3", T2)], [("x/1.png", T0), ("x/3.png", T2), ("x/3.png", T2)], [("exam", "e2"), ("exam", "e1"), ("object", "nobody"), ("other", "x/2.png")],
    [("r1", "e1", "a", T2), ("r2", "e1", "b", T2), ("r2", "e1", "b", T2), ("r3", "e2", "b", T2), ("r4", "e1", "zz", T2), ("r5", "e3", "d", T1), ("r6", None, None, T2), ("r7", "e1", "d", T2)],
)


@pytest.mark.parametrize("sent", [orphans.SENT_ROWS, -1])
def test_direct_and_inherited(spark, monkeypatch, sent):
    monkeypatch.setattr(orphans, "SENT_ROWS", sent)
    got = {(r.table, r.row_key, r.field, r.kind, r.state, r.round) for r in orphans.orphan_cascade(*frames(spark, *PLANTED)).collect()}
    assert got == {
        ("pages", "b", "exam_id", "direct", "deleted", 0), ("pages", "b", "file_path", "direct", "missing", 0), ("pages", "d", "exam_id", "direct", "late", 0), ("pages", "d", "file_path", "direct", "late", 0),
        ("results", "r2", "page_id", "inherited", "inherited", 1), ("results", "r3", "exam_id", "direct", "deleted", 0), ("results", "r4", "page_id", "direct", "missing", 0), ("results", "r5", "exam_id", "direct", "late", 0),
    }
    report = {tuple(r)[:5]: r.n for r in orphans.orphan_report(orphans.orphan_cascade(*frames(spark, *PLANTED))).collect()}
    assert report[("results", "page_id", "2025-01", "inherited", "inherited")] == 1 and sum(report.values()) == len(got)


def test_hot_missing_key_and_empty(spark):
    f = frames(spark, [(f"p{i}", "gone", None, T1) for i in range(500)], [("e", T0)], [("o", T0)], [("exam", "gone")], [(f"r{i}", "e", "p0", T1) for i in range(500)])
    got = {(r.table, r.kind): r[2] for r in orphans.orphan_cascade(*f).groupBy("table", "kind").count().collect()}
    assert got == {("pages", "direct"): 500, ("results", "inherited"): 500}
    tables, keys, log = f
    assert orphans.orphan_cascade({k: t.limit(0) for k, t in tables.items()}, keys, log.limit(0)).count() == 0 and orphans.direct_orphans({k: t.limit(0) for k, t in tables.items()}, keys).count() == 0


def chain(spark, n):
    """n rows, each referring to the one before it; the first refers to nothing there."""
    rows = [(f"a{i}", f"a{i - 1}", T1) for i in range(n)]
    return {"t": spark.createDataFrame(rows, "row_key string, up string, at timestamp")}, [ForeignKey("t", "up", "t", "row_key")]


def test_cascade_reaches_its_end(spark):
    got = sorted((r.round, r.row_key, r.kind) for r in orphans.orphan_cascade(*chain(spark, 6)).collect())
    assert got == [(i, f"a{i}", "direct" if i == 0 else "inherited") for i in range(6)]
    with pytest.raises(RuntimeError):
        orphans.orphan_cascade(*chain(spark, 6), max_rounds=3)
    assert orphans.orphan_cascade(*chain(spark, 4), max_rounds=3).count() == 4


def test_cascade_ends_in_a_cycle(spark):
    tables = {"a": spark.createDataFrame([("a1", "b1", T1), ("a2", "b2", T1), ("a3", "zz", T1)], "row_key string, b string, at timestamp"), "b": spark.createDataFrame([("b1", "a2", T1), ("b2", "a1", T1), ("b3", "a3", T1)], "row_key string, a string, at timestamp")}
    keys = [ForeignKey("b", "a", "a", "row_key"), ForeignKey("a", "b", "b", "row_key")]
    got = {(r["table"], r["row_key"], r["kind"], r["round"]) for r in orphans.orphan_cascade(tables, keys).collect()}
    assert got == {("a", "a3", "direct", 0), ("b", "b3", "inherited", 1)}
