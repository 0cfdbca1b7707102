import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import nested
from pagemill.schema import OCR

PAGES = f"id string, exam_id string, page_order smallint, file_path string, ocr_text {OCR}, landed_at timestamp, tree_id string, exam string"


def paths(payload):
    return sorted((r[8]) for r in nested.walk("1", "page_payload", payload) if r[2] == "block")


def test_walk_shapes():
    block = {"text": "a", "children": [None, {"text": "b", "children": {"text": "c"}}]}
    page = {"page_id": "p", "ocrText": json.dumps({"layouts": [None, block]})}
    for root in ({"id": " E1 ", "pages": [page]}, [{"examId": " E1 ", "pages": page}], {"data": {"exam": {"id": " E1 ", "pages": {"1": page}}}}, {"exam": {"examId": " E1 ", "pages": [page]}, "meta": {}}):
        assert paths(json.dumps(root)) == ["1", "1.1", "1.1.0"]


@pytest.mark.parametrize("bad", [None, "", "{", '{"id": "a", "pages": [', "[1, 2", "3", "null", '"x"', '{"id": 3, "pages": null}', "[]"])
def test_incomplete_or_empty(bad):
    assert paths(bad) == []


def test_deep_payload_has_no_recursion_limit():
    b = {"text": "x"}
    for _ in range(400):
        b = {"text": "x", "children": [b]}
    rows = nested.walk("1", "o", json.dumps({"id": "e", "pages": [{"id": "p", "ocr_text": {"layouts": [b]}}]}))
    assert sum(r[2] == "block" for r in rows) == 401


tree = st.recursive(st.fixed_dictionaries({"text": st.text(max_size=3)}), lambda kids: st.fixed_dictionaries({"text": st.text(max_size=3), "children": st.lists(st.one_of(st.none(), kids), max_size=3)}), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(tree, max_size=4))
def test_intervals_contain_exactly_the_ancestors(blocks):
    rows = nested.walk("1", "o", json.dumps({"id": "e", "pages": [{"id": "p", "ocr_text": {"layouts": blocks}}]}))
    by_path = {r[8]: r for r in rows if r[2] == "block"}
    for a in by_path.values():
        for d in by_path.values():
            inside = a[3] < d[3] and a[4] > d[4]
            assert inside == d[8].startswith(a[8] + ".")
    assert sorted(r[3] for r in rows) == list(range(len(rows))) and sorted(r[4] for r in rows) == list(range(len(rows)))


def test_found_blocks(spark):
    lay = lambda *x: (10, 10, 10, 10, list(x))
    b = ([1.0, 2.0, 3.0, 4.0], "Text", "t", None)
    pages = spark.createDataFrame(
        [("p1", " AB ", 1, "f", lay(b, None, b), None, "x", "y"), ("p1", " AB ", 1, "f", lay(b, None, b), None, "x", "y"), ("p2", None, 1, None, lay(b), None, "x", "y"), ("p3", "c", 1, "f", None, None, "x", "y"),
         ("p4", "c", 1, "f", (1, 1, 1, 1, None), None, "x", "y"), ("p5", "c", 1, "f", lay(), None, "x", "y")], PAGES)
    one = json.dumps({"id": "E", "pages": [{"id": "q", "ocr_text": {"layouts": {"text": "lone"}}}]})
    payloads = spark.createDataFrame([(1, one), (2, one), (3, one[:-3]), (4, None)], "payload_id long, payload string")
    got = sorted((tuple(r) for r in nested.found_blocks(pages, payloads).collect()), key=repr)
    assert got == sorted([("page_payload", "e", "q", "0"), ("pages", "ab", "p1", "0"), ("pages", "ab", "p1", "2"), ("pages", None, "p2", "0")], key=repr)
    assert nested.found_blocks(pages.limit(0), payloads.limit(0)).count() == 0


def test_content_is_read_only_where_it_is_asked_for(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    full, slim = (nested.page_tables(pages, with_content=w)["blocks"] for w in (True, False))
    keys = ["origin", "exam_id", "page_id", "block_path"]
    assert full.count() == slim.count() > 0 and full.select(*keys).exceptAll(slim.select(*keys)).isEmpty()
    assert full.where("page_id is null or exam_id is null").count() == pages.where("exam_id is null").dropDuplicates(["id"]).selectExpr("explode(ocr_text.layouts) b").where("b is not null").count()


def test_labels_of_page_trees_are_those_of_a_walk(spark, sf):
    """The closed numbers of page rows equal the walk over the same records as JSON, and links need right labels."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf}/pages.parquet").dropDuplicates(["id"])
    for r in nested.page_trees(pages, with_content=False).limit(40).collect():
        page = {"id": r.above[1].node_key}
        if len(r.above) == 3:
            page["ocr_text"] = {"layouts": [{} for _ in r.below]}
        walked = nested.walk("t", "o", json.dumps({"id": "e", "pages": [page]}))
        assert [(n.kind, n.pre, n.post, n.depth) for n in [*r.above, *r.below]] == [tuple(w[2:6]) for w in walked]
    a, d = (F.struct(F.lit(x).alias("pre"), F.lit(y).alias("post")) for x, y in ((1, 5), (3, 2)))
    assert spark.range(1).select(nested.contains(a, d), nested.contains(d, a), nested.contains(a, a)).first()[:] == (True, False, False)


def test_parents_by_intervals_equal_parents_by_paths(spark, sf):
    nodes = nested.label_payloads(spark.read.parquet(f"{sf}/page_payload.parquet")).cache()
    linked = nested.link_parents(nodes)
    assert linked.where("depth > 0 and parent_pre is null").count() == 0
    assert linked.where("depth = 0 and parent_pre is not null").count() == 0
    rows = {(r["tree_id"], r["pre"]): r for r in linked.collect()}
    for r in rows.values():
        if r["kind"] == "block" and "." in r["path"]:
            assert rows[(r["tree_id"], r["parent_pre"])]["path"] == r["path"].rpartition(".")[0]


def test_flat_tables_hold_both_origins(spark, tmp_path):
    from pagemill.plans import found

    lay = lambda *x: (10, 10, 10, 10, list(x))
    b = ([1.0, 2.0, 3.0, 4.0], "Section-header", "head", 2)
    pages = spark.createDataFrame(
        [("p1", " /AB ", 1, "f", lay(None, b, b), None, "x", "y"), ("p1", " /AB ", 1, "f", lay(None, b, b), None, "x", "y"), ("p2", "ab", 2, "f", None, None, "x", "y"), ("p3", None, 1, "f", (1, 1, 1, 1, None), None, "x", "y")], PAGES)
    one = json.dumps({"id": " E ", "title": "T", "pages": [{"id": "q", "ocr_text": {"layouts": {"text": "lone"}}}]})
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, one)], "payload_id long, payload string").write.parquet(f"{tmp_path}/page_payload.parquet")
    run = lambda name: sorted((tuple(r) for r in found.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert run("p1_exams") == [("page_payload", "e", "T"), ("pages", "ab", None), ("pages", None, None)]
    assert run("p1_pages") == [("page_payload", "e", "q", None), ("pages", "ab", "p1", 1), ("pages", "ab", "p2", 2), ("pages", None, "p3", 1)]
    assert run("p1_blocks") == [
        ("page_payload", "e", "q", "0", None, None, [], "lone"), ("pages", "ab", "p1", "1", "Section-header", 2, b[0], "head"), ("pages", "ab", "p1", "2", "Section-header", 2, b[0], "head")]
    assert run("p1_parents") == sorted([
        *[(o, e, p, "page", None, "exam", None) for o, e, p in (("page_payload", "e", "q"), ("pages", "ab", "p1"), ("pages", "ab", "p2"), ("pages", None, "p3"))],
        *[(o, e, p, "ocr", None, "page", None) for o, e, p in (("page_payload", "e", "q"), ("pages", "ab", "p1"), ("pages", None, "p3"))],
        ("page_payload", "e", "q", "block", "0", "ocr", None), ("pages", "ab", "p1", "block", "1", "ocr", None), ("pages", "ab", "p1", "block", "2", "ocr", None)], key=repr)


def test_a_record_delivered_again_comes_once_as_it_was_last(spark):
    from datetime import datetime

    doc = lambda text, title: json.dumps({"id": "E", "title": title, "pages": [{"id": "q", "order": 3, "ocr_text": {"layouts": [{"text": text, "children": [{"text": "c"}]}]}}]})
    rows = [(1, datetime(2025, 1, 9), doc("new", "B")), (2, datetime(2025, 1, 2), doc("old", "A")), (3, datetime(2025, 1, 2), doc("old", "A"))]
    t = nested.payload_tables(spark.createDataFrame(rows, "payload_id long, received_at timestamp, payload string"))
    assert [(r.exam_id, r.title) for r in t["exams"].collect()] == [("e", "B")] and [(r.page_id, r.page_order) for r in t["pages"].collect()] == [("q", 3)]
    assert sorted((r.block_path, r.text) for r in t["blocks"].collect()) == [("0", "new"), ("0.0", "c")]
    assert sorted((r.kind, r.block_path, r.parent_kind, r.parent_path) for r in t["links"].collect() if r.kind == "block") == [("block", "0", "ocr", None), ("block", "0.0", "block", "0")]
