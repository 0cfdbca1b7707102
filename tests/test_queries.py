import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

#: The core's queries; those over training text have their own tests.
Q = {k: f for m in entry.CORE for k, f in m.QUERIES.items()}
S = {k: q for m in entry.CORE for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(S))
def test_equals_sql(spark, con, sf, name):
    assert compare(spark, con, sf, name, Q[name], S[name]) == ""


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_survives_without_the_text_package(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "pagemill.llm", None)
    monkeypatch.setitem(sys.modules, "pagemill.llm.queries", None)
    assert set(entry.queries()) == set(Q) and set(entry.oracle_sql()) == set(S)


def test_sizes_of_tables(spark, sf):
    import os

    got = {r["name"]: (r.bytes, r.files) for r in Q["table_bytes"](spark, sf).collect()}
    assert got == {n: (os.path.getsize(f"{sf}/{n}.parquet"), 1) for n in got} and len(got) == 6


def test_core_needs_no_llm():
    code = "import sys; sys.modules['pagemill.llm'] = None\nfrom pagemill.plans import found, relational, render\nimport pagemill.streaming.completion\nassert not [m for m in sys.modules if m.startswith('pagemill.llm.')]"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_completion_stream_equals_batch(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from pagemill.streaming.completion import completed, completion_stream, drain, with_state_store

    with_state_store(spark)

    results = spark.read.parquet(f"{sf}/page_result.parquet")
    totals = results.groupBy("exam_id").agg(F.countDistinct("page_id").alias("total"))
    folder = str(tmp_path / "in")
    results.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    drain(completion_stream(stream, totals), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in completed(results, totals).collect())
    assert got == want and want
    drain(completion_stream(stream, totals), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_recomputed_on_change(spark, sf, tmp_path):
    from pagemill.streaming.completion import on_change

    rows = spark.read.parquet(f"{sf}/exams.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        on_change(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), seen.append, str(tmp_path / "cp")).awaitTermination()
    assert seen == [0]
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    on_change(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), seen.append, str(tmp_path / "cp")).awaitTermination()
    assert seen == [0, 1]


def test_numbers_of_a_hot_group(spark):
    """Numbers run without gaps in every group, also where one holds most rows, null groups included."""
    from pyspark.sql import functions as F

    from pagemill.operators import mutations

    rows = [("hot" if i % 10 else None if i % 20 else f"g{i}", (i * 7919) % 3001, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {r.id: r.n for r in mutations.numbered(df, ["g"], [F.col("v"), F.col("id")], "n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[r[2]] = n
    assert got == want
    assert mutations.positions(df.limit(0), [F.col("id")], "at").count() == 0


def test_flagship_keeps_every_block_once(spark, sf):
    from pyspark.sql import functions as F

    from pagemill.operators import geometry
    from pagemill.plans import render
    from pagemill.sources.tables import blocks, distinct_pages

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = render.layout_plan(pages).cache()
    assert plan.count() == plan.select("page_id", "block_idx").distinct().count()
    boxed = blocks(distinct_pages(pages)).where("x1 is not null and category not in ('Page-header', 'Page-footer')")
    ratio = geometry.nearest_paper(F.col("ow"), F.col("oh"))["diff"] <= geometry.MAX_RATIO_DIFF
    assert plan.count() == geometry.without_stamps(boxed.where(ratio)).count()
    order = [(r.page_id, r.block_idx, r.section_idx, r.column_idx) for r in plan.orderBy("page_id", "block_idx").collect()]
    for a, b in zip(order, order[1:]):
        if a[0] == b[0]:
            assert b[2] in (a[2], a[2] + 1) and b[3] in (a[3], a[3] + 1)
    assert render.with_content(plan).count() == plan.count()
    assert render.export_plan(pages, "plain").count() > 0 and render.export_plan(pages, "pdf").count() > 0


def test_flagship_renders_headers_and_footers(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from pagemill.operators import geometry
    from pagemill.sources.tables import blocks, distinct_pages

    plan = Q["render_plan_layout"](spark, sf).cache()
    boxed = blocks(distinct_pages(spark.read.parquet(f"{sf}/pages.parquet"))).where("x1 is not null")
    fits = boxed.where(geometry.nearest_paper(F.col("ow"), F.col("oh"))["diff"] <= geometry.MAX_RATIO_DIFF)
    edges = fits.where("category in ('Page-header', 'Page-footer')").join(plan.where("part = 'main'").select("page_id").distinct(), "page_id", "left_semi")
    mine = plan.where("part <> 'main'")
    assert mine.count() == edges.count() > 0
    assert mine.select("page_id", "block_idx", "category", "text").exceptAll(edges.select("page_id", "block_idx", "category", "text")).isEmpty()
    assert mine.where("section_idx <> 0 or column_idx is not null or break_type <> '' or align <> 'LEFT' or share is null").isEmpty()
    assert mine.groupBy("page_id", "part").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()

    lay = lambda *x: (2480, 3508, 2480, 3508, list(x))
    head = lambda a, z: ([a, 10.0, z, 50.0], "Page-header", "h", None)
    body = ([100.0, 500.0, 2300.0, 900.0], "Text", "t", None)
    rows = [("p1", "e", 1, "f", lay(head(0.0, 300.0), body, head(300.0, 400.0), ([], "Page-header", "unboxed", None))), ("p2", "e", 2, "f", lay(head(0.0, 300.0)))]
    spark.createDataFrame(rows, spark.read.parquet(f"{sf}/pages.parquet").drop("landed_at").schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.part, r.block_idx, r.share) for r in Q["render_plan_layout"](spark, str(tmp_path)).orderBy("block_idx").collect()]
    assert got == [("p1", "header", 0, 0.75), ("p1", "main", 1, None), ("p1", "header", 2, 0.25)]


def test_markdown_runs_of_every_inline_text(spark, sf, tmp_path):
    texts = [
        ("Text", "a *b* c"), ("Footnote", "__u__"), ("Caption", "plain"), (None, "2 * 3"), ("Title", "**x** y"), ("Section-header", ""), ("Text", None),
        ("Table", "**t**"), ("List-item", "*l*"), ("Picture", "p"),
    ]
    rows = [("p1", "e", 1, "f", (10, 10, 10, 10, [([], k, t, None) for k, t in texts]))]
    spark.createDataFrame(rows, spark.read.parquet(f"{sf}/pages.parquet").drop("landed_at").schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in Q["markdown_runs"](spark, str(tmp_path)).drop("page_id").collect())
    no = (False, False, False)
    assert got == [
        (0, 0, "a ", *no), (0, 1, "b", False, True, False), (0, 2, " c", *no), (1, 0, "u", False, False, True), (2, 0, "plain", *no), (3, 0, "2 * 3", *no),
        (4, 0, "x", True, False, False), (4, 1, " y", *no),
    ]


def test_markdown_runs_without_marker_equal_the_tokenizer(spark, sf):
    from pagemill.functions import markup
    from pagemill.sources.tables import blocks, distinct_pages

    b = blocks(distinct_pages(spark.read.parquet(f"{sf}/pages.parquet"))).where("text is not null").collect()
    want = sorted((r.page_id, r.block_idx, k, *x) for r in b if r.category not in ("Table", "List-item", "Picture") for k, x in enumerate(markup.runs(r.text)))
    assert sorted(tuple(r) for r in Q["markdown_runs"](spark, sf).collect()) == want
