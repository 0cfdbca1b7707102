import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import markup, text
from pagemill.operators import dispatch, geometry, layout, mutations, recognition


def col(spark, values, fn, ddl="v string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ddl)
    return [r[0] for r in df.orderBy("i").select(fn).collect()]


def test_labels_boxes_markers(spark):
    assert col(spark, ["List-Item", "section_header", "Equation-Block", "weird", None, ""], text.label_of(F.col("v"))) == ["List-item", "Section-header", "Formula", "Text", "Text", "Text"]
    boxes = col(spark, ["0 0 500 1000", " 10  20 5 2000 ", "1 2 3", "a b c d", "", None], text.box_of(F.col("v"), F.lit(100), F.lit(200)))
    assert boxes == [[0, 0, 50, 200], [1, 4, 0.5, 200], [], [], [], []]
    m = col(spark, ["I am here", "1.1.1 x", "1.1 x", "10.11 q", "2024 was", "• dot", "a) b", "iv. z", "plain"], text.marker(F.col("v")))
    assert [x[0] for x in m] == ["I", None, "1.1", None, None, "-", "a)", "iv.", None]
    assert m[5][1] == "dot" and m[8][1] == "plain"


def test_text_functions(spark):
    assert col(spark, ["De_thi-2.pdf", "a.b.c"], text.default_title(F.col("v"))) == ["De thi 2", "a.b"]
    assert col(spark, [(512,), (2048,), (15 * 1024,), (5 << 20,), (3 << 40,)], text.format_bytes(F.col("v")), "v long") == ["512 B", "2.0 KB", "15 KB", "5.0 MB", "3.0 TB"]
    assert col(spark, [(1, 2), (1, 3), (0, 0), (199, 200)], text.percent(F.col("v"), F.col("w")), "v int, w int") == [50, 33, None, 100]
    assert col(spark, ["http://h:1/v1/", "http://h"], text.health_url(F.col("v"))) == ["http://h:1/health", "http://h/health"]
    assert col(spark, ["https://abc.example.co"], text.project_ref(F.col("v"))) == ["abc"]
    assert col(spark, ['{"error":{"message":"m"}}', '{"message":"n"}', '{"x":1}'], text.error_text(F.col("v"))) == ["m", "n", '{"x":1}']
    assert col(spark, ["a\n \n \nb"], text.tidy(F.col("v"))) == ["a\n\n\nb"]
    assert col(spark, ["<B>x\ny</B> <em>i</em> <u>z</u>"], text.inline_markup(F.col("v"))) == ["**x\ny** *i* __z__"]
    assert col(spark, ["Đề thi Lịch sử.doc", "???", None], markup.ascii_udf("v"))[:2] == ["De thi Lich sudoc", "de-thi"]


def test_markup_vectors():
    assert markup.runs("**b *i* c** 2 * 3 * 4") == [("b ", True, False, False), ("i", True, True, False), (" c", True, False, False), (" 2 * 3 * 4", False, False, False)]
    assert markup.stripped("**x** and *y*") == "x and y"
    assert markup.runs("***x***") == [("x", True, True, False)] and markup.runs("") == []
    g = markup.grid("<table><tr><td rowspan=2>a</td><td colspan=99>b</td></tr><tr><td>c<br>d</td></tr></table>")
    assert g == [(0, 0, 1, 0, "a"), (0, 1, 0, 1, "b"), (1, 1, 1, 1, "c\nd")]
    assert markup.grid("no table") == []
    assert [x[1] for x in markup.list_lines("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>")] == [0, 1, 0]
    assert [x[4] for x in markup.list_lines("<p>x<br>y</p>")] == ["x", "y"] and markup.list_lines("p\nq") == [(0, -1, False, None, "p\nq")]
    assert [x[4] for x in markup.list_lines("<ul><li>a <b>b</b>c<br>d</li><li> </li></ul><p>x\ny<b>z</b><br/>w</p>")] == ["a b c d", "x\ny z", "w"]
    assert [x[3] for x in markup.list_lines("<ol><li></li><li>q</li></ol>")] == [2] and markup.list_lines("<ul><li>a</li><l")[0][4] == "a" and markup.parse("a < b").text() == "a < b"
    blocks = markup.response_blocks('<div data-bbox="0 0 10 10" class="List-Item x"><ul><li>q</li></ul><div data-bbox="1 1"><h1>T</h1></div></div>', 1000, 1000)
    assert [(b[1], b[3]) for b in blocks] == [("List-item", None), ("Title", None)] and blocks[1][0] == []
    assert markup.response_blocks(None, 1, 1) == [([], "Text", "", None)]
    assert markup.response_blocks("<script>x</script><p>a&amp;amp;b</p>", 1, 1)[0][2] == "a&b"


def test_paper_and_resize(spark):
    rows = [(1654, 2338), (2338, 1654), (600, 900), (1000, 1000), (0, 5), (1, 201), (3000, 9000)]
    papers = col(spark, rows, geometry.nearest_paper(F.col("w"), F.col("h")), "w int, h int")
    assert papers[0].name == "a4" and (papers[1].width, papers[1].height) == (3508, 2480) and papers[4] is None
    got = col(spark, rows, geometry.resized(F.col("w"), F.col("h")), "w int, h int")
    assert got[4] is None and got[5] is None
    for (w, h), g in zip(rows, got):
        if g:
            assert g.width % 28 == 0 and g.height % 28 == 0 and g.width * g.height <= geometry.MAX_PIXELS
    assert col(spark, [(2.5,), (0.5,), (1.5,)], geometry.scaled(F.col("v"), F.lit(1), F.lit(1)), "v double") == [2, 0, 2]


def test_stamps_alignment_widths(spark):
    b = spark.createDataFrame(
        [("p", 0, "Picture", 100.0, 100.0, 400.0, 400.0), ("p", 1, "Text", 150.0, 150.0, 350.0, 350.0), ("p", 2, "Text", 400.0, 100.0, 600.0, 400.0), ("p", 3, "Picture", 600.0, 600.0, 800.0, 800.0), ("q", 0, "Picture", 100.0, 100.0, 400.0, 400.0)],
        "page_id string, block_idx int, category string, x1 double, y1 double, x2 double, y2 double",
    )
    assert sorted((r.page_id, r.block_idx) for r in geometry.without_stamps(b).collect()) == [("p", 1), ("p", 2), ("p", 3), ("q", 0)]
    al = col(spark, [(400.0, 600.0), (0.0, 1000.0), (700.0, 1000.0), (0.0, 300.0)], geometry.alignment(F.col("a"), F.col("b"), F.lit(0.0), F.lit(1000.0)), "a double, b double")
    assert al == ["CENTER", "LEFT", "RIGHT", "LEFT"]
    assert col(spark, [(5.0,)], geometry.alignment(F.col("a"), F.col("a"), F.lit(5.0), F.lit(5.0)), "a double") == ["LEFT"]


def brute_split(x1, x2, width):
    n, best, back = len(x1), [0.0] + [math.inf] * len(x1), [0] * (len(x1) + 1)
    for i in range(1, n + 1):
        for j in range(i):
            a, b = x1[j:i], x2[j:i]
            span = max(b) - min(a) or layout.EPS
            va, vb = np.var(a / width), np.var((a + b) / 2 / width)
            c = best[j] + 0.95 * sum(1 - (b - a) / span) + 0.05 * 2 * va * vb / (va + vb + 1e-6) + 0.65
            if c < best[i] - 1e-12:
                best[i], back[i] = c, j
    cuts, i = [], n
    while i:
        cuts.append(i)
        i = back[i]
    return best[n], cuts


def test_column_split_against_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        n = rng.randint(1, 12)
        x1 = np.array([rng.choice([100.0, 850.0]) + rng.randint(0, 40) for _ in range(n)])
        x2 = x1 + np.array([rng.randint(200, 650) for _ in range(n)], float)
        got = layout.split_columns(x1, x2, 1654.0)
        assert got[0] == 0 and set(np.diff(got)) <= {0, 1}
        cuts = [int(i) for i in np.flatnonzero(np.diff(got)) + 1] + [n]
        cost, want = brute_split(x1, x2, 1654.0)
        assert sorted(want) == cuts
    assert len(layout.split_columns(np.zeros(0), np.zeros(0), 1.0)) == 0


def simulate(reqs, budget):
    used, closed, out = 0, False, []
    for n, ok in reqs:
        take = ok and not closed and used + n <= budget
        if ok and not closed and used + n > budget:
            closed = True
        used += n if take else 0
        out.append(take)
    return out


def test_admission_against_simulator(spark):
    rng = random.Random(5)
    runs = {f"r{k}": [(rng.randint(0, 6), rng.random() < 0.8) for _ in range(rng.randint(1, 9))] for k in range(150)}
    rows = [(k, i, n, ok) for k, rs in runs.items() for i, (n, ok) in enumerate(rs)]
    df = spark.createDataFrame(rows, "run string, pos int, n int, ok boolean")
    got = {(r.run, r.pos): r.admitted for r in dispatch.admit_under_budget(df, "run", "pos", "n", "ok", 12).collect()}
    for k, rs in runs.items():
        assert [got[(k, i)] for i in range(len(rs))] == simulate(rs, 12)


def test_mutations(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, n int, s string")
    merged = mutations.merge_fields(rows, spark.createDataFrame([("a", None)], "id string, s string"), "id").collect()
    assert sorted(tuple(r) for r in merged) == [("a", 1, None), ("b", 2, None)]
    names = spark.createDataFrame([(f"n{i:04d}",) for i in range(250)], "name string")
    got = {r.name: r.chunk for r in mutations.chunks(names, "name").collect()}
    assert got["n0099"] == 0 and got["n0100"] == 1 and max(got.values()) == 2
    pages = spark.createDataFrame([("e", "p1", 1), ("e", "p2", 2), ("e", "p3", 3)], "exam_id string, page_id string, page_order int")
    want = spark.createDataFrame([("e", "p3", 1), ("e", "zz", 2), ("e", "p1", 3)], "exam_id string, page_id string, pos int")
    keep = {r.page_id: r.page_order for r in mutations.reorder(pages, want, "page_id", "exam_id", "page_order", True).collect()}
    drop = {r.page_id: r.page_order for r in mutations.reorder(pages, want, "page_id", "exam_id", "page_order", False).collect()}
    assert keep == {"p3": 1, "p1": 2, "p2": 3} and drop == {"p3": 1, "p1": 2}


def test_recognition_retries_only_unreachable(spark):
    calls = spark.createDataFrame([("p1", "<p>x</p>", 10, 10), ("p2", None, 10, 10)], "page_id string, html string, input_width int, input_height int")
    got = {r.page_id: (r.status, r.attempts, len(r.blocks)) for r in recognition.recognise(calls).collect()}
    assert got == {"p1": ("ok", 1, 1), "p2": ("bad_request", 1, 0)}
    down = {r.page_id: (r.status, r.attempts) for r in recognition.recognise(calls, lambda r: ("unreachable", ""), wait=0.0).collect()}
    assert down == {"p1": ("unreachable", 3), "p2": ("unreachable", 3)}


@pytest.mark.parametrize("n", [0, 1])
def test_previews(spark, tmp_path, n):
    from pagemill.sources.tables import json_previews, preview_pages

    if n:
        (tmp_path / "a.json").write_text(json.dumps({"previewId": "v", "title": "t", "createdAt": "now", "pages": [{"id": "p", "order": 1, "source": "s", "file": "f"}]}))
        (tmp_path / "b.json").write_text("{broken")
    folder = str(tmp_path) if n else str(tmp_path / "none")
    assert preview_pages(json_previews(spark, folder)).count() == n
