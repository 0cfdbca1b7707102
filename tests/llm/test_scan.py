import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import repair, scan, truncation

OCR = "struct<origin_width:int,origin_height:int,input_width:int,input_height:int,layouts:array<struct<bbox:array<double>,category:string,text:string,level:int>>>"
PAGES = f"id string, exam_id string, page_order smallint, file_path string, ocr_text {OCR}, extra string, texts string, page_id string"

WORDS = "the greenhouse staff carefully described a quadratic equation without using a calculator before the storm arrived in thorn market".split()
LEX = scan.Lexicon({w: 500 for w in WORDS} | {"described": 600, "rnarket": 2, "hình": 400, "người": 400, "without": 500, "tin": 300, "using": 200, "người": 300, "carefully": 500, "morning": 50})
SENTENCE = "The greenhouse staff carefully described a quadratic equation."


def page(pid, exam, order, *blocks, path="x/1.PNG"):
    return (pid, exam, order, path, (1, 1, 1, 1, [None if b is None else ([], b[0], b[1], None) for b in blocks]), "e", "t", "p")


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def body(spark, n=12):
    """Pages that make the lexicon known."""
    return [page(f"v{i}", f"v{i}", 1, *[("Text", SENTENCE + " " + SENTENCE + " Without using a calculator, the storm arrived.")] * 4) for i in range(n)]


def test_lexicon_drops_noise_and_repairs():
    assert "rnarket" not in LEX and LEX.repair("rnarket") == "market" and LEX.repair("grccnhouse") == "greenhouse"
    assert LEX.repair("f1nd") is None and LEX.repair("8D2") is None and LEX.repair("equati0n") == "equation" and LEX.repair("liìnli") == "hình"
    assert LEX.repair("carefuUy") == "carefully" and LEX.repair("moming") == "morning" and LEX.repair("e9uation") == "equation" and LEX.repair("storm!") is None and LEX.repair("t!n!") is None and LEX.repair("ngườ!") == "người"
    assert LEX.repair("tlie") == "the" and LEX.repair("zzz") is None and LEX.repair("Ngưòi") is None


@pytest.mark.parametrize("line, order, yes", [
    ("Page 3/13", 3, True), ("- 4 -", 4, True), ("[l]", 1, True), ("xiv", 14, True), ("TRANG 7", 7, True), ("Trang I trên II", 1, True), ("9 | 13", 9, True), ("Page 3", 4, False),
    ("3. a list", 3, False), ("", 1, False), ("12", None, False), ("tr. l2", 12, True), ("12" + " " * 90, 12, True),
])
def test_page_numbers(line, order, yes):
    assert scan.is_page_number(line, order) is yes


def test_skeleton_meets_over_misreadings():
    a = scan.skeleton("Chemistry Department – internal copy 00000012")
    assert a == scan.skeleton("CHEMISTRY  Departrnent – inferrial copy 000000l2") and a != scan.skeleton("Chemistry Department – internal copy 00000013")
    assert scan.split_tail("Tổ Toán – Mã 3 – Trang 4/9", 4) == ("Tổ Toán – Mã 3", "Trang 4/9")


@pytest.mark.parametrize("text, want", [
    ("<table><tr><td>a</td></tr></table>", "whole"), ("<table><tr><td>a</t", "cut"), ("<ul><li>a</li>", "cut"), ("<a " + "x" * 500, "cut"), ("$$x + 1$$", "whole"), ("$$x + ", "cut"),
    ("The storm arr", "unclosed"), ("The storm arrived.", "whole"), ("Fill in. ______", "whole"), ("Fill in. ………", "whole"), ("The storm arr…", "unclosed"), ("The storm [...]", "unclosed"),
    ("the storm arrived", "unclosed"), ("", "whole"), ("then contin\ufffd", "cut"),
])
def test_verdict(text, want):
    assert truncation.verdict(text)[0] == want


def test_final_tokens_and_contexts():
    assert truncation.verdict("The storm arr…") == ("unclosed", "arr", True, "the storm arr") and truncation.verdict("The storm [...]")[1] == "storm"
    assert truncation.final_token("x" * 5000 + " Grün") == "grün" and truncation.final_token("a 12") == "" and truncation.context_of("no 12 and 3") == "0 and 0"


def test_cut_blocks(spark):
    rows = body(spark) + [
        page("a1", "E", 1, ("Text", SENTENCE), ("Text", "In thorn market the greenhouse")), page("a1", " e ", 1, ("Text", SENTENCE), ("Text", "In thorn market the greenhouse")),
        page("a2", "e", 2, ("Text", "staff carefully described the storm.")), page("b1", "f", 1, ("Text", "The greenhouse staff care"), ("Text", SENTENCE)), page("c1", None, None, None, ("Text", None), ("Text", "The storm arr")),
        page("d1", "g", 1, ("Text", "The storm arr")), page("d2", "g", 2, ("Text", SENTENCE)), ("n", "g", 3, None, None, "e", "t", "p"),
    ]
    got = sorted((r.page_id, r.block_idx) for r in truncation.cut_blocks(frame(spark, rows)).collect())
    assert got == [("b1", 0), ("c1", 2), ("d1", 0)]
    rep = {r.source: (r.n_blocks, r.n_cut) for r in truncation.truncation_report(frame(spark, rows)).collect()}
    assert rep["png"][1] == 3
    by = {(r.page_id, r.block_idx): set(r.evidence) for r in truncation.cut_blocks(frame(spark, rows)).collect()}
    # "arrived" only ends texts here, so the trie doesn't know it.
    assert by == {("b1", 0): {"trie", "closing"}, ("c1", 2): {"closing"}, ("d1", 0): {"closing"}}
    assert truncation.cut_blocks(frame(spark, rows).limit(0)).count() == 0


def test_found_noise(spark):
    head = "Chemistry Department – internal copy 00000012"
    rows = body(spark) + [
        page("a1", "E", 1, ("Text", f"{head} | Page 1/3"), ("Text", "The green-\nhouse staff carefully descri-"), ("Page-footer", "1")), page("a2", "e", 2, ("Caption", "Chemistry Departrnent – internal copy 00000012"), ("Text", "bed a quadratic equation.")),
        page("a3", "e", 3, ("Text", f"{head}\nThe grccnhouse staff arrived in thorn market.")), page("a3", "e", 3, ("Text", f"{head}\nThe grccnhouse staff arrived in thorn market.")), page("z", None, None, None, ("Text", ""), ("Text", None)),
    ]
    got = {(r.page_id, r.block_idx, r.kind) for r in repair.found_noise(frame(spark, rows)).collect()}
    assert {g for g in got if g[2] == "running"} == {("a1", 0, "running"), ("a2", 0, "running"), ("a3", 0, "running")}
    assert {g for g in got if g[2] == "page_number"} == {("a1", 0, "page_number"), ("a1", 2, "page_number")}
    assert {g for g in got if g[2] == "hyphen"} == {("a1", 1, "hyphen")}
    assert ("a3", 0, "char") in got
    assert repair.found_noise(frame(spark, rows).limit(0)).count() == 0


def test_decode_and_paragraphs():
    assert repair.decode("The green-\nhouse staff care fully descri-\nbed a qua dratic equati0n.", LEX) == "The greenhouse staff carefully described a quadratic equation."
    assert repair.decode("greenhousestaff arrived", LEX) == "greenhouse staff arrived"
    assert repair.decode("", LEX) == "" and repair.decode("zzz qqq", LEX) == "zzz qqq"
    lines = ["The staff described a quadratic equation", "without using a calculator before.", "Then the storm arrived in the market and", "the staff carefully described it."]
    assert repair.paragraph_breaks(lines) == [0, 2] or repair.paragraph_breaks(lines) == [0]
    assert repair.paragraph_breaks(["A short end.", "Another line that is much longer than the first one was before"]) == [0, 1]
    assert repair.paragraph_breaks([]) == []


def test_repaired(spark):
    rows = body(spark) + [page("a1", "e", 1, ("Text", "The grccnhouse staff care-\nfully described a quadratic\nequation."), ("Page-footer", "- 1 -"))]
    got = [r for r in repair.repaired_paragraphs(frame(spark, rows)).collect() if r.page_id == "a1"]
    assert [r.text for r in got] == [SENTENCE]


def test_paragraphs_over_pages(spark):
    rows = body(spark) + [
        page("a1", "e", 1, ("Text", SENTENCE), ("Text", "The greenhouse staff care-"), ("Page-footer", "- 1 -")), page("a2", " E", 2, ("Text", "fully described a quadratic")), page("a3", "e", 3, ("Text", "equation without using")),
        page("a4", "e", 4, ("Text", "a calculator."), ("Text", SENTENCE)), page("b1", "f", 1, ("Text", "The storm")), page("b2", "f", 2, ("Text", SENTENCE)),
    ]
    got = {(r.page_id, r.paragraph): (r.n_pages, r.text) for r in repair.continuous_paragraphs(frame(spark, rows)).collect() if r.page_id[0] in "ab"}
    assert got == {
        ("a1", 0): (1, SENTENCE), ("a1", 1): (4, "The greenhouse staff carefully described a quadratic equation without using a calculator."), ("a4", 1): (1, SENTENCE),
        ("b1", 0): (1, "The storm"), ("b2", 0): (1, SENTENCE),
    }
    assert repair.continuous_paragraphs(frame(spark, rows).limit(0)).count() == 0


def test_paragraphs_without_the_exams_own_running_lines(spark):
    line = "Sedge Hall School – Computing 6 – Code 00000987"
    two, three = "Without using a calculator, the storm arrived.", "The market arrived before the storm."
    rows = body(spark) + [
        page("a1", "e", 1, ("Section-header", line), ("Text", SENTENCE)), page("a2", "e", 2, ("Text", "Sedge Ha11 School – Computing 6 – Code 00000987\n" + two)),
        page("a3", "e", 3, ("Text", three + "\n" + line + " | Page 3/4\n")), page("a4", "e", 4, ("Text", "In thorn market. | 4")), page("b1", "f", 1, ("Text", line)),
    ]
    got = {r.page_id: r.text for r in repair.continuous_paragraphs(frame(spark, rows)).where("exam_id in ('e', 'f')").collect()}
    assert got == {"a1": SENTENCE, "a2": two, "a3": three, "a4": "In thorn market.", "b1": line}
    held = {r.page_id for r in repair.found_noise(frame(spark, rows)).where("kind = 'running'").collect()}
    assert held == {"a1", "a2", "a3"}


def test_known_words_put_right_by_context(spark):
    good, bad = ("Text", "Now the corn burn now. " * 40 + "A bum is far and a bum is near, a bum was there and a bum went. " * 2), ("Text", "See the corn bum now. And so on.")
    pages = frame(spark, [page("a", "e", 1, good), page("b", "e", 9, bad)])
    assert ("b", 0, "char") in {tuple(r) for r in repair.found_noise(pages).collect()}
    got = {r.page_id: r.text for r in repair.continuous_paragraphs(pages).collect()}
    assert got["b"] == "See the corn burn now. And so on." and "a bum is near" in got["a"]
    assert repair.in_context("The Tin, a tin and the TIN", {("the", "tin"): "using"}) == "The Using, a tin and the USING"


HARD = {
    "The gre enho use staff": "The greenhouse staff", "greenhousestaffcarefully": "greenhouse staff carefully", "greenh0usestaff arrived": "greenhouse staff arrived",
    "A green-\nhou-\nse in the market": "A greenhouse in the market", "the m4rket": "the market", "Carefu11y\ndescribed": "Carefully described", "a ca1cu1at0r": "a calculator",
    "carefully-\ndescribed storm": "carefully-described storm", "MAR-\nKET storm": "MARKET storm", "qqq-\nzzz": "qqqzzz",
}


@pytest.mark.parametrize("text", list(HARD))
def test_lattice(text):
    got = repair.decode(text, LEX)
    assert got == HARD[text] and "\ue000" not in got


def test_any_number_of_misreadings():
    lex = scan.Lexicon({"misunderstandings": 500, "responsibilities": 400, "moming": 3, "morning": 90, "the": 900})
    assert lex.repair("m15under5tand1ng5") == "misunderstandings" and lex.repair("re5pon51b1l1t1e5") == "responsibilities" and "moming" not in lex
    assert scan.misreads("misunderstandings", "m15under5tand1ng5") == 5 and scan.misreads("cat", "eat") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aemnhudwlt1!|09q5$6834@7 \tÀếß日ЖM", max_size=40))
def test_skeleton_is_the_shape_without_blanks(t):
    assert scan.skeleton(t) == "".join(scan.shape(t).split())


def test_trie():
    t = scan.Trie(["a", "abc", "abd", "b"])
    assert t.is_inner("a") and t.is_inner("ab") and not t.is_inner("abc") and not t.is_inner("x") and t.is_inner("") and not t.is_inner("b")
    assert not scan.Trie([]).is_inner("a")


def mixed(spark, n=12):
    """Pages with every kind of noise, repeated and null rows."""
    head = "Chemistry Department – internal copy 00000012"
    return body(spark, n) + [
        page("a1", "E", 1, ("Text", f"{head} | Page 1/3"), ("Text", "The green-\nhouse staff carefully descri-"), ("Page-footer", "1")), page("a2", "e", 2, ("Caption", "Chemistry Departrnent – internal copy 00000012"), ("Text", "bed a quadratic equation.")),
        page("a3", "e", 3, ("Text", f"{head}\nThe grccnhouse sta ff arrived in thornmarket and the storm arr")), page("z", None, None, None, ("Text", ""), ("Text", None)), page("a3", "e", 3, ("Text", f"{head}\nThe grccnhouse sta ff arrived in thornmarket and the storm arr")),
        page("c1", "g", 4, ("Text", "Staff descri-"), ("Picture", "The map"), ("Text", "bed it. The calcul")),
    ]


def rows(df):
    return sorted(tuple(sorted(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def test_joined_tables_give_what_sent_ones_give(spark):
    pages = frame(spark, mixed(spark)).repartition(3)
    for f in (repair.found_noise, truncation.cut_blocks, repair.continuous_paragraphs):
        sent, joined = rows(f(pages)), rows(f(pages, most=-1))
        assert sent == joined and sent


def test_other_text_changes_nothing(spark):
    """The planted rows are found alike, alone and beside fifty times as much text in other words."""
    own = mixed(spark)
    letters = "bcdfgkpv"
    words = ["".join(letters[(i >> s) % 8] + "aeou"[(i >> s) % 4] for s in (0, 2, 4, 6)) for i in range(256)]
    other = [page(f"o{k}", f"o{k // 8}", k % 8 + 1, *[("Text", " ".join(words[(k * 37 + j * 11 + i * 3) % 256] for i in range(60)).capitalize() + ".") for j in range(4)]) for k in range(50 * 12)]
    alone, beside = frame(spark, own), frame(spark, own + other)
    mine = lambda df: [r for r in rows(df) if r[0] is None or not r[0].startswith("o")]
    assert mine(repair.found_noise(alone)) == mine(repair.found_noise(beside))
    assert mine(truncation.cut_blocks(alone)) == mine(truncation.cut_blocks(beside))
    got = lambda df: sorted((r.page_id, r.text) for r in repair.continuous_paragraphs(df).collect() if not r.page_id.startswith("o"))
    assert got(alone) == got(beside)


def test_no_running_line_or_page_number_survives_alone(spark):
    pages = frame(spark, mixed(spark))
    texts = {(r.id, i): b.text for r in pages.collect() if r.ocr_text for i, b in enumerate(r.ocr_text.layouts) if b}
    gone = {(r.page_id, texts[r.page_id, r.block_idx].strip()) for r in repair.found_noise(pages).where("kind in ('running', 'page_number')").collect() if "\n" not in texts[r.page_id, r.block_idx].strip()}
    left = {(r.page_id, r.text.strip()) for r in repair.continuous_paragraphs(pages).collect()}
    assert len(gone) >= 3 and not gone & left


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    pages = frame(spark, mixed(spark)).withColumns({c: F.lit("x") for c in ("kind", "word", "_lex", "labels", "n", "key", "shape")})
    assert repair.found_noise(pages).count() == repair.found_noise(frame(spark, mixed(spark))).count()
    assert truncation.cut_blocks(pages).count() == truncation.cut_blocks(frame(spark, mixed(spark))).count()


def test_very_long_texts(spark):
    """Nothing takes more than its length: long runs of digits, letters, blanks and signs, and a text of many words."""
    import time

    odd = [("Text", "7" * 200_000), ("Text", "x" * 200_000), ("Text", "|" * 100_000 + " 12"), ("Text", "a" + " " * 100_000 + "1"), ("Text", (SENTENCE + " ") * 20_000 + "The storm arr"), ("Text", "_" * 5_000)]
    pages = frame(spark, body(spark) + [page(f"a{k}", "e", 1, b, b, b, b, b) for k, b in enumerate(odd)])
    began = time.time()
    assert {r.page_id for r in truncation.cut_blocks(pages).collect()} >= {"a4"}
    assert repair.found_noise(pages).where("page_id = 'a4' and kind <> 'running'").count() == 0
    assert time.time() - began < 90
