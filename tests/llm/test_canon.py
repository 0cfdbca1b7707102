import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import canon

PLAIN = ["Đề thi Toán", "x² + ½ № 3 … « река » “q” – α β Δ", "H₂O 100 °C", "cœur", "", "a\nb\tc"]
CASES = {
    "Đề": "Đề", "ｔｈｅ １２": "the 12", "a b　c": "a b c", "w​o‍rd⁠": "word", "thе": "the", "Ðáp": "Đáp", "Ɖáp": "Đáp",
    "сâу": "câu cây"[4:] if False else "câу".replace("у", "y"), "ϲɑ́": "cá", "гека": "гека", "хe": "xe", "а": "a", "книгa": "книга",
}


def brute(text):
    """The same form over the whole value, without segments."""
    return canon._segment(text)


def test_vectors():
    for t in PLAIN:
        assert canon.canonical(t) == t, ascii(t)
    for t, want in CASES.items():
        assert canon.canonical(t) == want, (ascii(t), ascii(canon.canonical(t)))
    assert canon.canonical(None) is None


letters = st.text(alphabet="aeoxyzđĐáạ ấ\n12αβеосрА" + "̣́̂​ ｅ３ɑɡϲкнига.,²", max_size=24)


@settings(max_examples=400, deadline=None)
@given(letters)
def test_segments_equal_whole_values_and_form_is_stable(t):
    once = canon.canonical(t)
    assert canon.canonical(once) == once
    assert once == brute(t)
    assert unicodedata.is_normalized("NFC", once)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=12))
def test_all_of_unicode(t):
    once = canon.canonical(t)
    assert canon.canonical(once) == once == brute(t)
    assert unicodedata.is_normalized("NFC", once)


def test_every_character_that_changes_is_unstable():
    """No code point outside the class derived from the properties is changed, alone or between letters; none inside escapes."""
    import sys

    known = {p for k, v in canon.properties().items() if k != "mark" for p in v}
    for p in range(sys.maxunicode + 1):
        c = chr(p)
        if unicodedata.category(c) not in ("Cs", "Cn", "Co") and p not in known:
            assert unicodedata.is_normalized("NFC", "a" + c + "e") and canon._segment("a" + c + "e") == "a" + c + "e", hex(p)
    for t, want in {"\U0002f800": "\u4e3d", "\ufb1d": "\u05d9\u05b4", "\u0958": "\u0915\u093c", "x\U000e0041": "x", "x\U000e0100": "x", "=\u0338": "\u2260", "\u1112\u1161\u11ab": "\ud55c", "\u211d": "\u211d"}.items():
        assert canon.canonical(t) == want


def test_canonicalize_and_unstable_values(spark):
    values = PLAIN + list(CASES) + [chr(c) + "x" for c in (0xA0, 0x300, 0x200B, 0xFEFF, 0xFF21, 0x435, 0x1D400, 0x212A, 0xAD)] + [None]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "i int, v string, canonical_ string")
    got = {r.i: r for r in canon.canonicalize(df, "v").collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        assert got[i].canonical == canon.canonical(v)
    assert {r.i for r in canon.unstable_values(df, "v").collect()} == {i for i, v in enumerate(values) if v is not None and canon.canonical(v) != v}
    assert canon.unstable_values(df.limit(0), "v").count() == 0


def test_long_and_repeated(spark):
    long = "từ " * 200_000 + "thе"
    df = spark.createDataFrame([(1, long), (1, long)], "i int, v string").select("i", "v", F.lit(1).alias("extra"))
    assert [len(r.canonical) for r in canon.unstable_values(df, "v").collect()] == [len(long)] * 2
