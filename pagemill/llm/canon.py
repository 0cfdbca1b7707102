"""Visually identical text with different characters: one consistent form.

The form: accents composed with their letters (NFC), letters and digits of ordinary width, ordinary
spaces, nothing invisible, each word in the letters of its own language. Line breaks and tabs stay,
and so do signs that mean something by themselves (superscripts, fractions, ellipses, typographic
quotes and dashes, Greek symbols, whole words of another alphabet).

Method: which characters are stable is derived from the Unicode property data over all code points
(quick check of NFC with its No and Maybe, general category, decomposition tag, script). The quick check is
one search for an unstable character by table, an Arrow batch at a time (a tenth of the cost of the same class
on the JVM); values without one pass. In the others the unstable segments are isolated: each unstable character with its boundary context, the unbroken run between
ordinary blanks and line breaks around it (no canonical composition reaches over a blank). Each
segment is normalised alone and spliced into the unchanged text.

Defined results: null stays null, empty stays empty, an already consistent value comes back equal;
the form is idempotent; repeated rows give repeated equal results; length is not bounded.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets that look like Latin ones, pairwise.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "у": "y", "ԝ": "w", "х": "x", "к": "k", "ѵ": "v", "п": "n", "г": "r", "т": "t", "м": "m", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G", "Ѵ": "V",
}
GREEK = {
    "α": "a", "ϲ": "c", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ε": "e", "σ": "o", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
}
ARMENIAN = {"օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "ք": "f", "Օ": "O", "Ս": "U", "Լ": "L", "Տ": "S"}
LATIN_VARIANTS = {"ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "ɩ": "i", "ʋ": "v", "ʏ": "y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ſ": "s", "Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ"}
FOREIGN = CYRILLIC | GREEK | ARMENIAN
TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC.items())}
#: Scripts whose letters may stand for Latin ones, as their characters' names begin.
SCRIPTS = ("GREEK ", "CYRILLIC ", "ARMENIAN ")
# Signs without a width of their own that the categories don't tell, and format signs that show.
BLANKS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
SHOWN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
#: Selectors of glyph variants: categories Mn and Cf hold them, so they are named by rule.
_SELECTOR = re.compile("VARIATION SELECTOR|TAG ")


@lru_cache(1)
def properties() -> dict[str, list[int]]:
    """Code points by what makes them unstable: space, hidden, wide, mark, other (script) and nfc (quick check No or Maybe)."""
    out: dict[str, list[int]] = {k: [] for k in ("space", "hidden", "wide", "mark", "other", "nfc")}
    second = set()
    for p in range(sys.maxunicode + 1):
        c = chr(p)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if kind == "Zs" and c != " ":
            out["space"].append(p)
        elif (kind in ("Cf", "Cc") and c not in "\t\n\r" and c not in SHOWN) or c in BLANKS or (kind == "Mn" and _SELECTOR.match(unicodedata.name(c, ""))):
            out["hidden"].append(p)
        elif kind == "Mn":
            out["mark"].append(p)
        d = unicodedata.decomposition(c)
        if d.startswith(("<wide>", "<narrow>")) or (d.startswith("<font>") and p > 0xFFFF):
            out["wide"].append(p)
        if d and d[0] != "<":
            parts = d.split()
            if len(parts) == 2 and unicodedata.is_normalized("NFC", c):
                second.add(int(parts[1], 16))
        if not unicodedata.is_normalized("NFC", c) or unicodedata.combining(c) or 0x1161 <= p <= 0x1175 or 0x11A8 <= p <= 0x11C2:
            out["nfc"].append(p)
        if kind[0] == "L" and (unicodedata.normalize("NFD", c)[0] in LATIN_VARIANTS or unicodedata.name(c, "").startswith(SCRIPTS)):
            out["other"].append(p)
    out["nfc"] = sorted({*out["nfc"], *second})
    return out


def ranges(points) -> list[tuple[int, int]]:
    """Runs of code points, ends included."""
    out: list[list[int]] = []
    for p in sorted(set(points)):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def _class(points) -> str:
    """The inside of a character class of Python's re."""
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in ranges(points))


@lru_cache(1)
def _patterns() -> dict[str, re.Pattern]:
    p = properties()
    return {
        "any": re.compile(f"[{_class(x for k, v in p.items() if k != 'mark' for x in v if x < 0x10000)}]"),
        "astral": re.compile("[\U00010000-\U0010ffff]"), "any_astral": re.compile(f"[{_class(x for k, v in p.items() if k != 'mark' for x in v if x >= 0x10000)}]"),
        "space": re.compile(f"[{_class(p['space'])}]"), "hidden": re.compile(f"[{_class(p['hidden'])}]"), "wide": re.compile(f"[{_class(p['wide'])}]+"),
        "words": re.compile(rf"(?:[^\W\d_][{_class(p['mark'])}]*)+"),
    }


def _own_letters(m: re.Match) -> str:
    word = m.group()
    # Decomposed, a mapped base letter takes over its marks.
    parts = unicodedata.normalize("NFD", word)
    if parts.isascii():
        return word
    letters = [c for c in parts if not unicodedata.combining(c)]
    if any(c in LATIN_VARIANTS for c in letters):
        parts = "".join(LATIN_VARIANTS.get(c, c) for c in parts)
        letters = [c for c in parts if not unicodedata.combining(c)]
    other = [c for c in letters if c >= "\u0370" and not "\u1e00" <= c <= "\u1eff"]
    if other:
        latin = [c for c in letters if c < "\u0370"]
        if all(c in FOREIGN for c in other) and (latin or _foreign_word_is_latin(other)):
            parts = "".join(FOREIGN.get(c, c) for c in parts)
        elif latin and all(c in TO_CYRILLIC for c in latin) and all("\u0400" <= c <= "\u052f" for c in other):
            parts = "".join(TO_CYRILLIC.get(c, c) for c in parts)
    return unicodedata.normalize("NFC", parts)


#: Letters whose look is Latin beyond doubt; a whole word of these alone is one of this corpus.
_SURE = frozenset("асеорхуіјѕԁһԛԝАВСЕНІЈКМОРЅТХУ" "ϲονΟΡΤΕΗΙΚΜΝΒΑΧΥΖ")


def _foreign_word_is_latin(other: list[str]) -> bool:
    """A word with no Latin letter at all is kept as a word of another alphabet, unless every letter
    is an exact double of a Latin one and it is longer than a symbol or is Cyrillic."""
    if not all(c in _SURE for c in other):
        return False
    return len(other) > 1 or "\u0400" <= other[0] <= "\u052f"


def _segment(text: str) -> str:
    p = _patterns()
    text = p["hidden"].sub("", p["space"].sub(" ", text))
    text = p["wide"].sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    return unicodedata.normalize("NFC", p["words"].sub(_own_letters, unicodedata.normalize("NFC", text)))


#: What a segment may be: an unbroken run between ordinary blanks, tabs and line breaks.
_BLANKS = " \t\n\r"
_RUN, _BLANK = re.compile("[^ \t\n\r]+"), re.compile("[ \t\n\r]")


def canonical(text: str | None) -> str | None:
    """The consistent form of one value."""
    if not text or text.isascii() and text.isprintable():
        return text
    p = _patterns()
    low, astral, high = p["any"].search, p["astral"].search, p["any_astral"].search

    def unstable(s: str) -> bool:
        return bool(low(s)) or bool(astral(s)) and bool(high(s))

    if not unstable(text):
        return text
    if astral(text):
        return _RUN.sub(lambda m: _segment(m.group()) if unstable(m.group()) else m.group(), text)
    out, at = [], 0
    for m in p["any"].finditer(text):
        if m.start() < at:
            continue
        begin = max(text.rfind(c, at, m.start()) for c in _BLANKS) + 1 or at
        end = _BLANK.search(text, m.end())
        end = end.start() if end else len(text)
        out += [text[at:begin], _segment(text[begin:end])]
        at = end
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def _canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(canonical, na_action="ignore")


def canonicalize(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """df with `out_col`, the consistent form of `text_col`."""
    return df.withColumn(out_col, _canonical(F.col(text_col)))


def unstable_values(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """Only the rows whose value differs from its consistent form."""
    return canonicalize(df, text_col, out_col).where(F.col(out_col) != F.col(text_col))


def corpus_values(exams: DataFrame, pages: DataFrame) -> DataFrame:
    """(field, record_id, block_idx, value) of exams.title and of every block text of pages."""
    titles = exams.select(F.lit("exams.title").alias("field"), F.col("id").alias("record_id"), F.lit(-1).alias("block_idx"), F.col("title").alias("value"))
    blocks = pages.select(F.lit("layouts.text").alias("field"), F.col("id").alias("record_id"), F.posexplode("ocr_text.layouts").alias("block_idx", "b")).select("field", "record_id", "block_idx", F.col("b.text").alias("value"))
    return titles.unionByName(blocks).where("value is not null")
