"""Personal information inside free text: mentions found and replaced by typed placeholders.

How strongly a term reveals a protected person is estimated from the corpus. Its disclosure is the log ratio (bits) of its
odds to stand with a person to the odds of its like, drawn towards 0 for terms seen seldom:

* names: the terms are the words of capitalised sequences, each at its place in the runs of the sequence, counted with and
  without an identifier right after it. The disclosure of a run is the sum over its terms; a run above THRESHOLD is a
  person. Place, school, inn and boat names never stand with identifiers and come out negative, even when made of the same
  syllables;
* numbers, mail addresses and street addresses: a form says what kind a value may be and where it begins and ends; the term is
  its shape (digits and letters as classes, the signs of a mail address, the type word of a street), counted with and without
  a capitalised sequence or another such value right before it. A shape the corpus shows not to stand with persons (HIDDEN
  or less) is a code, whatever its form;
* streets without a type word (a bare "12 Name") are known by names that stand after a type word elsewhere in the corpus.

What exceeds its threshold is removed, its kind left in its place.

Each text is read once: its identifiers and capitalised sequences are kept as facts beside the counts of terms, and
judged without the text when the counts are complete. The tables of terms and streets hold every term; they are sent to
the workers or joined to the documents as their measured size says (`scan.Shared`).

Defined results: null text has no mentions and stays null; mentions never overlap; positions are
character positions (code points) in the unchanged text; a text that comes twice gives the same
mentions for each row; very long texts are processed whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.scan import Shared

#: Bits from which a run of terms is taken to reveal a person; its first term has FIRST at least, and none is below WORST.
THRESHOLD, FIRST, WORST = 5.0, 0.5, -2.5
#: A term counts as if it had been seen this often at the odds of the corpus before: what is seen seldom says little.
PRIOR = 0.5
#: A shape whose odds to stand with a person are at or below these bits (5 %) is no identifier; it counts as if seen SHAPE_PRIOR times at even odds before.
HIDDEN, SHAPE_PRIOR = -4.25, 5.0
#: Runs of up to this many terms are counted and judged; a person found in so many goes on over further disclosing terms.
TERMS = 5
#: An identifier is right after a name when it begins within this many characters of it, in the same sentence.
NEAR = 40
#: From this length on a line counts as wrapped by its source rather than ended.
WRAP = 45
KINDS = ("email", "phone", "id_number", "address", "person")

# Forms of direct identifiers and words of addresses.
EMAIL = re.compile(
    r"(?<![\w.+\-/@])[\w](?:[\w.+\-]*[\w])?(?:@|\s@\s|\s?[\[(]\s?(?:at|@)\s?[\])]\s?)[^\W_](?:[\w\-]*[^\W_])?"
    r"(?:(?:\.|\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?)[^\W_](?:[\w\-]*[^\W_])?)+", re.I,
)
#: Addresses written in words: both the sign and the dots.
EMAIL_WORDS = re.compile(r"(?<![\w.+\-/@])\w(?:[\w.+\-]*\w)?\sat\s[^\W_](?:[\w\-]*[^\W_])?(?:\sdot\s[^\W_](?:[\w\-]*[^\W_])?)+", re.I)
STREET_TYPES_EN = ("Street", "St.", "St", "Lane", "Row", "Avenue", "Ave.", "Ave", "Yard", "Road", "Rd.", "Rd", "Close", "Court", "Drive", "Way", "Hill", "Square", "Terrace", "Walk", "Crescent", "Gardens", "Mews", "Grove", "Parade", "Alley", "Wharf", "Place")
STREET_TYPES_FR = ("rue", "chemin", "allée", "quai", "avenue", "boulevard", "place", "impasse", "cours", "sentier", "route", "passage", "square", "venelle", "ruelle", "montée", "faubourg", "promenade", "cité")
STREET_TYPES_VI = ("đường", "phố", "ngõ", "ngách", "hẻm")

#: Upper-case letters of the Latin blocks, by rule.
_UPPER = "".join(c for c in map(chr, range(0x41, 0x1F00)) if c.isupper() and unicodedata.name(c, "").startswith("LATIN"))
_CAP = rf"[{_UPPER}](?:[^\W\d_]|[’'\-](?=[^\W\d_]))*"
#: A house number; it begins with its digit, so that the search skips to digits.
_NUM = r"\d(?<![\w/.,\-]\d)(?<!№ \d)\d{0,3}[A-Za-z]?(?:/\d{1,4}[A-Za-z]?)?"
_TOWN = rf"(?:,\s{_CAP}(?:\s{_CAP}){{0,2}})?"
_DISTRICT = re.compile(rf",\s(?i:xã|phường|quận|huyện|thị trấn|thị xã|thành phố|tỉnh)\s{_CAP}(?:\s{_CAP}){{0,2}}")
_ADDR_EN = re.compile(rf"{_NUM},?\s(?:{_CAP}\s){{1,3}}(?i:{'|'.join(re.escape(x) for x in sorted(STREET_TYPES_EN, key=len, reverse=True))})(?!\w)(?:,?\s(?i:Flat|Apt\.?|Unit)\s\w+)?{_TOWN}")
_ADDR_FR = re.compile(rf"{_NUM}(?:\s(?i:bis|ter|quater))?,?\s(?i:{'|'.join(STREET_TYPES_FR)})\s(?:(?i:de la|de l’|de l'|du|des|de|d’|d'|aux|au|à la|à|la|le|les|l’|l')\s?)?{_CAP}{_TOWN}")
_ADDR_VI = re.compile(rf"{_NUM}(?P<lane>\s(?i:{'|'.join(STREET_TYPES_VI[2:])})\s\d{{1,4}}(?:/\d{{1,4}})?)?(?P<type>\s(?i:{'|'.join(STREET_TYPES_VI[:2])}))?\s(?P<name>{_CAP}(?:\s{_CAP}){{0,2}})")
#: A house number with the beginning of a street after it: where addresses are looked for.
_HOUSE = re.compile(
    rf"{_NUM}(?=(?:\s(?i:bis|ter|quater))?,?\s(?:[{_UPPER}]|(?i:{'|'.join(STREET_TYPES_FR + STREET_TYPES_VI)})\s))"
)
_AT = re.compile(r"@|[\[(]\s?[Aa][Tt]\s?[\])]|\s[Aa][Tt]\s(?=[\w\-]+\s[Dd][Oo][Tt]\s)")
_BRACKET_AT = re.compile(r"[\[(]\s?[Aa][Tt]\s?[\])]")
_TOKEN_START = re.compile(r"\S+\s?\Z")
#: Six or more digits with at most two separators between: where phones and identity numbers are looked for.
_CLUSTER = re.compile(r"\d(?:[ .\-()\n]{0,2}\d){5,}")

_ID = [re.compile(p) for p in (
    r"(?<![\w])[A-Z]{1,2}\d{7}(?![\w])",
    r"(?<![\w])[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![\w])",
    r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    r"(?<!\d)(?<!\d[ .\-])[1-9]\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?(?![\d])",
    r"(?<![\w.\-/])[1-9]\d{12}(?:\d{2})?(?![\w])",
)]
#: Digit runs that begin with 0, or a run of nine or twelve digits; sorted out by count and grouping.
_RUN = re.compile(r"(?<![\w/№])(?<!\d[ .\-])0\d(?:[ .\-]?\d)*(?!\w)")
_RUN_WRAPPED = re.compile(r"(?<![\w/№])(?<!\d[ .\-])0\d(?:[ .\-\n]?\d)*(?!\w)")
_PLUS = re.compile(r"\(?\+\d{1,3}\)?(?:[ .\-\n]?\(?\d{1,4}\)?){2,6}")
_US = re.compile(r"(?<![\w.\-])(?:\(\d{3}\)[ \n]?\d{3}[ .\-\n]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w\-])")
_FILE = re.compile(r"\d{4}-\d{4}-\d{3}\Z")

_MAIL_WORD = re.compile(r"[\w.+\-]+")
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
_TYPE_WORDS = frozenset(w.rstrip(".").lower() for w in STREET_TYPES_EN + STREET_TYPES_FR + STREET_TYPES_VI)
_SENTENCE = re.compile(r"\n\n|[.?!]\s")
_SEQ = re.compile(rf"{_CAP}(?:(?:,?[ \n])(?:[A-Z]\.(?=[ \n])|{_CAP}))+")
_TERM = re.compile(rf"\b[A-Z]\.(?=[ \n])|{_CAP}")


@lru_cache(100_000)
def fold(term: str) -> str:
    """A term without case and accents."""
    s = unicodedata.normalize("NFD", term.lower().replace("đ", "d"))
    return "".join(c for c in s if not unicodedata.combining(c))


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _run_kind(s: str) -> str | None:
    n = _digits(s)
    if _FILE.match(s):
        return None
    if n == 12 or (n == 9 and s.isdigit()):
        return "id_number"
    return "phone" if n in (10, 11) else None


def _with_district(text: str, end: int) -> int:
    m = _DISTRICT.match(text, end)
    return m.end() if m else end


def _typed(m: re.Match) -> bool:
    """True when a Vietnamese address names its street with a type word."""
    return bool(m["type"] or m["lane"])


def _numbers(text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Phones and identity numbers around one cluster of digits."""
    found = []
    for m in _PLUS.finditer(text, lo, hi):
        s = m.group()
        if 10 <= _digits(s) <= 13:
            found.append((m.start(), m.end(), "phone"))
        elif _digits(s) > 13:  # ran over a line break into the next number
            cut = s.rfind("\n")
            while cut > 0 and _digits(s[:cut]) > 13:
                cut = s.rfind("\n", 0, cut)
            if cut > 0 and _digits(s[:cut]) >= 10:
                found.append((m.start(), m.start() + cut, "phone"))
    found += [(m.start(), m.end(), "phone") for m in _US.finditer(text, lo, hi)]
    runs: dict[int, tuple[int, int, str]] = {}
    for pat in (_RUN, _RUN_WRAPPED):
        for m in pat.finditer(text, lo, hi):
            kind = _run_kind(m.group().replace("\n", " "))
            if kind and m.start() not in runs:
                runs[m.start()] = (m.start(), m.end(), kind)
    found += list(runs.values())
    for pat in _ID:
        found += [(m.start(), m.end(), "id_number") for m in pat.finditer(text, lo, hi)]
    return found


def forms(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, list[tuple[str, int]]]], list[str]]:
    """(identifiers by form, bare streets, typed street names) of a text, overlaps not settled.

    A bare street is a start with the names it may have, the longest first, each with the end it then has.
    """
    found: list[tuple[int, int, str]] = []
    bare: list[tuple[int, list[tuple[str, int]]]] = []
    typed: list[str] = []
    mail = "@" in text or "dot" in text.lower() or _BRACKET_AT.search(text)
    for at in _AT.finditer(text) if mail else ():
        begin = _TOKEN_START.search(text, max(0, text.rfind("\n", 0, at.start()) + 1), at.start())
        m = (EMAIL_WORDS if at.group()[0].isspace() else EMAIL).search(text, begin.start() if begin else at.start())
        if m and m.start() <= at.start() < m.end():
            found.append((m.start(), m.end(), "email"))
    for c in _CLUSTER.finditer(text):
        found += _numbers(text, max(0, c.start() - 6), min(len(text), c.end() + 4))
    for h in _HOUSE.finditer(text):
        v = _ADDR_VI.match(text, h.start())
        if v and _typed(v):
            typed.append(" ".join(map(fold, v["name"].split())))
        m = _ADDR_EN.match(text, h.start()) or _ADDR_FR.match(text, h.start())
        if m:
            found.append((m.start(), m.end(), "address"))
        elif v and _typed(v):
            found.append((v.start(), _with_district(text, v.end()), "address"))
        elif v:
            terms = v["name"].split()
            names = []
            for k in range(len(terms), 0, -1):
                end = v.start("name") + len(re.match(r"\S+(?:\s\S+){%d}" % (k - 1), v["name"]).group())
                names.append((" ".join(map(fold, terms[:k])), _with_district(text, end)))
            bare.append((v.start(), names))
    return found, bare, typed


def shape_of(kind: str, value: str) -> str:
    """What the corpus counts of a value: its kind with its shape."""
    if kind == "email":
        return "email " + _MAIL_WORD.sub("w", value)
    if kind == "address":
        word = next((w for w in re.findall(r"[^\W\d_]+", value.lower()) if w in _TYPE_WORDS), "")
        return "address " + word
    return f"{kind} " + _LETTER.sub("A", _DIGIT.sub("9", value.replace("\n", " ")))


def settled(found: list, bare: list, streets: frozenset[str] | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of identifiers, not overlapping, in order; bare streets count when their name is in `streets`."""
    found = [tuple(f[:3]) for f in found]
    for start, names in bare if streets else ():
        end = next((e for n, e in names if n in streets), None)
        if end is not None:
            found.append((start, end, "address"))
    out: list[tuple[int, int, str]] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def identifiers(text: str, streets: frozenset[str] | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of direct identifiers of a text, not overlapping, in order."""
    found, bare, _ = forms(text)
    return settled(found, bare, streets)


def sequences(text: str) -> list[list]:
    """[[start, end, folded term, joint]] of every capitalised sequence; initials have the term ''.

    The joint is what stands before the term: 0 the beginning or a blank, 1 a comma, 2 a line end that wasn't a wrap.
    """
    out = []
    for m in _SEQ.finditer(text):
        terms = []
        for t in _TERM.finditer(text, m.start(), m.end()):
            joint = 0
            if terms:
                before = terms[-1][1]
                # A line break joins two terms only where a long line was wrapped.
                if "\n" in text[before : t.start()] and before - text.rfind("\n", 0, before) < WRAP:
                    joint = 2
                elif text[before] == ",":
                    joint = 1
            terms.append([t.start(), t.end(), "" if t.group()[-1] == "." else fold(t.group()), joint])
        out.append(terms)
    return out


def runs(terms: list[list]) -> Iterator[tuple[int, int, list[tuple[str, str]]]]:
    """(first, last + 1, [(term, place)]) of every run of two to TERMS terms of a sequence.

    The place is f(irst), m(iddle) or l(ast); 'Family, Given' counts as 'Given Family'; initials are left out.
    """
    for i in range(len(terms)):
        comma = False
        for k in range(2, TERMS + 1):
            if i + k > len(terms):
                break
            joint = terms[i + k - 1][3]
            if joint == 2 or joint == 1 and k > 2:
                break
            comma = comma or joint == 1
            if comma and k > 3:
                break
            part = terms[i : i + k]
            if not part[0][2] or (not part[-1][2] and not comma):
                continue
            words = [t[2] for t in part]
            if comma:
                words = words[1:] + words[:1]
            words = [w for w in words if w]
            if len(words) < 2:
                continue
            n = len(words) - 1
            yield i, i + k, [(w, "f" if j == 0 else "l" if j == n else "m") for j, w in enumerate(words)]


def facts_of(text: str, tally: dict | None = None) -> dict:
    """What is kept of a text: identifiers by form with their shapes, bare streets, sequences; counts terms, shapes and streets into `tally`."""
    found, bare, typed = forms(text)
    found = [(s, e, k, shape_of(k, text[s:e])) for s, e, k in found]
    seqs = sequences(text)
    if tally is not None:
        marks = settled(found, bare, None)
        starts = [s for s, _, _ in marks]
        for terms in seqs:
            for i, j, run in runs(terms):
                s, e = terms[i][0], terms[j - 1][1]
                x = bisect_left(starts, s)
                if x > 0 and marks[x - 1][1] > s:
                    continue  # inside an identifier
                near = x < len(starts) and e <= starts[x] <= e + NEAR and not _SENTENCE.search(text[e : starts[x]])
                for key in run:
                    tally.setdefault(("term", *key), [0, 0])[0 if near else 1] += 1
        for name in typed:
            tally.setdefault(("street", name, ""), [0, 0])[0] += 1
        ends = sorted([t[-1][1] for t in seqs] + [e for _, e, _ in marks])
        kept = {f[:3]: f[3] for f in found}
        for s, shape in ((s, kept[s, e, k]) for s, e, k in marks):
            x = bisect_right(ends, s) - 1
            near = x >= 0 and s - ends[x] <= NEAR and not _SENTENCE.search(text[ends[x] : s])
            tally.setdefault(("shape", shape, ""), [0, 0])[0 if near else 1] += 1
    return {"found": found, "bare": bare, "seqs": seqs}


_FACTS = "kind string, term string, place string, n_with long, n_without long, facts string"


def examined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One scan of the texts: rows 'doc' (facts as JSON), 'term' and 'street' (counts of a batch), written once."""
    from pagemill.session import cut_lineage

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tally: dict[tuple[str, str, str], list[int]] = {}
            rows = []
            for i, text in zip(b["_i"], b["_t"]):
                if isinstance(text, str) and text:
                    facts = facts_of(text, tally)
                    if any(facts.values()):
                        rows.append((i, "doc", None, None, 0, 0, json.dumps(facts, ensure_ascii=False, separators=(",", ":"))))
            yield pd.DataFrame(rows + [(None, *k, *v, None) for k, v in tally.items()], columns=["id", "kind", "term", "place", "n_with", "n_without", "facts"]).astype({"id": object})

    src = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    return cut_lineage(src.mapInPandas(run, f"id {id_type}, {_FACTS}"))


def disclosure(rows: DataFrame, most: int | None = None) -> tuple[Shared, Shared]:
    """(bits of every term at its place, names of streets) from the counts of `examined`, over all documents."""
    from pagemill.session import cut_lineage

    t = rows.where("kind in ('term', 'shape')").groupBy("kind", "term", "place").agg(F.sum("n_with").alias("w"), F.sum("n_without").alias("wo"))
    t = cut_lineage(t)
    w, wo = t.where("kind = 'term'").agg(F.sum("w"), F.sum("wo")).first()
    w, wo = w or 0, wo or 0

    def bits_of(kind: str, key: Column, prior: float, rate: float, base: float) -> DataFrame:
        odds = (F.col("w") + prior * rate) / (F.col("wo") + prior * (1 - rate)) / F.lit(base)
        return t.where(F.col("kind") == kind).select(key.alias("key"), F.log2(odds).alias("bits"))

    rate = min(max(w / max(1, w + wo), 1e-9), 1 - 1e-9)
    names = bits_of("term", F.concat("term", F.lit(" "), "place"), PRIOR, rate, rate / (1 - rate))
    bits = names.unionByName(bits_of("shape", F.concat(F.lit("#"), "term"), SHAPE_PRIOR, 0.5, 1.0))
    streets = rows.where("kind = 'street'").select(F.col("term").alias("name")).distinct()
    return Shared(bits, "key", ["key", "bits"], most), Shared(cut_lineage(streets), "name", ["name"], most)


def persons(seqs: list, bits: dict[str, float], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of capitalised terms whose disclosure exceeds the threshold; the best of overlapping ones."""
    cand = []
    for terms in seqs:
        for i, j, run in runs(terms):
            b = [bits.get(f"{t} {place}", 0.0) for t, place in run]
            if b[0] > FIRST and sum(b) >= THRESHOLD and min(b) > WORST:
                while j - i >= TERMS and j < len(terms) and terms[j][3] == 0 and terms[j][2] and min(bits.get(terms[j][2] + " l", 0.0), bits.get(terms[j - 1][2] + " m", 0.0)) > 0:
                    j += 1
                s, e = terms[i][0], terms[j - 1][1]
                if not any(x < e and s < y for x, y, _ in taken):
                    cand.append((sum(b) + 0.01 * (e - s), s, e))
    out: list[tuple[int, int, str]] = []
    for _, s, e in sorted(cand, reverse=True):
        if not any(x < e and s < y for x, y, _ in out):
            out.append((s, e, "person"))
    return out


def judged(facts: dict, bits: dict[str, float], streets: frozenset[str]) -> list[tuple[int, int, str]]:
    """All mentions of the text that the facts are of, in order."""
    ids = settled([f for f in facts["found"] if bits.get("#" + f[3], 0.0) > HIDDEN], facts["bare"], streets)
    return sorted(ids + persons(facts["seqs"], bits, ids))


def mentions_of(text: str | None, bits: dict[str, float], streets: frozenset[str]) -> list[tuple[int, int, str]]:
    """All mentions of one text, in order."""
    return judged(facts_of(text), bits, streets) if isinstance(text, str) and text else []


def _asked_terms(row: dict) -> set[str]:
    facts = json.loads(row["facts"])
    return {f"{t[2]} {p}" for terms in facts["seqs"] for t in terms if t[2] for p in "fml"} | {"#" + f[3] for f in facts["found"]}


def _asked_streets(row: dict) -> set[str]:
    return {n for _, names in json.loads(row["facts"])["bare"] for n, _ in names}


def _streets(rows: list[tuple]) -> frozenset[str]:
    return frozenset(r[0] for r in rows)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """doc_id, kind, start_pos, end_pos of every mention."""
    rows = examined(docs, id_col, text_col)
    bits, streets = disclosure(rows, most)
    own = rows.where("kind = 'doc'").select("id", "facts", F.xxhash64("id", "facts").alias("_r"))
    own = streets.attach(bits.attach(own, ["_r"], _asked_terms, "_bits"), ["_r"], _asked_streets, "_streets")
    get_bits, get_streets = bits.sender(dict, docs.sparkSession), streets.sender(_streets, docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, s, e) for i, f, x, y in zip(b["id"], b["facts"], b["_bits"], b["_streets"]) for s, e, k in judged(json.loads(f), get_bits(x), get_streets(y))]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "start_pos", "end_pos"])

    return own.mapInPandas(run, f"doc_id {id_type}, kind string, start_pos int, end_pos int")


def redact(docs: DataFrame, text_col: str = "text", out_col: str = "redacted", most: int | None = None) -> DataFrame:
    """docs with `out_col`: every mention replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [PERSON].

    The forms are looked for again in the second scan, which is cheaper at scale than a shuffle of all texts.
    """
    bits, streets = disclosure(examined(docs.select(F.lit(0).alias("_n"), F.col(text_col).alias("_text")), "_n", "_text"), most)
    spark = docs.sparkSession

    def clean(text, b, s):
        out, last = [], 0
        for start, end, k in mentions_of(text, b, s):
            out += [text[last:start], f"[{k.upper()}]"]
            last = end
        return text if not isinstance(text, str) else "".join(out) + text[last:]

    get_bits, get_streets = bits.sender(dict, spark), streets.sender(_streets, spark)
    if bits.rows is not None and streets.rows is not None:

        @F.pandas_udf(T.StringType())
        def apply(s: pd.Series) -> pd.Series:
            return s.map(lambda t: clean(t, get_bits(None), get_streets(None)), na_action="ignore")

        return docs.withColumn(out_col, apply(F.col(text_col)))

    # Beyond the size for the workers: the entries a text asks for come to it by its hash.
    def facts(row: dict) -> dict:
        return {"facts": json.dumps(facts_of(row["_text"] or ""))}

    texts = docs.select(F.xxhash64(text_col).alias("_r"), F.col(text_col).alias("_text")).where(F.col(text_col).isNotNull()).dropDuplicates(["_r", "_text"])
    own = bits.attach(texts, ["_r"], lambda r: _asked_terms(facts(r)), "_bits")
    own = streets.attach(own, ["_r"], lambda r: _asked_streets(facts(r)), "_streets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_out=[clean(t, get_bits(x), get_streets(y)) for t, x, y in zip(b["_text"], b["_bits"], b["_streets"])])[["_text", "_out"]]

    done = own.mapInPandas(run, "_text string, _out string")
    return docs.join(done, docs[text_col] == done["_text"], "left").select(*[docs[c] for c in docs.columns], done["_out"].alias(out_col))
