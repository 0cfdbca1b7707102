"""What scanned pages have in common: the lexicon of a corpus, misread letters, page numbers, running lines.

The lexicon is counted over all block texts and kept as a table. What belongs to it is decided by comparing
counts of related forms (a form with the word it misreads, a piece with the words it is cut from), never
with the size of the corpus: other text beside it changes nothing. Tables that pages look things up
in are measured (`Shared`): up to MOST_BYTES they are sent to the workers, beyond that they are joined to the pages,
each page getting the entries it asks for; both ways give the same result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import cut_lineage

MIN_COUNT = 3
#: A form that turns into a word this many times as frequent, by undoing misreadings, is noise.
NOISE_RATIO = 8
#: A form is a piece of longer words when those that begin or end with it are together this many times as frequent.
PIECE_RATIO = 300
#: Up to this measured size a table is sent to the workers.
MOST_BYTES = 32 << 20
SALT = 16

# What scanners read (left) for what is printed (right).
CONFUSIONS = (
    ("ii", "u"), ("li", "h"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("c", "e"), ("f", "t"), ("m", "rn"), ("u", "ll"), ("d", "cl"),
    ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("0", "o"), ("9", "g"), ("9", "q"), ("5", "s"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("$", "s"), ("@", "a"),
)
#: Every letter as the simplest shapes it may be read as; whatever is confused has one shape.
_SIMPLE = {"e": "c", "f": "t", "l": "i", "1": "i", "!": "i", "|": "i", "0": "o", "9": "g", "q": "g", "5": "s", "$": "s", "6": "b", "8": "b", "3": "c", "4": "a", "@": "a", "7": "t"}
_COMPOUND = {"m": "rri", "n": "ri", "h": "ii", "u": "ii", "d": "ci", "w": "vv"}
_SHAPES = str.maketrans(_SIMPLE | _COMPOUND)
HYPHENS = "-¬­‐‑"
_RUN = re.compile(r"(?:[^\W_]|[!|$@](?=[^\W\d_]))++!?")
_ANY_LETTER = re.compile(r"[^\W\d_]")
_CLASSLIKE = re.compile(r"\d+[^\W\d_]{1,2}\d*\Z|[^\W\d_]\d+\Z")
_NUMBERLIKE = re.compile(r"[\dlIiOo|!]+\Z")


def tokens(text: str) -> list[re.Match]:
    """The words of a text as a scanner may have read them: runs of letters with digits or signs among them, one letter at least."""
    return [m for m in _RUN.finditer(text) if _ANY_LETTER.search(m.group())]


def shape(word: str) -> str:
    """The word with every letter as its simplest shapes: equal for a word and all its misreadings, and additive over parts."""
    return word.lower().translate(_SHAPES)


def shape_col(c: Column) -> Column:
    """`shape` on the JVM."""
    c = F.translate(F.lower(c), "".join(_SIMPLE), "".join(_SIMPLE.values()))
    for k, v in _COMPOUND.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def misreads(word: str, read: str) -> int | None:
    """How many misreadings turn the printed `word` into `read`; None if none do. Exact, over both whole words."""
    if word == read:
        return 0
    state = {0: {0: 0}}  # position in word -> {position in read: misreadings}
    for i in range(len(word)):
        for j, k in sorted(state.pop(i, {}).items()):
            if j < len(read) and word[i] == read[j]:
                at = state.setdefault(i + 1, {})
                at[j + 1] = min(k, at.get(j + 1, k))
            for bad, good in CONFUSIONS:
                if word.startswith(good, i) and read.startswith(bad, j):
                    at = state.setdefault(i + len(good), {})
                    at[j + len(bad)] = min(k + 1, at.get(j + len(bad), k + 1))
    return state.get(len(word), {}).get(len(read))


class Trie:
    """A trie kept as its sorted keys: a node is the run of keys with one prefix, a step narrows the run by binary search."""

    def __init__(self, keys: Iterable[str]):
        self.keys = sorted(set(keys))

    def root(self) -> tuple[int, int, str]:
        """(first key, last key + 1, prefix) of the root."""
        return 0, len(self.keys), ""

    def step(self, node: tuple[int, int, str], s: str) -> tuple[int, int, str] | None:
        """The node reached by the characters `s`, or None."""
        lo, hi, prefix = node
        prefix += s
        lo = bisect_left(self.keys, prefix, lo, hi)
        if lo == hi or not self.keys[lo].startswith(prefix):
            return None
        return lo, bisect_left(self.keys, prefix + "\U0010ffff", lo, hi), prefix

    def ends(self, node: tuple[int, int, str]) -> bool:
        """True when a key ends at the node."""
        return self.keys[node[0]] == node[2]

    def is_inner(self, s: str) -> bool:
        """True when `s` is a proper prefix of a key."""
        node = self.step(self.root(), s) if self.keys else None
        return node is not None and (node[1] - node[0] > 1 or not self.ends(node))


class Lexicon:
    """Known words with counts, their trie, and the words of each shape."""

    def __init__(self, counts: dict[str, int]):
        groups: dict[str, list[str]] = {}
        for w in counts:
            groups.setdefault(shape(w), []).append(w)
        self.counts: dict[str, int] = {}
        self.shapes: dict[str, list[str]] = {}
        for s, words in groups.items():
            top = max(words, key=lambda w: (counts[w], w))
            kept = [w for w in words if counts[w] * NOISE_RATIO > counts[top] or misreads(top, w) is None]
            self.shapes[s] = kept
            self.counts.update((w, counts[w]) for w in kept)
        self._tries: dict[str, Trie] = {}
        self.repair = lru_cache(100_000)(self._repair)

    def __getstate__(self):
        return self.counts

    def __setstate__(self, counts):
        self.__init__(counts)

    def __contains__(self, word: str) -> bool:
        return word in self.counts

    @property
    def trie(self) -> Trie:
        """The vocabulary trie."""
        if "words" not in self._tries:
            self._tries["words"] = Trie(self.counts)
        return self._tries["words"]

    @property
    def shape_trie(self) -> Trie:
        """The trie of the words' shapes."""
        if "shapes" not in self._tries:
            self._tries["shapes"] = Trie(self.shapes)
        return self._tries["shapes"]

    def readings(self, token: str) -> list[tuple[int, str]]:
        """(misreadings, word) of the known words that `token` may stand for, whatever their number."""
        low = token.lower()
        return [(k, w) for w in self.shapes.get(shape(low), ()) if (k := misreads(w, low)) is not None]

    def best(self, token: str) -> tuple[int, str] | None:
        """The reading with the fewest misreadings, then the most frequent word."""
        found = [(k, w) for k, w in self.readings(token) if len(w) > 1]
        return min(found, key=lambda r: (r[0], -self.counts[r[1]], r[1])) if found else None

    def _repair(self, token: str) -> str | None:
        """The known word that was misread as `token`; None for known words, numbers and unknown words."""
        low = token.lower()
        if low in self.counts:
            return None
        if low.endswith("!") and (low[:-1] in self.counts or len(low) < 3):
            return None
        if not repairable(token):
            return None
        found = self.best(token)
        return found[1] if found and found[0] else None


def repairable(token: str) -> bool:
    """False for single signs, numbers and names of classes, which may look like misread words."""
    return len(token) > 1 and not _NUMBERLIKE.match(token) and not _CLASSLIKE.match(token)


# Tables that pages look things up in --------------------------------------------------------


class Shared:
    """A table that rows look things up in by `key`, at the workers or by a join, as its measured size says."""

    def __init__(self, table: DataFrame, key: str, columns: list[str], most: int | None = None):
        self.table, self.key, self.columns = table, key, columns
        size = table.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) + 16 for c in columns), F.lit(0)))).first()[0] or 0
        self.rows = [tuple(r) for r in table.select(*columns).collect()] if size <= (MOST_BYTES if most is None else most) else None

    def attach(self, rows: DataFrame, ids: list[str], asks: Callable[[dict], Iterable[str]], out: str) -> DataFrame:
        """`rows` (unique by `ids`) with `out`: null where the workers have the table, else the entries whose keys the row asks for."""
        kind = f"array<struct<{', '.join(f'{c}:{t}' for c, t in self.table.select(*self.columns).dtypes)}>>"
        if self.rows is not None:
            return rows.withColumn(out, F.lit(None).cast(kind))
        ddl = ", ".join(f"{c} {t}" for c, t in rows.select(*ids).dtypes)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(*(r[i] for i in ids), k) for r in b.to_dict("records") for k in {*asks(r)}]
                yield pd.DataFrame(found, columns=[*ids, "_k"])

        # A frequent key is asked for by nearly every row, so keys are salted by the asking row.
        asked = rows.mapInPandas(run, f"{ddl}, _k string").withColumn("_s", F.pmod(F.xxhash64(*ids), F.lit(SALT)).cast("int"))
        own = self.table.select(F.col(self.key).alias("_k"), F.struct(*self.columns).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"))
        got = asked.join(own, ["_k", "_s"]).groupBy(*ids).agg(F.collect_list("_v").alias(out))
        return rows.join(got, ids, "left")

    def sender(self, make: Callable[[list[tuple]], object], spark):
        """A function for the workers: the table's object, made once from all rows or from the entries of one row."""
        bc = spark.sparkContext.broadcast(make(self.rows)) if self.rows is not None else None

        def get(entries):
            if bc is not None:
                return bc.value
            return make([] if entries is None else [tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in entries])

        return get


# The lexicon --------------------------------------------------------------------------------

_DIVIDED = re.compile(rf"[^\W\d_]+[{HYPHENS}]\n[^\W\d_]+")
_OMITTED = re.compile(r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|\.\.\.)\s*\Z")
_NO_WORD = re.compile(r"[^\w!|$@]+|_")


def count_words(texts: Iterable[str | None]) -> Counter:
    """Lower-case words of texts with their number of uses; words divided over lines and the first and last chunk of a text are left out.

    Texts are cut at white space and the chunks counted; only distinct chunks are taken apart.
    """
    from pagemill.llm.canon import canonical

    chunks: Counter = Counter()
    for t in texts:
        if not isinstance(t, str) or not t:
            continue
        if "\n" in t:
            t = _DIVIDED.sub(" ", canonical(t))
        if t[-1] in "….])":
            t = _OMITTED.sub("", t)
        chunks.update(t.split()[1:-1])
    words: Counter = Counter()
    for c, n in chunks.items():
        # A consistent form never reaches over white space, so it is made of the distinct chunks.
        for w in _NO_WORD.split(canonical(c).lower()):
            if w and w.isalpha():
                words[w] += n
    return words


def counted(pages: DataFrame) -> DataFrame:
    """(kind, key, n) of one scan of pages: kind 'word', and 'line', the masked lines of headers and footers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines: Counter = Counter()
            for order, texts, labels in zip(b["page_order"], b["texts"], b["labels"]):
                order = None if order is None or order != order else int(order)
                for t, label in zip(texts, labels):
                    if label in EDGE_LABELS and isinstance(t, str):
                        lines.update(edge_masks(t, order))
            words = count_words(t for texts in b["texts"] for t in texts)
            rows = [("word", w, n) for w, n in words.items()] + [("line", m, n) for m, n in lines.items()]
            yield pd.DataFrame(rows, columns=["kind", "key", "n"])

    return page_rows(pages).select("page_order", "texts", "labels").mapInPandas(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@F.pandas_udf(T.BooleanType())
def _misread(word: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([misreads(a, b) is not None for a, b in zip(word, read)], dtype=bool)


def known_words(words: DataFrame) -> DataFrame:
    """(word, n, shape) of the words in (word, n) that are seen MIN_COUNT times and are neither misread nor cut from others.

    Both tests compare counts of related forms, so they come out alike at every size of the corpus. They are
    joins over distinct words: each with the most frequent word of its shape, and with the proper prefixes
    and suffixes of all words.
    """
    w = words.where(F.col("n") >= MIN_COUNT).withColumn("shape", shape_col(F.col("word")))
    top = F.first(F.struct("word", "n")).over(Window.partitionBy("shape").orderBy(F.desc("n"), F.desc("word")))
    w = w.withColumn("top", top)
    rival = (F.col("top.word") != F.col("word")) & (F.col("top.n") >= NOISE_RATIO * F.col("n"))
    judged = w.withColumn("bad", F.when(rival, _misread(F.when(rival, F.col("top.word")).otherwise(""), "word")).otherwise(False))
    clean = cut_lineage(judged.where("not bad").select("word", "n", "shape"))
    size = F.length("word")
    inner = F.sequence(F.lit(1), size - 1)
    parts = clean.where(size > 1).select("n", F.explode(F.flatten(F.array(F.transform(inner, lambda i: F.left("word", i)), F.transform(inner, lambda i: F.right("word", i))))).alias("word"))
    of = parts.groupBy("word").agg(F.sum("n").alias("above"))
    return clean.join(of, "word", "left").where(F.coalesce("above", F.lit(0)) < PIECE_RATIO * F.col("n")).select("word", "n", "shape")


def lexicon_of(counts: DataFrame) -> DataFrame:
    """The known words of `counted`, written once."""
    return cut_lineage(known_words(counts.where("kind = 'word'").select(F.col("key").alias("word"), "n")))


def shared_lexicon(words: DataFrame, most: int | None = None) -> Shared:
    """The lexicon as a table to look things up in, by shape."""
    return Shared(words, "shape", ["word", "n"], most)


def make_lexicon(rows: list[tuple]) -> Lexicon:
    return Lexicon(dict(rows))


# Page numbers -------------------------------------------------------------------------------

_NUM = r"[\dlIiOoSsB|!]{1,5}|[ivxlcdm]{1,8}|[IVXLCDM]{1,8}"
#: A page number with its word and total, as a whole line or at the end of a running line.
PAGE_NUMBER = re.compile(
    rf"[\s\-–—·•\[(|]*(?:(?:[Pp]\s*[a@4]\s*[gq9]\s*[ec3]|PAGE|PACE|[Tt][rn]+[a4]?(?:n|ri)[gq9]|TRANG|[Tt]r|[Pp]|[Pp]g)\b\.?\s*)?"
    rf"(?P<n>{_NUM})(?:\s*(?:/|\||of|0f|sur|tr[êe](?:n|ri)|TRÊN|OF|SUR|trôn)\s*(?P<t>{_NUM}))?[\s\-–—·•\])]*\Z"
)
_TAIL = re.compile(r"(?<!\s)(?:\s++[|–—-]\s+|\s{2,}|\t)(?=\S)")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8"})


def numerals(s: str) -> set[int]:
    """The numbers a numeral may stand for, in any numerals, read well or badly."""
    out = set()
    d = s.translate(_DIGITS)
    if d.isdigit():
        out.add(int(d))
    low = s.lower().replace("1", "i").replace("!", "i").replace("|", "i")
    if low and all(c in _ROMAN for c in low):
        v = [_ROMAN[c] for c in low]
        out.add(sum(-a if a < b else a for a, b in zip(v, v[1:] + [0])))
    return out


#: What the match of PAGE_NUMBER may end with, besides digits.
_NUMBER_ENDS = frozenset("lIiOoSsB|!ivxcdmVXLCDM-–—·•])")


def ends_like_number(line: str) -> bool:
    """False for lines that can't end in a page number, as their last sign shows."""
    s = line.rstrip()
    return bool(s) and (s[-1] in _NUMBER_ENDS or s[-1].isdigit())


def is_page_number(line: str, page_order: int | None) -> bool:
    """True when the line is nothing but the page's own number."""
    m = PAGE_NUMBER.match(line.strip()) if page_order is not None and ends_like_number(line) else None
    return bool(m) and page_order in numerals(m["n"])


def split_tail(line: str, page_order: int | None) -> tuple[str, str]:
    """(line without the page number after it, that page number or '')."""
    if page_order is None or not ends_like_number(line):
        return line, ""
    for m in _TAIL.finditer(line):
        tail = line[m.end():]
        if is_page_number(tail, page_order):
            return line[: m.start()].rstrip(), tail
    return line, ""


_SIMPLE_BYTES = bytes.maketrans("".join(_SIMPLE).encode(), "".join(_SIMPLE.values()).encode())


def skeleton(line: str) -> str:
    """The line apart from letter case, spacing and misread characters.

    `shape` without blanks, over the bytes of the line, since only ASCII characters change.
    """
    out = line.lower().encode("utf-8", "surrogatepass").translate(_SIMPLE_BYTES, b" \t\n\r\x0b\x0c")
    for k, v in _COMPOUND.items():
        out = out.replace(k.encode(), v.encode())
    return out.decode("utf-8", "surrogatepass")


# Running-line templates ---------------------------------------------------------------------

EDGE_LABELS = ("Page-header", "Page-footer")
#: The top and bottom of a page are its first and last two blocks, and of these the first and last two lines.
EDGE_BLOCKS = EDGE_LINES = 2
_NUMBERS = re.compile(r"(?<![^\W_])(?<![|!])[lIO|!]*+\d[\dlIO|!]*+(?![^\W_])")


def masked(line: str) -> str:
    """The skeleton of a line with its numbers masked, so that equal layouts of different exams meet."""
    return skeleton(_NUMBERS.sub("#", line))


class Masks(frozenset):
    """A set of masked lines; `longest` is the length of the longest one."""

    longest: int | None = None

    def holds(self, line: str) -> bool:
        """True when the masked form of a line is in the set; lines that are too long in any case aren't masked first."""
        if self.longest is not None and len(line) - sum(map(line.count, _SHRINKING)) > self.longest:
            return False
        return masked(line) in self


#: Characters that masking may take away; every other one leaves one at least.
_SHRINKING = " \t0123456789lIO|!"


def edge_masks(text: str, order: int | None) -> list[str]:
    """The masked lines of one header or footer text, page numbers left out."""
    from pagemill.llm.canon import canonical

    lines = (x.strip() for x in canonical(text).split("\n"))
    masks = (masked(split_tail(x, order)[0]) for x in lines if x and not is_page_number(x, order))
    return [m for m in masks if len(m) >= 4]


def shared_templates(counts: DataFrame, most: int | None = None) -> Shared:
    """Masked lines seen twice or more in headers and footers, as a table to look lines up in."""
    return Shared(cut_lineage(counts.where("kind = 'line' and n >= 2").select(F.col("key").alias("mask"))), "mask", ["mask"], most)


def make_templates(rows: list[tuple]) -> Masks:
    out = Masks(r[0] for r in rows)
    out.longest = max(map(len, out), default=0)
    return out


def template_asks(row: dict) -> set[str]:
    """The masks that `page_body` may look up for a page."""
    seen: set[str] = set()

    class Asked(Masks):
        def __contains__(self, mask):
            seen.add(mask)
            return False

    # A line that goes uncovers no other one, so every mask is asked for when none is known.
    page_body(row["texts"], row["labels"], _order(row["page_order"]), Asked())
    return seen


def _order(value) -> int | None:
    return None if value is None or value != value else int(value)


def page_body(texts, labels, order: int | None, templates: Masks) -> list[tuple[int, str, str, bool]]:
    """(block_idx, label, text without edge lines, is an edge block) of the blocks of a page with text.

    Edge lines (running lines by template, page numbers) are those at the top or bottom of the page: the first and last
    EDGE_LINES lines of the first and last EDGE_BLOCKS blocks. Texts come back in their consistent form.
    """
    from pagemill.llm.canon import canonical

    blocks = [(i, c or "", canonical(t)) for i, (t, c) in enumerate(zip(texts, labels)) if isinstance(t, str) and t.strip()]
    out = []
    for j, (i, label, text) in enumerate(blocks):
        if EDGE_BLOCKS <= j < len(blocks) - EDGE_BLOCKS:
            out.append((i, label, text, False))
            continue
        lines = text.split("\n")
        keep = []
        for q, line in enumerate(lines):
            s = line.strip()
            at_edge = (q < EDGE_LINES or q >= len(lines) - EDGE_LINES) and bool(s)
            if not (at_edge and (is_page_number(s, order) or templates.holds(split_tail(s, order)[0]))):
                keep.append(line)
        body = "\n".join(keep)
        gone = not body.strip() or label in EDGE_LABELS
        out.append((i, label, text if gone else body, gone))
    return out


def page_rows(pages: DataFrame) -> DataFrame:
    """exam_id, page_id, page_order, source and the block texts and labels (null entries kept in place)."""
    from pagemill.sources.tables import norm_key

    lay = F.col("ocr_text.layouts")
    return pages.where(F.size(lay) > 0).select(
        norm_key("exam_id").alias("exam_id"), F.col("id").alias("page_id"), F.col("page_order").cast("int").alias("page_order"),
        F.lower(F.regexp_extract(F.col("file_path"), r"\.([A-Za-z0-9]+)\s*$", 1)).alias("source"),
        F.transform(lay, lambda b: b["text"]).alias("texts"), F.transform(lay, lambda b: b["category"]).alias("labels"),
    )
