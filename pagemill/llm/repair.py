"""Noise in text from scanned pages: found per block, and repaired into continuous paragraphs.

Kinds of noise: `hyphen` (a word divided over two lines or blocks), `char` (a word with misread
characters), `running` (a line that returns at the top or bottom of at least MIN_PAGES and a third
of an exam's pages) and `page_number`.

Method: the lines of a block are joined to one character stream and segmented into words jointly, by
dynamic programming over character positions with splits, merges, confusions and hyphens against the corpus
lexicon (see `Decoder`); the repairs on the cheapest path are the noise found. Known words that are misreadings of
others are told by the word before them, from counts of such pairs. Paragraph boundaries between lines are
chosen by a second dynamic programme over line ends.

At scale: pages are judged alone (one row each, no shuffle). Lines that return are counted by
(exam, line) with map-side combine; only lines that qualify go back to the pages, salted, since one
exam may hold a third of all pages. Words divided over two pages meet by a join on (exam, page). The lexicon is
sent to the workers or joined to the pages, as its measured size says (`scan.Shared`).

Defined results: null and empty texts have no noise; null ids or page numbers only disable what
depends on them; each (page, block, kind) comes once however often a page row was delivered; very long
texts and lines are processed whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.canon import canonical
from pagemill.llm.scan import (
    EDGE_BLOCKS, EDGE_LABELS, EDGE_LINES, HYPHENS, NOISE_RATIO, Lexicon, Shared, counted, is_page_number, lexicon_of, make_lexicon, misreads, page_rows, repairable, shape, shared_lexicon, skeleton, split_tail, tokens,
)
from pagemill.session import cut_lineage
from pagemill.sources.tables import norm_key

MIN_PAGES = 3
SALT = 16
_BREAKISH = re.compile(rf"(?<=[^\W_])[{HYPHENS}][ \t]*\n[ \t]*")
_HYPHEN_SET = frozenset(HYPHENS)
_END = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*\Z")
_HEAD = re.compile(r"\s*([^\W\d_]+)")
_FIRST = re.compile(r"\W*([^\W_])")
_PAIR = re.compile(r"[^\W\d_]+")


def joins(a: str, b: str, lex: Lexicon) -> str | None:
    """What a word divided into a and b is: the known word, or None if it isn't one word."""
    w = (a + b).lower()
    if a.isdigit() or b.isdigit() or (b[0].isupper() and not a.isupper()):
        return None
    if w in lex:
        return w
    r = lex.repair(a + b)
    if r:
        return r
    # A rare word: both halves unknown, or one of them no word of its own.
    return w if len(w) > 3 and (a.lower() not in lex or b.lower() not in lex) and not (a.lower() in lex and lex.repair(b)) else None


# Prices on a path, in the unit of a quarter of a word's negative log frequency.
_UNKNOWN, _UNKNOWN_LETTER, _PLAIN_LETTERS = 12.0, 0.5, 12  # an unknown word, and each of its letters beyond a dozen
_CONFUSED, _CONFUSED_AGAIN = 3.0, 0.5
_JOINED = 1.0
_MERGED = 3.0
_SPLIT = 5.0
_LEFT_OPEN = 3.0
_MARK = "\ue000"  # stands for a hyphen at a line end in the de-lined stream
_EDGE = "*.,;:?!()«»\"'’"


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[0].isupper() else word


class Decoder:
    """Joint word segmentation of de-lined text against a lexicon; verdicts on pieces are remembered, within a bound.

    The lines of a text are joined to one stream. Where every piece between blanks is an exact known word, the
    text itself is the cheapest path. Every other stretch, with a piece on either side, is decoded as a lattice over
    its characters: state p is 'the first p letters are segmented'. From p the trie of the words' shapes is
    walked, which allows any number of confusions; blanks on the way are merges, line-end hyphens are joins, an end inside
    a piece is a split. A token may also stay as it is, as an unknown word. Costs are negative log
    frequencies, with a price for each repair.
    """

    def __init__(self, lex: Lexicon, most: int = 200_000):
        self.lex, self.most = lex, most
        self.total = sum(lex.counts.values()) or 1
        self.known_: dict[str, bool] = {}
        self.done_: dict[str, tuple[str, frozenset[str]]] = {}

    def _word(self, w: str) -> float:
        return math.log(self.total / self.lex.counts[w]) / 4

    def known(self, piece: str) -> bool:
        """True for a piece made of known words, numbers and signs."""
        v = self.known_.get(piece)
        if v is None:
            if len(self.known_) >= self.most:
                self.known_.clear()
            v = self.known_[piece] = _MARK not in piece and all(self._fine(m.group()) for m in tokens(piece))
        return v

    def _fine(self, token: str) -> bool:
        """A known word, with an exclamation mark perhaps, or a number or name of a class."""
        low = token.lower()
        return low in self.lex or token[-1] == "!" and (low[:-1] in self.lex or len(low) < 3) or not token.isalpha() and not repairable(token)

    def _stretch(self, s: str) -> tuple[str, frozenset[str]]:
        """(repaired text, kinds of repairs) of a stretch that isn't an exact path."""
        v = self.done_.get(s)
        if v is None:
            if len(self.done_) >= self.most:
                self.done_.clear()
            v = self.done_[s] = self._decoded(s)
        return v

    def _decoded(self, s: str) -> tuple[str, frozenset[str]]:
        spans = []
        for m in tokens(s):
            tok = m.group()
            # A sign at the end that may be a letter or an exclamation mark.
            spans.append((m.start(), m.end() - (tok[-1] == "!" and (tok[:-1].lower() in self.lex or len(tok) < 3))))
        out, kinds, at = [], set(), 0
        k = 0
        while k < len(spans):
            run = [spans[k]]
            while k + 1 < len(spans) and s[run[-1][1] : spans[k + 1][0]] in (" ", _MARK, _MARK + " "):
                k += 1
                run.append(spans[k])
            k += 1
            text, found = self._run([s[a:b] for a, b in run], [s[a[1] : b[0]] for a, b in zip(run, run[1:])])
            out += [s[at : run[0][0]], text]
            kinds |= found
            at = run[-1][1]
        out.append(s[at:])
        return "".join(out).replace(_MARK + " ", "-").replace(_MARK, "-"), frozenset(kinds)

    def _run(self, tokens: list[str], glue: list[str]) -> tuple[str, set[str]]:
        """The cheapest segmentation of tokens with blanks or line-end hyphens between them."""
        letters = "".join(tokens)
        start, n = [0], len(letters)
        for t in tokens:
            start.append(start[-1] + len(t))
        bound = {p: i for i, p in enumerate(start)}  # position -> token that begins there
        marked = {start[i + 1] for i, g in enumerate(glue) if g[0] == _MARK}
        # Over a hyphen no capital follows a small letter.
        closed = {p for p in marked if letters[p].isupper() and not tokens[bound[p] - 1].isupper()}
        trie = self.lex.shape_trie
        best: list[tuple[float, int, str, frozenset[str]]] = [(math.inf, -1, "", frozenset())] * (n + 1)
        best[0] = (0.0, -1, "", frozenset())

        def put(p: int, q: int, cost: float, word: str, kinds: set[str]) -> None:
            cost += best[p][0] + (0.0 if q in bound else _SPLIT) + (_LEFT_OPEN if q in marked else 0.0)
            if cost < best[q][0] - 1e-9:
                best[q] = (cost, p, word, frozenset(kinds))

        for p in range(n):
            if best[p][0] == math.inf:
                continue
            if p in bound:
                # Tokens as they are, also joined over hyphens: unknown words.
                i, joined = bound[p], 0
                while True:
                    q = start[i + 1]
                    word = letters[p:q]
                    cost = self._word(word.lower()) if word.lower() in self.lex else _UNKNOWN + _UNKNOWN_LETTER * max(0, len(word) - _PLAIN_LETTERS)
                    put(p, q, cost + _JOINED * joined, word, {"hyphen"} if joined else set())
                    if q not in marked or q in closed:
                        break
                    i, joined = i + 1, joined + 1
            node, gaps, hyphens = trie.root() if trie.keys else None, 0, 0
            for q in range(p, n):
                if q > p and q in bound:
                    if q in closed:
                        break
                    gaps, hyphens = gaps + (q not in marked), hyphens + (q in marked)
                node = trie.step(node, shape(letters[q])) if node else None
                if node is None:
                    break
                if not trie.ends(node) or q - p < 1 or (q + 1 not in bound and n - q - 1 < 2):
                    continue
                self._arcs(p, q + 1, letters, tokens, bound, trie.keys[node[0]], gaps, hyphens, put)
        words, kinds, q = [], set(), n
        while q > 0:
            _, p, word, found = best[q]
            sep = "" if q == n else " " if q not in bound else "-" if q in marked else " "
            words.append(word + sep)
            kinds |= found
            q = p
        return "".join(reversed(words)), kinds

    def _arcs(self, p, q, letters, tokens, bound, key, gaps, hyphens, put) -> None:
        read = letters[p:q]
        whole = p in bound and q in bound
        exact = read.lower() in self.lex
        if gaps and whole and all(t.lower() in self.lex for t in tokens[bound[p] : bound[q]]):
            return
        for w in self.lex.shapes.get(key, ()):
            k = 0 if w == read.lower() else misreads(w, read.lower())
            if k is None or k and (exact or len(w) < 2 or not repairable(read)) or not whole and len(w) < 2:
                continue
            cost = self._word(w) + (_CONFUSED + _CONFUSED_AGAIN * (k - 1) if k else 0.0) + _MERGED * gaps + _JOINED * hyphens
            put(p, q, cost, _cased(w, read) if k else read, ({"char"} if k else set()) | ({"hyphen"} if hyphens else set()))

    def stretches(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """(pieces of the de-lined text, [first, end) of the stretches to decode)."""
        stream = _BREAKISH.sub(_MARK + " ", text) if "\n" in text else text
        pieces = stream.split()
        seen = self.known_.get
        odd = [i for i, p in enumerate(pieces) if not seen(p) and not self.known(p)]
        out: list[tuple[int, int]] = []
        k = at = 0
        while k < len(odd):
            lo, hi = odd[k], odd[k] + 1
            while k + 1 < len(odd) and odd[k + 1] <= hi + 1:
                k += 1
                hi = odd[k] + 1
            k += 1
            lo, hi = max(at, lo - 1), min(len(pieces), hi + 1)
            out.append((lo, hi - (hi == len(pieces) and self._broken(pieces[-1]))))
            at = hi
        return pieces, out

    def decode(self, text: str, want_text: bool = True) -> tuple[str, set[str]]:
        """(the repaired text as one line, the kinds of noise that were repaired: hyphen, char)."""
        pieces, todo = self.stretches(text)
        kinds: set[str] = set()
        out: list[str] = []
        at = 0
        for lo, hi in todo:
            if lo == hi:
                continue
            repaired, found = self._stretch(" ".join(pieces[lo:hi]))
            kinds |= found
            out += pieces[at:lo]
            out.append(repaired)
            at = hi
        if not want_text:
            return "", kinds
        return " ".join(out + pieces[at:]).replace(_MARK + " ", "-").replace(_MARK, "-"), kinds

    def _broken(self, last: str) -> bool:
        """The last piece is the beginning of a word, broken off: no misread word."""
        w = last.removesuffix("...").rstrip("…�").lower()
        return w not in self.lex and self.lex.trie.is_inner(w)


# What a page asks the lexicon for, when it isn't at the workers ---------------------------------


def _tokens_asked(row: dict) -> set[str]:
    """Shapes of the tokens of a page, of neighbours put together, and of halves of words."""
    out = set()
    for t in row["texts"]:
        if isinstance(t, str):
            out.update(shape(w) for m in tokens(canonical(t)) for w in (m.group(), m.group().rstrip("!")))
            words = [shape(x) for x in _PAIR.findall(canonical(t))]
            out.update(words)
            out.update(a + b for a, b in zip(words, words[1:]))
    ends = [(_PAIR.findall(canonical(t)) or [""]) for t in row["texts"] if isinstance(t, str)]
    out.update(shape(a[-1] + b[0]) for k in (1, 2) for a, b in zip(ends, ends[k:]))
    return out


def _stretches_asked(row: dict) -> set[str]:
    """Shapes of every piece of the stretches that the lexicon of the page leaves open."""
    entries = row["_lex"]
    decoder = Decoder(make_lexicon([] if entries is None else [tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in entries]))
    out = set()
    for t in row["texts"]:
        if isinstance(t, str):
            pieces, todo = decoder.stretches(canonical(t))
            for lo, hi in todo:
                s = shape("".join(m.group() for m in tokens(" ".join(pieces[lo:hi]))))
                out.update(s[i:j] for i in range(len(s)) for j in range(i + 1, min(len(s), i + row["_longest"]) + 1))
    return out


def with_lexicon(rows: DataFrame, lex: Shared) -> DataFrame:
    """Page rows with `_lex`: null where the workers have the lexicon, else every entry that decoding the page may ask for.

    Two joins then: first for the words of the page, then for all pieces of the stretches these leave open.
    """
    if lex.rows is not None:
        return lex.attach(rows, ["page_id"], _tokens_asked, "_lex")
    longest = lex.table.agg(F.max(F.length("shape"))).first()[0] or 0
    first = lex.attach(rows.dropDuplicates(["page_id"]), ["page_id"], _tokens_asked, "_lex").withColumn("_longest", F.lit(longest))
    both = lex.attach(cut_lineage(first), ["page_id"], _stretches_asked, "_more")
    return both.withColumn("_lex", F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast(both.schema["_lex"].dataType)) for c in ("_lex", "_more")]))).drop("_more", "_longest")


# Noise ----------------------------------------------------------------------------------------

_NOISE = "exam_id string, page_id string, page_order int, block_idx int, kind string, word string"
_COLUMNS = [c.split()[0] for c in _NOISE.split(", ")]


def ambiguous(lex: Lexicon) -> frozenset[str]:
    """Known words that another known word may be misread as, or that may be misread as another."""
    return frozenset(a for ws in lex.shapes.values() for a in ws for b in ws if len(a) > 1 and len(b) > 1 and a != b and (misreads(a, b) is not None or misreads(b, a) is not None))


def page_noise(pages: DataFrame, lex: Shared, decode: bool = True) -> DataFrame:
    """Rows of kind hyphen, char and page_number, judged page by page; 'half', 'head', 'edge' and 'pair' for what needs other rows.

    'half' is a block that ends in half a word (`word`); 'head' rows are the first words of the blocks at the top of
    a page and of the first one below; 'edge' rows are lines at the top or bottom of a page (`word` is a
    digest of the line apart from misread characters); 'pair' rows are ambiguous known words with the word before
    them. `decode=False` leaves only the last two.
    """
    get = lex.sender(make_lexicon, pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder, own, doubtful = None, None, frozenset()
        for b in batches:
            out = []
            for exam, page, order, texts, entries in zip(b["exam_id"], b["page_id"], b["page_order"], b["texts"], b["_lex"]):
                order = None if order is None or order != order else int(order)
                lexicon = get(entries)
                if lexicon is not own:
                    own, decoder, doubtful = lexicon, Decoder(lexicon), ambiguous(lexicon)
                blocks = [(i, canonical(t)) for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
                n = len(blocks)
                for i, t in blocks[: EDGE_BLOCKS + 1]:
                    m = _HEAD.match(t)
                    if decode and m and m[1][0].islower():
                        out.append((exam, page, order, i, "head", m[1]))
                for j, (i, text) in enumerate(blocks):
                    kinds = set()
                    if j < EDGE_BLOCKS or j >= n - EDGE_BLOCKS:
                        text, number, lines = edge_of(text, order)
                        if number:
                            kinds.add("page_number")
                        if exam is not None:
                            out.extend((exam, page, order, i, "edge", digest(skel)) for skel in lines)
                    low = text.lower() if doubtful else ""
                    # A few words are looked for first; the pairs are the same without that look.
                    if doubtful and (len(doubtful) > 30 or any(map(low.__contains__, doubtful))):
                        low = _PAIR.findall(low)
                        out.extend((exam, page, order, i, "pair", f"{x} {w}") for x, w in zip(low, low[1:]) if w in doubtful)
                    if not decode:
                        continue
                    kinds |= decoder.decode(text, want_text=False)[1]
                    m = _END.search(text) if text.rstrip()[-1:] in _HYPHEN_SET else None
                    if m:
                        rest = next((h for _, h in heads_after(blocks, j) if h[0].islower() and joins(m[1], h, lexicon)), None)
                        if rest:
                            kinds.add("hyphen")
                        else:
                            out.append((exam, page, order, i, "half", m[1]))
                    out.extend((exam, page, order, i, k, "") for k in kinds)
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"page_order": "Int32"})

    return with_lexicon(page_rows(pages).drop("source", "labels"), lex).mapInPandas(run, _NOISE)


def heads_after(blocks: list[tuple[int, str]], j: int) -> list[tuple[int, str]]:
    """First words of the next block of the page, and of the one after it (a picture may stand between)."""
    return [(i, m[1]) for i, t in blocks[j + 1 : j + 3] if (m := _HEAD.match(t))]


def digest(line: str) -> str:
    """A short name of a line; 96 bits, so equal names mean equal lines."""
    return hashlib.blake2b(line.encode(), digest_size=12).hexdigest()


def edge_of(text: str, order: int | None, running=frozenset()) -> tuple[str, bool, list[str]]:
    """(text without page numbers and lines in `running`, it had a number, skeletons of its first and last lines) of a block at a page's edge."""
    lines = text.split("\n")
    full = [q for q, line in enumerate(lines) if line.strip()]
    edge = {*full[:EDGE_LINES], *full[-EDGE_LINES:]}
    kept, number, skels = [], False, []
    for q, line in enumerate(lines):
        if q in edge:
            s = line.strip()
            if is_page_number(s, order):
                number = True
                continue
            head, tail = split_tail(s, order)
            if tail:
                number, line = True, head
            skel = skeleton(head)
            if len(skel) >= 4:
                skels.append(skel)
                if running and digest(skel) in running:
                    continue
        kept.append(line)
    return "\n".join(kept), number, skels


def running_lines(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """page_id, block_idx, skel of the running lines; `noise` has the edge lines."""
    e = noise.where("kind = 'edge'").select("exam_id", "page_id", "block_idx", F.col("word").alias("skel"))
    per_line = e.select("exam_id", "skel", "page_id").distinct().groupBy("exam_id", "skel").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {MIN_PAGES}")
    has = pages.where(F.exists("ocr_text.layouts", lambda b: b.isNotNull())).select(norm_key("exam_id").alias("exam_id"), "id").distinct()
    per_exam = has.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n_pages"))
    lines = per_line.join(per_exam, "exam_id").where("3 * n >= n_pages").select("exam_id", "skel", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = e.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    return salted.join(lines, ["exam_id", "skel", "salt"], "left_semi").select("page_id", "block_idx", "skel")


def context_errors(noise: DataFrame, lex: Shared) -> DataFrame:
    """before, word, good: known words that the word before them shows to be another known word misread.

    A pair (before, word) is an error when (before, good) is NOISE_RATIO times as frequent, `good` being a word that is
    misread as `word`. Pairs are counted with map-side combine, and meet others of one shape only.
    """
    from pagemill.llm.scan import _misread, shape_col

    p = F.split("word", " ")
    # A repeated page row gives the same pairs again: each place counts once per delivery, on both sides of the comparison.
    n = noise.where("kind = 'pair'").select(p[0].alias("before"), p[1].alias("word")).groupBy("before", "word").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("shape", shape_col(F.col("word")))
    other = n.select("before", "shape", F.col("word").alias("good"), F.col("n").alias("m"))
    pairs = n.join(other, ["before", "shape"]).where((F.col("good") != F.col("word")) & (F.col("m") >= NOISE_RATIO * F.col("n"))).where(_misread("good", "word"))
    return pairs.groupBy("before", "word").agg(F.max_by("good", F.struct("m", "good")).alias("good"))


def found_noise(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, block_idx, kind of every noise in every block."""
    lex = shared_lexicon(lexicon_of(counted(pages)), most)
    noise = cut_lineage(page_noise(pages, lex))
    local = noise.where("kind in ('hyphen', 'char', 'page_number')").select("page_id", "block_idx", "kind")
    over = over_pages(noise, lex).select("page_id", "block_idx", F.lit("hyphen").alias("kind"))
    running = running_lines(pages, noise).select("page_id", "block_idx", F.lit("running").alias("kind"))
    bad = context_errors(noise, lex).select(F.concat_ws(" ", "before", "word").alias("word"))
    misread = noise.where("kind = 'pair'").join(bad, "word", "left_semi").select("page_id", "block_idx", F.lit("char").alias("kind"))
    return local.unionByName(over).unionByName(running).unionByName(misread).distinct()


def over_pages(noise: DataFrame, lex: Shared) -> DataFrame:
    """Halves of words whose rest opens the exam's next page: page_id, block_idx."""
    half = noise.where("kind = 'half'").withColumn("next_order", F.col("page_order") + 1)
    head = noise.where("kind = 'head'").select("exam_id", F.col("page_order").alias("next_order"), F.col("word").alias("rest"))
    pairs = half.join(head, ["exam_id", "next_order"]).select("page_id", "block_idx", "word", "rest").distinct()
    asks = lambda r: {shape(r["word"]), shape(r["rest"]), shape(r["word"] + r["rest"])}
    pairs = lex.attach(pairs, ["page_id", "block_idx", "word", "rest"], asks, "_lex")
    get = lex.sender(make_lexicon, noise.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[bool(joins(a, r, get(e))) for a, r, e in zip(b["word"], b["rest"], b["_lex"])]][["page_id", "block_idx"]]

    return pairs.mapInPandas(run, "page_id string, block_idx int")


# Repair -------------------------------------------------------------------------------------

def decode(text: str, lex: Lexicon) -> str:
    """One text as a line of words: de-lined, hyphens joined, misread words repaired."""
    return Decoder(lex).decode(text)[0]


def in_context(text: str, errors: dict[tuple[str, str], str]) -> str:
    """The text with known words put right that the word before them shows to be misread."""
    if not errors:
        return text
    out, at, before = [], 0, None
    for m in _PAIR.finditer(text):
        good = errors.get((before, m.group().lower())) if before else None
        if good:
            out += [text[at : m.start()], _cased(good, m.group())]
            at = m.end()
        before = m.group().lower()
    return "".join(out) + text[at:]


def paragraph_breaks(lines: list[str]) -> list[int]:
    """Indices of lines that begin a paragraph, by dynamic programming.

    A break after a line costs little when the line ends a sentence and is short for its paragraph
    or the next begins anew, and much inside a sentence; each paragraph costs a constant. cost[i] is
    the least cost of the first i lines, over the start j of the last paragraph.
    """
    n = len(lines)
    if n <= 1:
        return [0] if n else []
    width = max(len(x) for x in lines)
    end = [bool(re.search(r"[.?!…:]\W*\Z", x)) for x in lines]
    start = [bool(re.match(r"\W*[^\W\d_a-zà-ÿ]", x)) or bool(re.match(r"\s*(?:\d+[.)]|[-•*(])", x)) for x in lines]

    def brk(i: int) -> float:  # the cost of a break before line i
        short = 1 - len(lines[i - 1]) / width
        return (0.2 if end[i - 1] else 4.0) + (0.0 if start[i] else 4.0) + 2.0 * (1 - min(1.0, 3 * short))

    def stay(i: int) -> float:  # the cost of lines i-1 and i in one paragraph
        short = 1 - len(lines[i - 1]) / width
        return 3.0 * max(0.0, short - 0.25) if end[i - 1] else 0.0

    stays = [0.0] * (n + 1)
    for i in range(1, n):
        stays[i + 1] = stays[i] + stay(i)
    # cost[i] = min over j of cost[j] + break before j + stays inside j..i; both parts are running
    # sums, so the minimum over j is kept in one number and the whole is linear in the lines.
    cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    best, arg = 1.0, 0
    for i in range(1, n + 1):
        cost[i], back[i] = best + stays[i], arg
        if i < n:
            c = cost[i] + brk(i) + 1.0 - stays[i + 1]
            if c < best:
                best, arg = c, i
    out, i = [], n
    while i > 0:
        out.append(back[i])
        i = back[i]
    return sorted(out)


def repaired_paragraphs(pages: DataFrame, most: int | None = None) -> DataFrame:
    """exam_id, page_id, page_order, paragraph, block_idx, category, text, flows, goes_on, goes_before: the repaired paragraphs of every page.

    The lines and page numbers that `found_noise` finds are gone, and only these; known words misread as others are put right
    by the word before them. `flows`: text of the page and no header or footer by label; `goes_on`: the last such paragraph of
    the page has no end; `goes_before`: the first one has no beginning.
    """
    lex = shared_lexicon(lexicon_of(counted(pages)), most)
    first = cut_lineage(page_noise(pages, lex, decode=False))
    own = Shared(cut_lineage(running_lines(pages, first).select("page_id", "skel").distinct()), "page_id", ["page_id", "skel"], most)
    bad = Shared(cut_lineage(context_errors(first, lex)), "word", ["before", "word", "good"], most)
    rows = with_lexicon(page_rows(pages).dropDuplicates(["page_id"]), lex)
    rows = own.attach(rows, ["page_id"], lambda r: {r["page_id"]} - {None}, "_own")
    rows = bad.attach(rows, ["page_id"], lambda r: {w for t in r["texts"] if isinstance(t, str) for w in _PAIR.findall(canonical(t).lower())}, "_bad")
    spark = pages.sparkSession
    get_lex, get_bad = lex.sender(make_lexicon, spark), bad.sender(lambda e: {(a, w): g for a, w, g in e}, spark)
    get_own = own.sender(_by_page, spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = None
        for b in batches:
            out = []
            for exam, page, order, texts, labels, e_lex, e_own, e_bad in zip(b["exam_id"], b["page_id"], b["page_order"], b["texts"], b["labels"], b["_lex"], b["_own"], b["_bad"]):
                lexicon, errors, running = get_lex(e_lex), get_bad(e_bad), get_own(e_own).get(page, frozenset())
                if decoder is None or decoder.lex is not lexicon:
                    decoder = Decoder(lexicon)
                o = None if order is None or order != order else int(order)
                paras: list[tuple[int, str, str]] = []
                blocks = [(i, c or "", canonical(t)) for i, (t, c) in enumerate(zip(texts, labels)) if isinstance(t, str) and t.strip()]
                for j, (i, label, text) in enumerate(blocks):
                    if j < EDGE_BLOCKS or j >= len(blocks) - EDGE_BLOCKS:
                        text = edge_of(text, o, running)[0]
                    if not text.strip():
                        continue
                    if label in ("Table", "Formula") or text.lstrip().startswith("<"):
                        paras.append((i, label, text.strip()))
                        continue
                    lines = [x for x in text.split("\n") if x.strip()]
                    starts = paragraph_breaks(lines)
                    for s, e in zip(starts, starts[1:] + [len(lines)]):
                        paras.append((i, label, in_context(decoder.decode("\n".join(lines[s:e]))[0], errors)))
                flow = [k for k, x in enumerate(paras) if x[1] not in EDGE_LABELS]
                for k, (i, label, text) in enumerate(paras):
                    goes = flow[-1:] == [k] and label == "Text" and not re.search(r"[.?!…_>$]\W*\Z", text)
                    begin = _FIRST.match(text)
                    opens = flow[:1] == [k] and label == "Text" and bool(begin) and not begin[1].isupper()
                    out.append((exam, page, o, k, i, label or None, text, goes, opens))
            yield pd.DataFrame(out, columns=["exam_id", "page_id", "page_order", "paragraph", "block_idx", "category", "text", "goes_on", "goes_before"]).astype({"page_order": "Int32"})

    return rows.mapInPandas(run, "exam_id string, page_id string, page_order int, paragraph int, block_idx int, category string, text string, goes_on boolean, goes_before boolean")


def _by_page(entries: list[tuple]) -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for page, skel in entries:
        out.setdefault(page, set()).add(skel)
    return {k: frozenset(v) for k, v in out.items()}


def continuous_paragraphs(pages: DataFrame, most: int | None = None, max_rounds: int = 64) -> DataFrame:
    """exam_id, page_id, page_order, paragraph, category, n_pages, text: paragraphs put together over page ends.

    A paragraph that goes on is joined with the one that opens the exam's next page (a join on exam and
    page number; of several pages with one number the first by id). Where a whole page is the middle of one paragraph,
    the page it began on is found by pointer doubling, so a chain of n pages takes log n rounds. Only the pages of one
    paragraph come together in one row, the paragraph itself; no exam is gathered.
    """
    base = cut_lineage(repaired_paragraphs(pages, most))
    last = base.where("goes_on").groupBy("exam_id", (F.col("page_order") + 1).alias("page_order")).agg(F.min(F.struct("page_id", F.col("goes_before").alias("alone"), F.col("paragraph").alias("at"))).alias("l"))
    last = last.select("exam_id", "page_order", "l.alone")
    first = base.where("goes_before").groupBy("exam_id", "page_order").agg(F.min(F.struct("page_id", "paragraph", "text")).alias("f")).select("exam_id", "page_order", "f.*")
    link = first.join(last, ["exam_id", "page_order"]).withColumn("root", F.col("page_order") - 1)
    is_child = link.select("exam_id", F.col("page_order").alias("root"), F.lit(True).alias("child"))
    link = link.join(is_child, ["exam_id", "root"], "left").withColumn("open", F.col("alone") & F.coalesce("child", F.lit(False)))
    link = cut_lineage(link.select("exam_id", "page_order", "page_id", "paragraph", "text", "root", "open"))
    for k in range(max_rounds + 1):
        if link.where("open").isEmpty():
            break
        if k == max_rounds:
            raise RuntimeError("a chain of pages is longer than 2 to the number of rounds")
        up = link.select("exam_id", F.col("page_order").alias("root"), F.col("root").alias("root2"), F.col("open").alias("open2"))
        done = link.where("not open")
        step = link.where("open").join(up, ["exam_id", "root"]).select("exam_id", "page_order", "page_id", "paragraph", "text", F.col("root2").alias("root"), F.col("open2").alias("open"))
        link = cut_lineage(done.unionByName(step))
    rest = link.groupBy("exam_id", F.col("root").alias("page_order")).agg(F.sort_array(F.collect_list(F.struct("page_order", "text"))).alias("more"))
    own = base.join(link.select("page_id", "paragraph"), ["page_id", "paragraph"], "left_anti")
    heads = own.where("goes_on").join(rest, ["exam_id", "page_order"], "left")
    glue = lambda a, b: F.when(a.rlike(rf"(?U)\p{{L}}[{HYPHENS}]$"), F.concat(F.regexp_replace(a, ".$", ""), b)).otherwise(F.concat_ws(" ", a, b))
    whole = F.aggregate(F.coalesce("more", F.array().cast("array<struct<page_order:int,text:string>>")), F.col("text"), lambda acc, m: glue(acc, m["text"]))
    keep = ["exam_id", "page_id", "page_order", "paragraph", "category"]
    grown = heads.select(*keep, (F.lit(1) + F.coalesce(F.size("more"), F.lit(0))).alias("n_pages"), whole.alias("text"))
    return own.where("not goes_on").select(*keep, F.lit(1).alias("n_pages"), "text").unionByName(grown)
