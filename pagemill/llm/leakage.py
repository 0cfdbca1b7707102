"""Evaluation texts leaking into training text: exact word matches through suffix arrays.

A text counts as its sequence of words (unbroken runs of letters and digits, without case and
accents, đ as d). The documents of a partition are one shard (cut at SHARD_WORDS words, which bounds its memory).
Its words are numbered by the vocabulary of the test items (a word outside it ends every match). A match of
MIN_WORDS words begins with a MIN_WORDS-gram of an item, so the shard's grams are looked up in the sorted grams of
the items, all at once: work goes with the corpus, not with the number of items. The places that pass are sorted to the
shard's suffix array by prefix doubling, and every item suffix that begins with one of their grams is
binary-searched. The two bounds of the search give all places with at least MIN_WORDS common words; comparing
on from there gives the longest match. Shards don't see one another, so there is no shuffle of documents at all.

The test set is broadcast: its size is checked against MAX_ITEM_BYTES first; beyond it, the items
are processed in several rounds over the corpus, each within the bound.

Defined results: null texts hold nothing; an item shorter than MIN_WORDS words never leaks; a
document given twice is reported for each row's id; equal items are all reported; texts are
processed whole; only suffixes that can begin a match are sorted, which loses none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
MAX_ITEM_BYTES = 64 << 20
#: A shard ends after the text that brings it to so many words.
SHARD_WORDS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def plain_words(text: str) -> list[str]:
    """The words of a text as they are compared: no case, no accents, đ as d."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("đ", "d").replace("Đ", "d")
    return _WORD.findall(text.casefold())


class TestSet:
    """The items' words as numbers, with every suffix that is long enough."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_WORDS):
        self.least = least
        words = [(i, plain_words(t)) for i, t in items if isinstance(t, str)]
        words = [(i, w) for i, w in words if len(w) >= least]
        self.number: dict[str, int] = {}
        self.items = [i for i, _ in words]
        self.seqs = [np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], dtype=np.int32) for _, w in words]
        self.longest = max((len(x) for x in self.seqs), default=0)
        # Every suffix that is long enough, by the digest of its first words.
        owner = [np.full(len(x) - least + 1, k) for k, x in enumerate(self.seqs)]
        grams = [gram_digests(x, least) for x in self.seqs]
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        gram, item = cat(grams, np.uint64), cat(owner, np.int64)
        offset = cat([np.arange(len(g)) for g in grams], np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.offset = gram[order], item[order], offset[order]

    def with_gram(self, found: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item index, offset, numbers from there on) of the suffixes whose first words have one of the digests `found`."""
        for g in found:
            for x in range(int(np.searchsorted(self.gram, g)), int(np.searchsorted(self.gram, g, side="right"))):
                k, o = int(self.item[x]), int(self.offset[x])
                yield k, o, self.seqs[k][o:]


def gram_digests(seq: np.ndarray, n: int) -> np.ndarray:
    """A digest of the n numbers from each place on (modulo 2^64; equal grams have equal digests)."""
    if len(seq) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(seq) - n + 1, dtype=np.uint64)
    wide = seq.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + len(out)]
    return out


def suffix_array(seq: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The positions `starts` sorted by the words from there on, by prefix doubling to at least `depth` words."""
    rank = seq.astype(np.int64)
    n, step = len(seq), 1
    while step < depth:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - step] = rank[step:]
        key = rank * (int(rank.max()) + 2 if n else 1) + nxt
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2
        if len(rank) and rank.max() == n:
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def numbers(text: str | None, tests: TestSet) -> np.ndarray:
    """The words of a text as numbers of the test vocabulary, unknown ones as 0, with a 0 at the end."""
    get = tests.number.get
    return np.array([*(get(w, 0) for w in plain_words(text)), 0] if isinstance(text, str) and text else [0], dtype=np.int32)


def shard_matches(parts: list[np.ndarray], tests: TestSet) -> Iterator[tuple[int, int, int, int, int]]:
    """(text index, item index, word position, item offset, length) of the maximal matches in one shard of numbered texts."""
    if not parts or not tests.items:
        return
    seq = np.concatenate(parts)
    owners = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
    # run[p]: known words from p on without a stop; a shorter run than `least` can't begin a match.
    stops = np.flatnonzero(seq == 0)
    run = stops[np.searchsorted(stops, np.arange(len(seq)))] - np.arange(len(seq))
    digests = gram_digests(seq, tests.least)
    place = np.minimum(np.searchsorted(tests.gram, digests), len(tests.gram) - 1)
    starts = np.flatnonzero((tests.gram[place] == digests) & (run[: len(digests)] >= tests.least))
    if not len(starts):
        return
    # Only the runs that hold such places are kept for sorting; each keeps its stop.
    begin = starts[np.flatnonzero(np.diff(stops[np.searchsorted(stops, starts)], prepend=-1) != 0)]
    keep = np.concatenate([np.arange(b, b + run[b] + 1) for b in begin])
    small = seq[keep]
    back = keep
    inner = np.flatnonzero(np.isin(back, starts, assume_unique=True))
    longest = tests.longest
    sa = suffix_array(small, inner, longest)
    padded = np.concatenate([small, np.zeros(longest + 1, dtype=np.int32)])

    def cmp(p: int, want: np.ndarray) -> int:
        have = padded[p : p + len(want)]
        d = np.flatnonzero(have != want)
        return 0 if not len(d) else (1 if have[d[0]] > want[d[0]] else -1)

    def bound(want: np.ndarray, right: bool) -> int:
        lo, hi = 0, len(sa)
        while lo < hi:
            mid = (lo + hi) // 2
            c = cmp(sa[mid], want)
            if c < 0 or (right and c == 0):
                lo = mid + 1
            else:
                hi = mid
        return lo

    for k, o, s in tests.with_gram(np.unique(digests[starts])):
        want = s[: tests.least]
        lo = bound(want, False)
        if lo == len(sa) or cmp(sa[lo], want):
            continue
        for p in sa[lo : bound(want, True)]:
            # A match that begins one word earlier is reported there.
            if o and back[p] and seq[back[p] - 1] == tests.seqs[k][o - 1]:
                continue
            have = padded[p : p + len(s)]
            d = np.flatnonzero(have != s)
            n = int(d[0]) if len(d) else len(s)
            pos = int(back[p])
            t = int(np.searchsorted(owners, pos, side="right")) - 1
            yield t, k, pos - int(owners[t]), o, n


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, word_pos, item_offset, n_words of every maximal verbatim match of at least `least` words."""
    spark = docs.sparkSession
    sized = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rounds = max(1, -(-total // MAX_ITEM_BYTES))
    out = None
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    for r in range(rounds):
        part = sized if rounds == 1 else sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == r)
        bc = spark.sparkContext.broadcast(TestSet([(x["i"], x["t"]) for x in part.collect()], least))

        def run(batches: Iterator[pd.DataFrame], bc=bc) -> Iterator[pd.DataFrame]:
            tests = bc.value
            ids, parts, size = [], [], 0

            def matched() -> pd.DataFrame:
                rows = [(ids[t], tests.items[k], pos, o, n) for t, k, pos, o, n in shard_matches(parts, tests)]
                return pd.DataFrame(rows, columns=["doc_id", "item_id", "word_pos", "item_offset", "n_words"])

            for b in batches:
                for i, t in zip(b["_i"].tolist(), b["_t"].tolist()):
                    ids.append(i)
                    parts.append(numbers(t, tests))
                    size += len(parts[-1])
                    if size >= SHARD_WORDS:
                        yield matched()
                        ids, parts, size = [], [], 0
            yield matched()

        got = src.mapInPandas(run, f"doc_id {id_type}, item_id {item_type}, word_pos int, item_offset int, n_words int")
        out = got if out is None else out.unionByName(got)
    return out


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, once each."""
    return leaks(docs, items).select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item."""
    return docs.join(leaked_pairs(docs, items).select("doc_id").distinct(), "doc_id", "left_anti")


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: documents, longest match and the share of the item's words it covers."""
    count = F.pandas_udf(lambda s: s.map(lambda t: len(plain_words(t))), "int")
    sizes = items.where("text is not null").select("item_id", "split_name", count("text").alias("words"))
    m = leaks(docs, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
    return sizes.join(m, "item_id").select("item_id", "split_name", "n_docs", "longest", F.round(F.col("longest") / F.col("words"), 4).alias("share"))
