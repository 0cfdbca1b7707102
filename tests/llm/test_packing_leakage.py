import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import leakage, packing


def expand(steps):
    return [[s for s, m in per.items() for _ in range(m)] for k, per in steps for _ in range(k)]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 200), st.integers(1, 60), max_size=25), st.integers(200, 400))
def test_plan_uses_every_item_once_and_never_overfills(counts, capacity):
    got = expand(packing.plan(counts, capacity))
    assert all(sum(c) <= capacity for c in got)
    used = {}
    for c in got:
        for s in c:
            used[s] = used.get(s, 0) + 1
    assert used == counts


def test_plan_is_tight():
    rng = random.Random(1)
    counts = {}
    for _ in range(30_000):
        s = int(min(1000, max(5, rng.lognormvariate(5, 0.9))))
        counts[s] = counts.get(s, 0) + 1
    n = sum(k for k, _ in packing.plan(counts, 1000))
    assert n <= 1.01 * -(-sum(s * c for s, c in counts.items()) // 1000)


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]])
    assert np.allclose(packing.nnls(a, a @ np.array([2.0, 0, 3])), [2, 0, 3], atol=1e-2)
    assert (packing.nnls(a, -np.ones(3)) == 0).all()


DOCS = "doc_id long, text string, n_tokens int, size string, container int, part string"


def test_assign(spark):
    rows = [(i, "x" * 9, 40, "c", 1, "p") for i in range(200)] + [(1000, "é" * 10, None, "c", 1, "p"), (1001, None, None, "c", 1, "p"), (1002, "x", 250, "c", 1, "p"), (1003, "x", 100, "c", 1, "p"), (1004, "x", 0, "c", 1, "p"), (1005, "x", 300, "c", 1, "p")]
    got = packing.assign(spark.createDataFrame(rows, DOCS), 100).collect()
    load, docs = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.size
        docs.setdefault(r.doc_id, []).append(r.size)
    assert max(load.values()) <= 100 and len(docs) == len(rows)
    assert sorted(docs[1002]) == [50, 100, 100] and docs[1000] == [21] and docs[1001] == [1] and docs[1003] == [100] and docs[1004] == [0] and docs[1005] == [100] * 3
    assert all(len(v) == 1 for k, v in docs.items() if k < 1000)
    assert packing.assign(spark.createDataFrame([], DOCS), 100).count() == 0


def test_no_rank_window_is_hot(spark, monkeypatch):
    """A size that a third of all rows share is split into buckets no longer than others; ranks stay without gaps."""
    rows = [(i, None, 7 if i % 3 else 20 + i % 200, "c", 1, "p") for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    for n in (50, 10**6):
        got = packing.assign(docs, 400, rank_rows=n).collect()
        load = {}
        for r in got:
            load[r.container] = load.get(r.container, 0) + r.size
        assert len(got) == len(rows) == len({(r.doc_id, r.part) for r in got}) and max(load.values()) <= 400
        assert sum(load.values()) == sum(r[2] for r in rows) and sorted(load) == list(range(len(load)))
    zeros = spark.createDataFrame([(i, None, 0, "c", 1, "p") for i in range(500)], DOCS)
    assert {r.container for r in packing.assign(zeros, 10).collect()} == {0}


def test_shards_of_any_length(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"x{i} " + item if i % 3 else "w1 w2 " * 40) for i in range(60)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, item), (2, " ".join(f"w{i}" for i in range(10, 24)))], "item_id long, text string")
    want = {(i, k) for i in range(60) if i % 3 for k in (1, 2)}
    for n in (1, 100, 10**6):
        monkeypatch.setattr(leakage, "SHARD_WORDS", n)
        assert {tuple(r) for r in leakage.leaked_pairs(docs, items).collect()} == want


def brute(docs, items, least):
    grams = {}
    for i, t in items:
        w = leakage.plain_words(t) if t else []
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.plain_words(t) if t else []
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


words = st.lists(st.sampled_from("a b c d e f".split()), max_size=30).map(" ".join)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), words), max_size=6), st.lists(st.one_of(st.none(), words), max_size=4), st.integers(1, 5))
def test_suffix_array_equals_brute_force(docs, items, least):
    tests = leakage.TestSet(list(enumerate(items)), least)
    got = set()
    for t, k, pos, o, n in leakage.shard_matches([leakage.numbers(d, tests) for d in docs], tests):
        w, v = leakage.plain_words(docs[t]), leakage.plain_words(items[tests.items[k]])
        assert n >= least and w[pos : pos + n] == v[o : o + n]
        assert pos + n == len(w) or o + n == len(v) or w[pos + n] != v[o + n]
        got.add((t, tests.items[k]))
    assert got == brute(list(enumerate(docs)), list(enumerate(items)), least)


def test_leaks(spark):
    item = "Đêm ấy ở Zinyru họ gánh 927 chuông đồng qua đầm lầy hổ phách sang Dordor."
    rows = [(1, "x. " + item + " y"), (2, "DEM AY O ZINYRU HO GANH, 927 CHUONG\nDONG qua dam lay ho tail"), (3, "dem ay o zinyru ho ganh 927 chuong dong qua dam"), (4, None), (5, ""), (6, "w " * 50_000 + item)]
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, item_id int, n_words string")
    items = spark.createDataFrame([(10, item, "a"), (11, item, "a"), (12, "short one", "a"), (13, None, "a")], "item_id long, text string, split_name string")
    assert {tuple(r) for r in leakage.leaked_pairs(docs, items).collect()} == {(d, i) for d in (1, 2, 6) for i in (10, 11)}
    assert sorted(r.doc_id for r in leakage.without_leaks(docs, items).collect()) == [3, 4, 5]
    assert leakage.leaked_pairs(docs.limit(0), items).count() == 0 and leakage.leaked_pairs(docs, items.limit(0)).count() == 0
    assert {r.item_id: r.longest for r in leakage.leak_report(docs, items).collect()} == {10: 16, 11: 16}
