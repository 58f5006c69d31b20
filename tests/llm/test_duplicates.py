from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import embedding_duplicates as ed
from cuewright.llm import near_duplicates as nd
from cuewright.llm.common import staged
from cuewright.llm.linkage import connected_components, spread_join


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2040)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components({n for e in real for n in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1f", "\x1f").split(" ")
    import re

    w = re.findall("[^\x20\x09-\x0d]+", " ".join(w))
    if len(w) >= size:
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def corpus():
    """Groups whose copies are like their original but less like one another, chains, exact copies and short texts."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, texts = [], []
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 12, 60, 150]))
        for _ in range(rng.choice([2, 5, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 20, len(base) // 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        if group % 3 == 0:  # a chain
            copy = list(base)
            for _ in range(8):
                copy = copy[3:] + rng.choices(vocabulary, k=3)
                texts.append(" ".join(copy))
    texts += ["a", "A", "a b", "A  b", "b a", "", " ", None] * 2 + [" ".join(rng.choices(vocabulary, k=50)) for _ in range(40)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    return docs


def expected(docs, size):
    """doc_id: (n_shingles, component_id, kept), from all pairs."""
    s = {i: sets(t, size) for i, t in docs}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = components(s, links)
    return {i: (len(s[i]), want[i], want[i] == i) for i in s}


@pytest.mark.parametrize("size", [1, 2, 5])
def test_long_texts_are_cut_into_runs(monkeypatch, size):
    """Whatever the length of runs, words and blanks, the set is that of the whole text."""
    rng = random.Random(size)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choices("abcXé", k=rng.choice([1, 2, 3, 40]))) for _ in range(rng.randrange(0, 60))]
        texts.append("".join(w + rng.choice([" ", "\t", "  ", " \n\r" + " " * rng.randrange(40)]) for w in words).encode())
    want = nd.shingle_sets(texts, size)
    for limit in (1, 7, 33, 200):
        monkeypatch.setattr(nd, "_LONG", limit)
        assert all(np.array_equal(a, b) for a, b in zip(want, nd.shingle_sets(texts, size), strict=True))


def test_sets_that_share_a_number_stay_apart(spark):
    """With numbers of a few bits almost all sets meet another's: the result is that of 64 bits."""
    docs = corpus()[:150]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in nd.near_duplicates(d, shingle_words=2, block=16, bits=4).collect()} == expected(docs, 2)


def test_large_buckets_are_dealt_to_several_tasks(spark):
    rows = [(b, n) for b in range(20) for n in range(1 + 7 * b)] + [(5, 3)]
    members = spark.createDataFrame(rows, "bucket long, node long")
    buckets = staged(members.groupBy("bucket").agg(F.count("*").alias("n"), F.max("node").alias("hi")).filter("bucket > 2"), "buckets")
    want = sorted((b, n, sum(x == b for x, _ in rows), 7 * b) for b, n in rows if b > 2)
    for most in (1, 10, 1000):
        got = spread_join(members, buckets, most)
        assert sorted(tuple(r) for r in got.select("bucket", "node", "n", "hi").collect()) == want


def test_blocks_of_few_bytes(spark, monkeypatch):
    docs = corpus()[::2]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    across = nd._across
    monkeypatch.setattr(nd, "_across", lambda *a: across(*a, limit=2000))
    assert {r["doc_id"]: tuple(r)[1:] for r in nd.near_duplicates(d, shingle_words=2).collect()} == expected(docs, 2)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    docs = corpus()
    want = expected(docs, size)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in nd.near_duplicates(d, shingle_words=size, block=16).collect()} == want
    kept = {r["doc_id"] for r in nd.keep_one_of_each(d, shingle_words=size).collect()}
    assert kept == {i for i, r in want.items() if r[2]}


def test_awkward_rows(spark, awkward, nothing):
    rows = nd.near_duplicates(awkward, shingle_words=5).collect()
    assert len(rows) == awkward.count()
    by = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert by[1, 1, True] == 1 and by[2, 1, False] == 1 and by[7, 7, True] == 2 and by[None, None, True] == 2
    assert all(by[k, k, True] == 1 for k in (3, 4, 5, 6, 8))
    kept = nd.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, None]))
    assert nd.near_duplicates(nothing).count() == 0 and nd.keep_one_of_each(nothing).count() == 0


def test_unlike_texts_that_share_an_id_all_stay(spark):
    one, other, third = ("".join(f"{w}{k} " for k in range(30)) for w in ("a", "b", "c"))
    rows = [(7, one, "p"), (7, other, "q"), (8, one, "r"), (9, third, "s"), (9, third, "t"), (None, other, "u"), (5, third + "more", "v"), (4, "", "w"), (4, "", "w"), (4, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    want = sorted([(7, one), (7, other), (5, third + "more"), (4, ""), (4, None)], key=str)
    for parts in (1, 3):
        kept = nd.keep_one_of_each(d.repartition(parts), shingle_words=5)
        assert kept.columns == d.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    repeated = [(1, one, tag) for tag in "zyxw"]
    first = {nd.keep_one_of_each(spark.createDataFrame(r, "doc_id long, text string, tag string").repartition(2)).collect()[0]["tag"] for r in (repeated, repeated[::-1])}
    assert len(first) == 1  # whatever the rows' order


def test_bayesian_bounds():
    """No bound prunes a pair at the threshold more often than the chosen chance, however the signatures fall."""
    from math import comb

    for n, m in nd.fewest_matches(0.8, 1e-4):
        lost = sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert lost <= 2e-4 and m > 0.5 * n
    x = np.zeros((3, nd.BANDS * nd.BAND_ROWS), dtype=np.uint32)
    y = x.copy()
    y[1, ::2] = 1
    y[2, ::8] = 1
    assert nd.survives(x, y, nd.fewest_matches(0.8, 1e-7)).tolist() == [0, 2]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 2**63, size=3000, dtype=np.uint64)
    a, b = nd.signature(np.sort(u[:2500])), nd.signature(np.sort(u[500:]))
    assert abs((a == b).mean() - 2000 / 3000) < 0.13


def test_embedding_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 64))
    x = [c + rng.normal(size=64) * 0.08 for c in centre for _ in range(60)] + list(rng.normal(size=(80, 64)))
    x += [x[0] * 3, x[0], x[0], x[5] * 1e-160, x[7] * 1e150]
    rows = [(k, [float(a) for a in v], k % 2) for k, v in enumerate(x)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 64, 0), (903, [1.0, None], 0), (904, [float("nan")] * 64, 0), (905, rows[0][1], None), (906, [float("inf")] + [0.0] * 63, 1), (None, rows[3][1], 1), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    got = ed.embedding_duplicates(d, block=32).collect()

    def usable(v, label):
        return label is not None and bool(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)

    good = [k for k, r in enumerate(rows) if usable(r[1], r[2])]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    comp = components(range(len(rows)), links)
    ids = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            ids[c] = min(ids.get(c, 10**9), rows[k][0])
    n = Counter(k for e in links for k in e)
    want = Counter((rows[k][0], n[k], ids.get(comp[k]), rows[k][0] == ids.get(comp[k])) for k in range(len(rows)))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert ed.embedding_duplicates(d.limit(0)).count() == 0


def test_hadamard_and_probes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 8))
    h = np.array([[1.0]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(ed.hadamard(x), x @ h)
    b = ed.buckets(np.vstack((x, x * 2)), np.zeros(10, dtype=np.int64), 3, 2, 2, 7)
    assert b.shape == (10, 9) and (b[:5] == b[5:]).all()
