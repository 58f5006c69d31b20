from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm import periodic_runs, queries, token_counts, whitening
from tests.conftest import TINY

# --- runs -----------------------------------------------------------------------------------------------------------


def _runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def _periodic(draw):
    n, k = draw(st.integers(0, 60)), draw(st.sampled_from([1, 2, 3, 20]))
    w = draw(st.lists(st.integers(0, k), min_size=n, max_size=n))
    if n and draw(st.booleans()):
        a, p = draw(st.integers(0, n - 1)), draw(st.integers(1, 20))
        w = [*w[:a], *(w[a + (i - a) % min(p, n - a)] for i in range(a, n))]
    return w * draw(st.sampled_from([1, 1, 2, 3]))


@settings(max_examples=300, deadline=None)
@given(st.lists(_periodic(), max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_equal_brute_force(texts, least):
    words = np.array([x for w in texts for x in w], dtype=np.int64)
    got = periodic_runs.find_runs(words, np.repeat(np.arange(len(texts)), [len(w) for w in texts]), least)
    want, at = [], 0
    for w in texts:
        want += [(a + at, b + at, q) for a, b, q in _runs(w, least)]
        at += len(w)
    assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_of_highly_repetitive_texts():
    one = periodic_runs.find_runs(np.zeros(50_000, dtype=np.int64), np.zeros(50_000, dtype=np.int64))
    assert one.tolist() == [[0, 50_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 3_000:
        a, b = b, b + a
    assert [tuple(r) for r in periodic_runs.find_runs(np.array(b), np.zeros(len(b), dtype=np.int64), 2).tolist()] == _runs(b, 2)


def test_grammar_derives_its_texts():
    words = np.array([1, 2, 3] * 20 + [4, 1, 2, 3, 4, 1, 2, 3, 9], dtype=np.int64)
    g = periodic_runs.Grammar(words, np.repeat([0, 1], [60, 9]))

    def text(s):
        return [s] if s < g.base else text(g.left[s - g.base]) + text(g.right[s - g.base])

    assert [text(r) for r in g.roots.tolist()] == [words[:60].tolist(), words[60:].tolist()]
    assert len(g.length) - g.base < 24  # twenty repetitions take few symbols
    assert all(text(s) == words[g.place[s] : g.place[s] + g.length[s]].tolist() for s in range(g.base, len(g.length)))


def _digest(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    runs = [(a, b - a, q) for a, b, q in _runs(w, 12)]
    drop = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_run_query_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 9_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_grammar_run_detection(spark, TINY).collect()}
    assert sum(r[1] > 0 for r in got.values()) > 10
    for r in docs:
        assert got[r["doc_id"]] == _digest(r["doc_id"], r["text"], True)


def test_runs_of_awkward_rows(spark, awkward, nothing):
    got = Counter(tuple(r) for r in periodic_runs.run_digests(awkward).collect())
    short = [r for r in awkward.select("doc_id", "text").collect() if len(r["text"] or "") < 9_000]
    want = Counter(_digest(r["doc_id"], r["text"], False) for r in short)
    assert not want - got and got.total() == awkward.count()
    long = [r for r in periodic_runs.periodic_runs(awkward).collect() if r["doc_id"] == 6][0]
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 977)] and len(long["text"].split()) == 977
    assert periodic_runs.periodic_runs(nothing).count() == periodic_runs.run_digests(nothing).count() == 0
    assert queries.with_repeats(awkward).count() == awkward.count()


# --- whitening ------------------------------------------------------------------------------------------------------


def test_counts_and_eigenpairs_of_clustered_spectra():
    rng = np.random.default_rng(1)
    for _ in range(100):
        d = int(rng.integers(1, 12))
        q, _r = np.linalg.qr(rng.standard_normal((d, d)))
        m = (q * rng.choice([0, 1, 1, 2, 5, 1e-3, 1e3, rng.random()], d)) @ q.T
        m = (m + m.T) / 2
        w = np.sort(np.linalg.eigvalsh(m))[::-1]
        for shift in rng.random(5) * 6 - 1:
            if np.abs(w - shift).min() > 1e-9:
                assert whitening.count_above(m, shift) == (w > shift).sum()
        most = int(rng.integers(1, d + 2))
        values, axes = whitening.leading_eigenpairs(m, most)
        assert len(values) == min(most, d, (w > 8 * d * np.finfo(float).eps * np.abs(m).sum(axis=1).max()).sum())
        np.testing.assert_allclose(values, w[: len(values)], atol=1e-12 * max(1, w[0]))
        np.testing.assert_allclose(axes @ axes.T, np.eye(len(values)), atol=1e-10)
        np.testing.assert_allclose(m @ axes.T, axes.T * values, atol=1e-11 * max(1, w[0]))


def test_no_eigenpairs_without_variance():
    for m in (np.zeros((0, 0)), np.zeros((3, 3))):
        assert len(whitening.leading_eigenpairs(m, 16)[0]) == 0


def _expected(rows, components=16):
    usable = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, dtype=np.float64) - np.array(sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        w = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
        out[i] = [(k + 1, n, deviation, abs(w[k]), values[k] / (y * y).sum() * n) for k in range(components)]
    return out


def test_whitening_query_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{TINY}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got: dict[int, list] = {}
    table = queries.op12_spectrum_slicing_whitening(spark, TINY).collect()
    for r in sorted(table, key=lambda r: (r["vec_id"], r["component"])):
        got.setdefault(r["vec_id"], []).append((r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    want = _expected(rows)
    assert got.keys() == want.keys()
    for i, expected in want.items():
        assert [g[:3] for g in got[i]] == [w[:3] for w in expected]
        np.testing.assert_allclose([g[3:] for g in got[i]], [w[3:] for w in expected], rtol=1e-6, atol=1e-8)
    assert {r["identity_error"] for r in table}.pop() < 1e-9 and len({r["identity_error"] for r in table}) == 1


VECTORS = "vec_id long, embedding array<float>, label int, component int, n long, x binary"


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((40, 3)))]
    rows = [*good, (None, good[0][1]), (0, good[0][1]), (101, None), (102, []), (103, [1.0, None, 2.0]), (104, [float("nan")] * 3), (105, [float("inf"), 0.0, 0.0]), (106, [1.0, 2.0]), (107, [3e38, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2, 3, None) for i, v in rows], VECTORS)
    got = whitening.whiten_embeddings(table).collect()
    assert Counter(r["vec_id"] for r in got) == Counter({None: 3, 0: 6} | {k: 3 for k in range(1, 40)})
    assert {r["n"] for r in got} == {40} and max(r["identity_error"] for r in got) < 1e-9
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 1) - 1) < 1e-12
    for empty in (table.filter("false"), table.filter("vec_id = 101"), table.filter("vec_id = 5")):
        assert whitening.whiten_embeddings(empty).count() == 0


def test_deviations_are_exact_or_null(spark):
    rows = [(0, [0.0]), (1, [2.0**40]), (2, [2.0**20])]
    got = whitening.whiten_embeddings(spark.createDataFrame([(i, v, 1, 2, 3, None) for i, v in rows], VECTORS), scale=1.0, offset=0).collect()
    total = 2**40 + 2**20
    want = {0: total**2, 1: (3 * 2**40 - total) ** 2, 2: (3 * 2**20 - total) ** 2}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_long_vectors_pass_a_few_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"e": pa.array([[1.0] * 5, None, [], [2.0] * 30, [3.0], [4.0]], pa.list_(pa.float32()))})
    parts = list(whitening._slices(batch, 0, most=10))
    assert [p.num_rows for p in parts] == [3, 1, 2] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_sums_meet_in_levels(spark):
    parts = spark.createDataFrame([(k % 2, k, json.dumps([k, 1 << 70]).encode()) for k in range(100)], "key int, part long, value binary")
    got = {k: json.loads(v) for k, v in whitening._tree_sum(parts, whitening._add_whole, fan=3).items()}
    assert got == {k: [sum(range(k, 100, 2)), 50 << 70] for k in (0, 1)}


# --- token counts ---------------------------------------------------------------------------------------------------

ALPHABET = "ab erthingZsmdlv'.,-=01 \n\t ​é漢字한ßÅİΣ🙂̣́̂한किﬁ豈"


def _library():
    t = token_counts.counter().tokenizer
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "'re", "don't", " ", "the"])), max_size=6))
def test_counts_of_all_prefixes_equal_the_library(parts):
    text, count = "".join(parts), token_counts.counter()
    steps, stored = count.steps(text)
    got = token_counts.prefix_counts(stored)
    assert got.tolist() == [_library()(text[: k + 1]) for k in range(len(text))] and len(steps) == len(text)


def test_counter_forgets_and_stores_wide_steps():
    count = token_counts.PrefixCounter(keep=20)
    for k in range(60):
        text = f"alpha{k} Beta{k % 3}, don't\nx{k}é"
        assert int(count.steps(text)[0].sum()) == _library()(text)
    count.wide["odd"], count.chunks["odd"] = np.array([1, 200, -200], dtype="<i4"), token_counts._WIDE
    steps, stored = count.steps("the odd one")
    assert stored[0] == 4 and token_counts.prefix_counts(stored).tolist() == np.cumsum(steps).tolist() and steps[4:7].tolist() == [1, 200, -200]


def test_token_counts(spark, awkward, nothing):
    of = _library()
    rows = awkward.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), of(r["text"] or ""), of(r["text"] or "") > 12) for r in rows)
    assert Counter(tuple(r) for r in token_counts.token_budget(awkward, limit=12).collect()) == want
    assert token_counts.token_budget(nothing, limit=1).count() == token_counts.truncate_texts(nothing, 3).count() == 0
    counted = token_counts.count_prefixes(awkward).join(awkward.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").filter("doc_id <> 6")
    asked = counted.select("text", token_counts.tokens_of_prefix("prefix_counts", 9).alias("t"), token_counts.longest_prefix("prefix_counts", 4).alias("c"), token_counts.longest_prefix("prefix_counts", -1).alias("none")).collect()
    for r in asked:
        text = r["text"] or ""
        assert r["t"] == of(text[:9]) and r["none"] == 0
        assert r["c"] == max(k for k in range(len(text) + 1) if of(text[:k]) <= 4)
    for r in token_counts.truncate_texts(awkward, 5).collect():
        assert r["n_tokens"] == of(r["text"] or "") <= 5


def test_token_count_query_equals_the_library(spark):
    of, got = _library(), {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in queries.op13_prefix_token_counts(spark, TINY).collect()}
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: (of(r["text"] or ""), of(r["text"] or "") > 2048) for r in rows}


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError)):
        token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
