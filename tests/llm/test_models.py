from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuewright.llm import near_duplicates, pseudo_likelihood, toxicity
from cuewright.llm import web_archives as wa
from tests.conftest import SMALL


# Toxicity


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.95


def test_toxicity_learns_words_it_was_not_given(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        w = rng.choices([f"w{j}" for j in range(300)], k=40)
        if k % 4 == 0:
            w[7] = "grumpf" + rng.choice(["a", "el", "ung", "ix"])
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(d, d.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(d, model).collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out) and len(out) > 60
    assert {r["doc_id"] for r in toxicity.without_toxic(d, model).collect()} == {k for k, _, t in rows if not t}


def test_training_sample_drops_whole_copies_only(spark):
    """Texts with a common header or footer all stay; of equal texts of one label the smallest doc_id does."""
    header, footer = "Some header of a source. " * 5, " Some footer of a source." * 5
    rows = [(k, f"{header}text number {k}{footer}", k % 2) for k in range(40)]
    rows += [(100 + k, "One  copied\nTEXT", k % 2) for k in range(9, -1, -1)] + [(200, "one copied text", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    ids = [r["doc_id"] for r in d.filter(~toxicity.held_out()).collect()]
    got = {(r["doc_id"], r["text"], r["toxic"]) for r in toxicity._sample(d.select("doc_id", "text"), d.select("doc_id", "toxic"), 4000, 8000).collect()}
    copies = [k for k in ids if k >= 100]
    first = {min(k for k in copies if y == (1 if k == 200 else k % 2)) for y in (0, 1)}
    assert {k for k, _, _ in got} == {k for k in ids if k < 100} | first
    assert all((k, t, y) in set(rows) for k, t, y in got)


def test_an_id_of_many_texts_brings_one_into_the_sample(spark):
    d = spark.createDataFrame([(1, f"text number {k}") for k in range(50)] + [(k, f"other {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = d.select("doc_id").distinct().selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    got = toxicity._sample(d, labels, 4000, 8000).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and len(ids) > 20
    assert [tuple(r) for r in toxicity._sample(d.repartition(5), labels, 4000, 8000).orderBy("doc_id").collect()] == sorted(tuple(r) for r in got)


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(awkward, none)
    rows = toxicity.score_toxicity(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r["score"] < 0.5 for r in rows)
    rude = spark.createDataFrame([(1, "you absolute idiot"), (2, "1d10t"), (3, "an i d i o t there"), (4, "fine")], "doc_id long, text string")
    assert {r["doc_id"] for r in toxicity.score_toxicity(rude, model).filter("predicted = 1").collect()} == {1, 2, 3}
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.without_toxic(awkward, model).columns == awkward.columns


def test_posterior_labels_outdo_flipped_ones(spark, monkeypatch):
    """A fifth of the given labels is wrong: the posterior is right more often, and a fit on it scores held-out texts better."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    flip = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(100)) < 20
    wrong = labels.select("doc_id", F.when(flip, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    true = {r["doc_id"]: r["toxic"] for r in labels.collect()}

    def loss(model):
        rows = [r for r in toxicity.score_toxicity(docs, model).collect() if r["held_out"] and r["doc_id"] in true]
        return -sum(math.log(max(1e-9, r["score"] if true[r["doc_id"]] else 1 - r["score"])) for r in rows) / len(rows)

    ours, again = (toxicity.fit_toxicity(docs, wrong) for _ in range(2))
    assert ours.induced == again.induced and (ours.weights == again.weights).all()
    sample = sorted(toxicity._sample(docs, wrong, 4000, 8000).collect(), key=lambda r: r["doc_id"])
    voters = toxicity.Voters(ours.induced)
    votes = np.zeros((len(sample), voters.count))
    for k, r in enumerate(sample):
        votes[k, list(voters.fire(r["text"].encode())[1])] = 1
    given = np.array([r["toxic"] for r in sample])
    truth = np.array([true[r["doc_id"]] for r in sample])
    model = toxicity.LabelModel(votes, given, seeds=len(toxicity.LEXICON) + len(toxicity.PATTERNS))
    assert ((model.posterior > 0.5) == truth).mean() > 0.88 > 0.8 > (given == truth).mean()
    assert (model.trust < 0.98).all()
    monkeypatch.setattr(toxicity, "LabelModel", lambda votes, given, **_: type("Given", (), {"posterior": given.astype(float)}))
    assert loss(ours) < 0.7 * loss(toxicity.fit_toxicity(docs, wrong))


def test_label_model_tells_good_voters_from_copies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    good = np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.05)
    noise = rng.random(4000) < 0.2
    votes = np.column_stack((good, good, noise)).astype(float)
    # one kind of voter and the label alone do not tell which of them errs, so here the prior has to
    m = toxicity.LabelModel(votes, np.where(rng.random(4000) < 0.1, 1 - y, y).astype(int), prior=1000)
    assert m.chance[1, 0] > 5 * m.chance[0, 0] and abs(m.chance[1, 2] - m.chance[0, 2]) < 0.1
    assert m.discount[0] < 0.7 < m.discount[2]
    assert ((m.posterior > 0.5) == y).mean() > 0.89


# Archives


def _pages():
    rows = [(k, f"http://a.example/{k}", f"<p>page {k % 7}</p>" * (1 + k % 3)) for k in range(60)]
    return rows + [(100, None, None), (101, "http://b.example/ü\r\nx", ""), (None, "u", "<p>page 1</p>"), (None, "u", "only here"), (5, "again", rows[5][2]), (102, "long", "é" * 500_000)]


def test_archives(spark):
    rows = _pages()
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 10**9), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    got = wa.archive_round_trip(d).collect()
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert wa.archive_round_trip(d.limit(0)).count() == 0
    assert wa.archive_round_trip(d, least_bytes=10**9).filter("record_type = 'revisit'").count() == 0


class _Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def _package(n=5):
    out = io.BytesIO()
    w = wa.PackageWriter(out)
    for k in range(n):
        p = f"payload {k}".encode()
        w.add(f"k{k}", wa.warc_record(k, f"http://x/{k}", p, wa.digest_of(p), None, False, "2020-01-01T00:00:00Z"))
    w.close()
    return out.getvalue()


def test_package_is_a_plain_zip_and_is_read_by_range():
    raw = _package()
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert z.testzip() is None and set(z.namelist()) == {wa.WARC_MEMBER, wa.INDEX_MEMBER, wa.PACKAGE_MEMBER}
    r = wa.PackageReader(_Bytes(raw))
    assert [x.payload for x in r.records()] == [f"payload {k}".encode() for k in range(5)]
    entry = r.index()[3]
    assert [x.page_id for x in r.records([entry])] == [3]
    assert wa.PackageReader(_Bytes(raw[:-22] + raw[-22:-2] + struct.pack("<H", 5) + b"PK\x05\x06!")).members.keys() == r.members.keys()


def test_zip64_directory():
    """A directory whose sizes, places and counts are in ZIP64 records."""
    raw = _package()
    r = wa.PackageReader(_Bytes(raw))
    end = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", raw, end + 10)
    entries, at, new = raw[start : start + size], 0, b""
    for _ in range(count):
        n, extra, comment = struct.unpack_from("<HHH", entries, at + 28)
        packed, plain = struct.unpack_from("<II", entries, at + 20)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        more = struct.pack("<HHQQQ", 1, 24, plain, packed, header)
        fixed = bytearray(entries[at : at + 46])
        struct.pack_into("<II", fixed, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<H", fixed, 30, len(more))
        struct.pack_into("<I", fixed, 42, 0xFFFFFFFF)
        new += bytes(fixed) + entries[at + 46 : at + 46 + n] + more + entries[at + 46 + n + extra : at + 46 + n + extra + comment]
        at += 46 + n + extra + comment
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(new), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(new), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    wide = wa.PackageReader(_Bytes(raw[:start] + new + record + locator + tail))
    assert {k: (m.size, m.header_at) for k, m in wide.members.items()} == {k: (m.size, m.header_at) for k, m in r.members.items()}
    assert [x.page_id for x in wide.records()] == [0, 1, 2, 3, 4]


def test_damaged_packages():
    raw = _package()
    with pytest.raises(ValueError, match="no end of central directory"):
        wa.PackageReader(_Bytes(raw[:-30]))
    record = wa.warc_record(1, "u", b"abc", wa.digest_of(b"abd"), None, False, "d")
    with pytest.raises(ValueError, match="digest"):
        wa.parse_record(record)
    with pytest.raises(ValueError, match="cut short"):
        wa.parse_record(record[:-10])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(wa.INDEX_MEMBER, "x" * 100)
    with pytest.raises(ValueError, match="not stored"):
        wa.PackageReader(_Bytes(out.getvalue())).index()


# Pseudo-likelihood


def test_gradients():
    rng = np.random.default_rng(2)
    net = pseudo_likelihood.WindowNetwork(7, 3)
    net.flat[:] = rng.normal(0, 0.5, len(net.flat))
    t, a = rng.integers(0, 7, 40), rng.integers(0, 8, (40, 4))
    before = net.flat.copy()
    net.square[:] = 1e12  # one step is then the gradient, scaled
    net.train(t, a, rate=1e6 * 1.0, batch=40)
    grad = before.astype(float) - net.flat
    for k in rng.integers(0, len(before), 25):
        for sign, out in ((1, []), (-1, [])):
            w = before.astype(np.float32).copy()
            w[k] += sign * 1e-2
            if sign == 1:
                up = -pseudo_likelihood.WindowNetwork(7, 3, w).log_probabilities(t, a).mean()
            else:
                down = -pseudo_likelihood.WindowNetwork(7, 3, w).log_probabilities(t, a).mean()
        assert grad[k] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_order_matters_to_the_score(spark, nothing):
    rng = random.Random(3)
    phrase = "the cat sat on a mat and the dog ran to the old red barn by night".split()
    rows = []
    for k in range(400):
        at = rng.randrange(len(phrase))
        rows.append((k, " ".join((phrase[at:] + phrase[:at]) * 4)))
    for k in range(400, 420):
        w = phrase * 4
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "cat")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(d, frequent=24, classes=4, width=8).collect()}
    assert max(got[k]["mean_log_likelihood"] for k in range(400, 420)) < min(got[k]["mean_log_likelihood"] for k in range(400))
    assert got[500]["log_likelihood"] == 0 and got[501]["mean_log_likelihood"] is None and got[502]["n_words"] == 1
    assert got[3]["log_likelihood"] == pytest.approx(got[3]["mean_log_likelihood"] * got[3]["n_words"])
    assert pseudo_likelihood.pseudo_likelihood(nothing).count() == 0


@pytest.mark.parametrize("common", [100_000, 5, 0])
def test_every_word_has_a_probability_of_its_own(spark, common):
    """Words of one class differ by their counts in the corpus, and the words of a class share its probability."""
    names = [w for w in (f"rare{k}" for k in range(200)) if zlib.crc32(w.encode()) % 2 == 1][:12]
    times = {w: k + 1 for k, w in enumerate(names)}
    rows = [(k, "some words that are often seen") for k in range(100)] + [(200, None)]
    rows += [(1000 + k, w) for k, w in enumerate(w for w, n in times.items() for _ in range(n))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    score = dict(d.join(pseudo_likelihood.pseudo_likelihood(d, frequent=6, classes=2, width=4, common=common), "doc_id").select("text", "log_likelihood").collect())
    for w, n in times.items():
        assert score[w] - score[names[0]] == pytest.approx(math.log(n), abs=1e-9)
    one = score[names[0]] - math.log(1 / sum(times.values()))  # the class alone
    assert sum(math.exp(score[w]) for w in names) == pytest.approx(math.exp(one))
    assert score[None] == 0


def test_scores_equal_brute_force_however_the_input_is_dealt(spark):
    """Each word's probability by loops: group, class in the group, share of the class; the same for 1 and 8 partitions."""
    rng = random.Random(12)
    names = ["w" + "abcdefgh"[k % 8] * (1 + k // 8) for k in range(60)]
    rows = [(k, " ".join(rng.choices(names, [1 / (j + 1) for j in range(60)], k=rng.randrange(0, 40)))) for k in range(120)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (500, None), (501, "  ?")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    settings = {"frequent": 20, "classes": 7, "width": 5}
    got = [sorted(map(tuple, pseudo_likelihood.pseudo_likelihood(d.repartition(n), common=9, **settings).select("doc_id", "n_words", "log_likelihood").collect()), key=str) for n in (1, 8)]
    assert len(got[0]) == len(rows)
    for a, b in zip(*got, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9)

    counts = Counter(w for _, t in rows if t for w in t.split() if w != "?")
    own = [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:20]]
    number = lambda w: own.index(w) if w in own else 20 + zlib.crc32(w.encode()) % 7
    totals = Counter()
    for w, n in counts.items():
        totals[number(w)] += n
    numbered = pseudo_likelihood._numbered(d, spark.sparkContext.broadcast((own, 7, [])))
    flat = pseudo_likelihood.train_network(numbered.select("doc_id", "ids"), sum(counts.values()), 27, width=5, rounds=2, rate=0.05)
    net = pseudo_likelihood.WindowNetwork(27, 5, flat)
    want = []
    for i, t in rows:
        w = [x for x in (t or "").split() if x != "?"]
        ids, total = [number(x) for x in w], 0.0
        for k, c in enumerate(ids):
            around = [ids[k + j] if 0 <= k + j < len(ids) else 27 for j in (-2, -1, 1, 2)]
            h = [math.tanh(sum(float(net.E[j][a][u]) for j, a in enumerate(around))) for u in range(5)]
            g, m = divmod(c, net.inner)
            outer = [sum(h[u] * float(net.U[u, x]) for u in range(5)) + float(net.b[x]) for x in range(net.groups)]
            inner = [sum(h[u] * float(net.V[g, u, x]) for u in range(5)) + float(net.c[g, x]) for x in range(min(net.inner, 27 - g * net.inner))]
            total += outer[g] - math.log(sum(map(math.exp, outer))) + inner[m] - math.log(sum(map(math.exp, inner)))
            total += math.log(counts[w[k]] / totals[c])
        want.append((i, len(w), total))
    for a, b in zip(got[0], sorted(want, key=lambda r: str(r)), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-5)


def test_likelihood_of_awkward_rows(spark, awkward):
    rows = pseudo_likelihood.pseudo_likelihood(awkward, frequent=30, classes=8, width=4).collect()
    assert len(rows) == awkward.count()
    by = Counter((r["doc_id"], r["n_words"]) for r in rows)
    assert by[None, 13] == 2 and by[7, 1] == 2 and by[6, 60_000] == 1 and by[3, 0] == by[4, 0] == by[5, 0] == 1
    assert all((r["mean_log_likelihood"] is None) == (r["n_words"] == 0) and (r["n_words"] == 0 or r["log_likelihood"] < 0) for r in rows)
    assert len({r["log_likelihood"] for r in rows if r["doc_id"] == 7}) == 1


def test_very_long_texts_are_numbered_run_by_run(monkeypatch):
    from cuewright.llm import common

    text = b"one two, THREE four--five six " * 40
    whole = [w for r in common.word_runs(text) for w in common.words(r)]
    for limit in (1, 5, 64):
        assert [w for r in common.word_runs(text, limit) for w in common.words(r)] == whole == common.words(text)
    assert list(common.word_runs(b"x" * 50, 10)) == [b"x" * 50] and list(common.word_runs(None)) == []


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    """Toxic documents, copies and benchmark passages go; what is clean stays and is packed whole."""
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item = text(30)
    docs = [(k, text(80)) for k in range(40)]
    docs += [(100 + k, docs[k][1]) for k in range(5)] + [(110 + k, docs[k][1] + " extra words") for k in range(5)]
    docs += [(200 + k, text(20) + " you pathetic idiot " + text(20)) for k in range(5)]
    docs += [(300, f"{text(40)} {item} {text(40)}"), (301, item), (400, None), (401, "")]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in now.collect()})
    clean = set(range(40)) | {300, 301, 400, 401}
    assert left[0] == clean | set(range(100, 105)) | set(range(110, 115))
    assert left[1] == clean
    assert left[2] == clean - {301}
    cut = next(r for r in now.collect() if r["doc_id"] == 300)
    assert item not in cut["text"] and cut["n_chars"] == len(cut["text"]) and cut["text"].split() == [w for w in docs[-4][1].replace(item, "").split()]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == left[2]


def test_five_word_shingles_are_the_default():
    import inspect

    assert inspect.signature(near_duplicates.near_duplicates).parameters["shingle_words"].default == 5


def test_toxic_texts_that_only_induced_voters_know():
    """Two fifths of the toxic texts have none of the words known beforehand; the label vouches for them."""
    rng = np.random.default_rng(3)
    y = (rng.random(12_000) < 1 / 3).astype(int)
    other = (y == 1) & (rng.random(len(y)) < 0.4)
    seeds = (rng.random((len(y), 40)) < np.where((y == 1) & ~other, 0.12, 0.0005)[:, None]).astype(float)
    induced = ((rng.integers(0, 6, len(y))[:, None] == np.arange(6)) & other[:, None] | (rng.random((len(y), 6)) < 0.001)).astype(float)
    model = toxicity.LabelModel(np.hstack((seeds, induced)), y, seeds=40)
    heard = other & induced.any(axis=1)
    assert (model.posterior[heard] >= 0.5).mean() > 0.95
    assert (model.posterior[y == 0] < 0.5).mean() > 0.99
