"""Operators whose state runs along a track, and those that call the caller's functions, by brute force."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import joins as J
from cuewright.operators import quality as Q
from cuewright.operators import segmentation as D
from cuewright.operators import udfs as X
from cuewright.streaming import events as R

WORDS = "track_id long, word_idx long, text string, start_ms long, end_ms long, speaker string, term_id string"


def tracks(seed):
    rng, rows = np.random.default_rng(seed), []
    for t in range(5):
        at, who = 0, None
        for k in range(int(rng.integers(1, 300))):
            if rng.random() < 0.05:
                who = [None, "a", "b"][int(rng.integers(3))]
            at += int(rng.integers(150, 700))
            late = 9000 if seed == 2 and t == 1 and k == 20 else int(rng.integers(100, 400))  # no cue may hold that word
            rows.append((t, k, str(rng.choice(["word", "longerword", "end.", "comma,", "x"])), at, at + late, who, "t" if rng.random() < 0.1 else None))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_cues_of_runs_cost_what_those_of_whole_tracks_do(spark, seed):
    rows = tracks(seed)
    d = spark.createDataFrame(rows, WORDS)

    def total(cues, t):
        own = [r for r in rows if r[0] == t]
        cost = D.cue_costs(*(np.array([r[k] for r in own], float) for k in (3, 4)), *([r[k] for r in own] for k in (2, 5, 6)))
        at, out = 0, 0.0
        for c in sorted((c for c in cues if c["track_id"] == t), key=lambda c: c["cue_idx"]):
            assert c["text"] == " ".join(r[2] for r in own[at : at + c["n_words"]]) and c["start_ms"] == own[at][3]
            out += cost[at, c["n_words"] - 1] if c["method"] == "optimal" else 0
            at += c["n_words"]
            assert c["end_ms"] == own[at - 1][4]
        assert at == len(own)
        return out, {c["method"] for c in cues if c["track_id"] == t}

    whole = D.build_cues_dp(d).collect()
    greedy = sorted(map(tuple, D.build_cues_greedy(d).collect()))
    for run in (16, 33, 100):
        cut = D._cues(d, True, run).collect()
        for t in range(5):
            (a, how_a), (b, how_b) = total(whole, t), total(cut, t)
            assert a == pytest.approx(b) and how_a == how_b
        assert sorted(map(tuple, cut)) == sorted(map(tuple, whole))
        assert sorted(map(tuple, D._cues(d, False, run).collect())) == greedy


def test_runs_choose_the_same_of_equally_cheap_cues(spark):
    """Even words make many segmentations of equal cost; runs take the one that the whole track takes."""
    rows = [(t, k, "word" if k % 29 else "end.", 500 * k, 500 * k + 300 + 50 * (t % 2), None, None) for t in range(4) for k in range(700 + t)]
    d = spark.createDataFrame(rows, WORDS)
    whole = sorted(map(tuple, D.build_cues_dp(d).collect()))
    for run in (20, 64, 500):
        assert sorted(map(tuple, D._cues(d, True, run).collect())) == whole


def test_rolling_segments_by_fold(spark):
    rng = random.Random(3)
    rows = []
    for t in range(4):
        for k in range(40):
            w = ["a", "ab", "abc", "b", "bc", "zz", "z", None, ""]
            rows.append((t, k, rng.choice(w), k * 10, k * 10 + 5))
    want = []
    for t in range(4):
        kept = []
        for _, _, text, a, b in (r for r in rows if r[0] == t):
            last = kept[-1][0] if kept else None
            if kept and text is not None and last is not None and last in text:
                kept[-1] = (text, a, b)
            elif not (kept and text is not None and last is not None and text in last):
                kept.append((text, a, b))
        want += [(t, k, *r) for k, r in enumerate(kept)]
    d = spark.createDataFrame(rows, "track_id long, seg_idx long, text string, start_ms long, end_ms long").repartition(3)
    assert sorted(map(tuple, D.dedup_rolling_segments(d).collect()), key=str) == sorted(want, key=str)
    assert D.dedup_rolling_segments(d.limit(0)).count() == 0


def test_packed_sentences_by_fold(spark):
    rng = random.Random(4)
    rows = []
    for t in range(5):
        at = 0
        for k in range(60):
            n = rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 13, 30])
            rows.append((t, k, " ".join(f"w{k}x{j}" for j in range(n)), at, at + 300 * n, n, rng.choice(["a", "b", "", None])))
            at += 300 * n + 50
    want = []
    for t in range(5):
        out = []
        for _, _, text, a, b, n, who in (r for r in rows if r[0] == t):
            words, budget = text.split(), 13
            if n > budget:
                out += [[words[k : k + budget], a + (b - a) * k // n, a + (b - a) * min(k + budget, n) // n, who, who, 1, True] for k in range(0, n, budget)]
                continue
            h = out[-1] if out else None
            if h and not h[6] and h[5] < 2 and len(h[0]) + n <= budget and b - h[1] <= 5500 and (who in (None, "", h[4]) or h[4] in (None, "")):
                h[0], h[2], h[4], h[5] = h[0] + words, b, who, h[5] + 1
            else:
                out.append([words, a, b, who, who, 1, False])
        want += [(t, k, a, b, " ".join(w), len(w), n, who) for k, (w, a, b, who, _, n, _) in enumerate(out)]
    d = spark.createDataFrame(rows, "track_id long, sent_idx long, text string, start_ms long, end_ms long, n_words int, speaker string")
    assert sorted(map(tuple, D.pack_sentences(d).collect()), key=str) == sorted(want, key=str)


def test_health_goes_on_past_midnight(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1, 23, 58)
    rows = [("a", t0 + dt.timedelta(seconds=k * 0.7), rng.random() > 0.04) for k in range(400)] + [("b", dt.datetime(2024, 1, 1, 23, 59, 59), False), ("b", dt.datetime(2024, 1, 2, 0, 0, 1), True), (None, t0, True)]
    rows += [("a", None, True), ("a", t0, None)]
    got = {(r["engine"], r["ts"]): r["health"] for r in R.provider_health(spark.createDataFrame(rows, "engine string, ts timestamp, ok boolean").repartition(4)).collect()}
    health, n, good, since = "healthy", 0, 0, None
    for engine, ts, ok in rows[:400]:
        since = since or ts
        n, good = n + 1, good + ok
        ends = (ts - since).total_seconds() >= 10 and n >= 5
        health = "degraded" if not ok else "healthy" if ends and good / n > 0.95 else "struggling" if ends and good / n < 0.8 else health
        if ends:
            n, good, since = 0, 0, None
        assert got[engine, ts] == health
    assert got["b", dt.datetime(2024, 1, 2, 0, 0, 1)] == "degraded" and got[None, t0] == "healthy" and len(got) == 403


def test_each_function_meets_a_row_once(spark, tmp_path):
    def caller(name, answer):
        def call(text, _hints):
            with open(Path(tmp_path) / name, "a") as f:
                f.write(text + "\n")
            return answer(text)

        return call

    d = spark.createDataFrame([(k, f"text number {k}", "x") for k in range(40)] + [(98, "  ", "x"), (99, None, "x")], "id long, text string, _todo string").repartition(4)
    fns = [caller("first", lambda t: "good " + t if random.random() < 0.5 else ""), caller("second", lambda t: "fine " + t if random.random() < 0.5 else "")]
    out = X.with_retry_fallback(d, fns, T.is_bad_translation)
    assert out.columns == [*d.columns, "text_translated"]
    rows = {r["id"]: r for r in out.filter("id is not null").collect()}
    assert len(rows) == 42 and rows[99]["text_translated"] is None and rows[98]["text_translated"] == "  "
    first, second = (sorted((tmp_path / n).read_text().splitlines()) for n in ("first", "second"))
    assert first == sorted(f"text number {k}" for k in range(40))
    by = {k: rows[k]["text_translated"].split()[0] for k in range(40)}
    assert len(second) == len(set(second)) == sum(v != "good" for v in by.values())
    assert all((v == "text") == (rows[k]["text_translated"] == rows[k]["text"]) for k, v in by.items())


def test_shorter_texts(spark):
    def short(text, target, **more):
        d = spark.createDataFrame([(text,)], "t string")
        return d.select(T.shorten_by_substitution(F.col("t"), F.lit(target), more.pop("subs", {}), **more).alias("v")).first()["v"]

    text = "one two three, four five, six seven eight nine, ten eleven"
    assert short(text, 20) == text
    assert short(text, 9) == "one two three, four five, six seven eight nine।"  # of equal clauses the last goes
    assert short(text, 9, protected=["ten"]) == "one two three, six seven eight nine, ten eleven।"
    assert short(text, 3, protected=["four", "six", "ten"]) == text
    assert short("one, two। three four। five", 3) == "one।" and short("one two। three four। five six", 4) == "one two। three four।"
    assert short("a long form and a long form here", 6, subs={"a long form": "it"}) == "it and a long form here"
    assert short("a long form and more", 3, subs={"a long form": "it"}, protected=["it"]) == "a long form and more"
    assert short("well so we go well on", 4, fillers=["well ", "so "]) == "we go well on"
    assert short(None, 3) is None and short("", 3) == ""
    long = spark.createDataFrame([("a b c, d e f, g h", 1000)], "t string, ms long")
    assert long.select(T.compress_if_needed(F.col("t"), F.col("ms"), {}).alias("v")).first()["v"] == "a b c, d e f।"


def test_rules_before_speech(spark):
    rows = [
        (0, 2000, "aa bb cc dd ee ff gg hh.", "src", ["Foo", "aa"], None),
        (0, 1500, "word", "a foo here", ["Foo"], None),
        (0, 9000, "the dog, the cat, the fly and and and", "x", None, "short\n" + "y" * 43 + "\n" + "z" * 50),
        (0, 500, None, "x", ["Foo"], None),
    ]
    d = spark.createDataFrame(rows, "start_ms long, end_ms long, text_translated string, text string, protected_terms array<string>, text_hi_display string")
    got = [r["qc_flags"] for r in Q.pre_tts_qc(d).collect()]
    assert got == [["hi-overlong:4.0s>2.0s", "glossary-miss:Foo"], ["hi-micro", "hi-no-punct"], ["repeated:and", "hi-cpl:43"], ["empty-hindi"]]


def test_interval_joins_keep_every_row(spark):
    rng = random.Random(6)
    left = [(t, k, s := rng.randrange(0, 3000), s + rng.choice([0, 10, 200, 900])) for t in (1, 2, None) for k in range(40)] + [(1, 90, None, 5), (1, 91, 5, None), (3, 0, 0, 10), (3, 0, 0, 10)]
    right = [(t, k, s := rng.randrange(0, 3000), s + rng.choice([0, 10, 200, 900])) for t in (1, 2, None) for k in range(40)] + [(1, 90, None, 5)]
    a, b = (spark.createDataFrame(r, f"track_id long, {n} long, start_ms long, end_ms long").repartition(3) for r, n in ((left, "seg_idx"), (right, "ref_idx")))
    for slack in (0, 50):
        want = []
        for row in left:
            hits = [r for r in right if None not in (*row, *r) and r[0] == row[0] and min(row[3], r[3]) - max(row[2], r[2]) > -slack]
            want += [(*row, r[1]) for r in hits] or [(*row, None)]
        for bucket in (None, 70, 1000):
            got = [(*tuple(r)[:4], r["r"] and r["r"]["ref_idx"]) for r in J.interval_join(a, b, slack_ms=slack, bucket_ms=bucket).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
            inner = J.interval_join(a, b, slack_ms=slack, bucket_ms=bucket, how="inner").count()
            assert inner == sum(w[4] is not None for w in want)


def test_terms_are_found_anywhere(spark):
    cues = [(1, k, t) for k, t in enumerate(["The Cat sat", "concatenate", "x", "", None, "a b\nc", "Übergröße"])]
    terms = [(0, "cat"), (1, "X"), (2, "b\nc"), (3, "größe"), (4, ""), (5, "at s"), (6, None)]
    c = spark.createDataFrame(cues, "track_id long, seg_idx long, text string")
    g = spark.createDataFrame([(o, t, "", "keep", "") for o, t in terms], "ord long, canonical string, target_spelling string, action string, pronunciation string")
    want = {k: [x for _, x in terms if x and t is not None and x.lower() in t.lower()] for _, k, t in cues}
    assert {r["seg_idx"]: r["protected_terms"] for r in J.glossary_tag_cues(c, g).collect()} == want
    for block in (1, 3, 2_000_000):
        rows = J._with_terms(c, g, "text", block).collect()
        assert {r["seg_idx"]: [t["canonical"] for t in r["_terms"]] for r in rows} == want


def test_terms_do_not_depend_on_keys_or_the_glossarys_size(spark):
    few = [(o, w, "", "keep", "") for o, w in enumerate(["alpha", "Beta", "alp", "alpha", "a b"])]
    many = few + [(o, f"term{o}x", f"T{o}", "fixed_translation", "say") for o in range(10, 100_000)]
    cues = [(1, 0, "alpha here"), (1, 0, "beta here"), (None, 3, "alpha"), (1, 0, "alpha here"), (None, None, None), (2, 1, "a b term500x term5")]
    schema = "ord long, canonical string, target_spelling string, action string, pronunciation string"
    c = spark.createDataFrame(cues, "track_id long, seg_idx long, text string").coalesce(1)
    got = []
    for terms, block in ((few, 2_000_000), (many, 2_000_000), (many, 300_000)):
        g = spark.createDataFrame(terms, schema)
        rows = J.glossary_tag_cues(c, g, block_chars=block).select("track_id", "seg_idx", "text", "protected_terms").collect()
        got.append(sorted((str(tuple(r)[:3]), [t for t in r[3] if not t.startswith("term")]) for r in rows))
        last = next(r for r in rows if r["track_id"] == 2)["protected_terms"]
        assert last == ["a b"] + (["term500x"] if terms is many else [])
    assert got[0] == got[1] == got[2]
    assert [x for k, x in got[0] if "alpha here" in k] == [["alpha", "alp", "alpha"]] * 2
    none = J.glossary_validate(c.withColumn("text_translated", c["text"]), spark.createDataFrame([], schema))
    assert none.count() == len(cues) and none.filter("size(qc_flags) > 0").count() == 0


def test_reference_texts_are_compared_whole(spark):
    """Edit distances in characters, not bytes, over all of both texts."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(9)
    text = lambda: "".join(rng.choices("aébçdß ", k=rng.choice([0, 5, 150, 260])))
    ours = [(1, k, k * 1000, k * 1000 + 800, text()) for k in range(12)]
    theirs = [(1, k, k * 1000 + 300, k * 1000 + 900, ours[k][4][:-3] + "xyz" if k % 2 else text()) for k in range(12) if k != 5]
    a, b = (spark.createDataFrame(r, f"track_id long, {n} long, start_ms long, end_ms long, text string") for r, n in ((ours, "seg_idx"), (theirs, "ref_idx")))
    got = {r["seg_idx"]: (r["best_ref"], r["ratio"], r["status"]) for r in J.align_reference(a, b, mode="text", fast=True).collect()}
    for _, k, s, e, t in ours:
        near = [(round(1 - distance(t.lower(), x[4].lower()) / max(len(t), len(x[4]), 1), 4), -x[1]) for x in theirs if min(e, x[3]) - max(s, x[2]) > -2000]
        best = max(near)
        assert got[k] == (-best[1], pytest.approx(best[0], abs=1e-4), "MATCH" if best[0] >= 0.5 else "MISMATCH")


def test_speech_texts_by_loops(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choices(["one", "two,", "three.", "5", "12", "x7", "…", "a—b", "well...", "ok!", "100"], k=rng.randrange(0, 30))) for _ in range(80)] + ["", "a, , b,", None]

    def want(text, digits):
        import re

        t = re.sub(r"\.{2,}", ",", text).replace("—", ", ").replace("–", ", ")
        if digits:
            for d, w in sorted(T.SPOKEN_DIGITS.items(), key=lambda kv: -len(kv[0])):
                t = re.sub(rf"(?<!\w){d}(?!\w)", w, t)
        words, run, out = t.split(), 0, []
        for w in words:
            run += 1
            if w[-1] in ",।!?":
                run = 0
            elif run >= 7:
                w, run = w + ",", 0
            out.append(w)
        t = " ".join(out) if len(words) > 8 else t
        t = re.sub(r",\s*([।!?])", r"\1", re.sub(r",\s*,", ",", t))
        return re.sub(r",+$", "", t.strip(" ")).replace("well", "wel")

    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    for lang in ("hi", "en"):
        got = {r["k"]: r["v"] for r in d.select("k", T.prepare_speech_text(F.col("t"), F.lit(lang), {"well": "wel"}).alias("v")).collect()}
        assert got == {k: None if t is None else want(t, lang == "hi") for k, t in enumerate(texts)}


def test_similar_reference_texts_by_loops(spark):
    from difflib import SequenceMatcher

    rng = random.Random(11)
    ours = [(t, k, k * 1500, k * 1500 + 900, "".join(rng.choices("abcX ", k=rng.randrange(0, 40)))) for t in (1, 2) for k in range(15)]
    theirs = [(t, k, k * 1500 + 400, k * 1500 + 1000, rng.choice([x for x in ours if x[0] == t and abs(x[1] - k) < 2])[4].upper()) for t in (1, 2) for k in range(0, 15, 2)]
    a, b = (spark.createDataFrame(r, f"track_id long, {n} long, start_ms long, end_ms long, text string") for r, n in ((ours, "seg_idx"), (theirs, "ref_idx")))
    for bucket in (None, 1000, 60_000):
        got = {(r["track_id"], r["seg_idx"]): (r["best_ref"], r["ratio"], r["status"]) for r in J.align_reference(a, b, mode="text", bucket_ms=bucket).collect()}
        assert len(got) == len(ours)
        for t, k, s, e, text in ours:
            near = [(SequenceMatcher(None, text.lower(), x[4].lower()).ratio(), -x[1]) for x in theirs if x[0] == t and min(e, x[3]) - max(s, x[2]) > -2000]
            best = max((round(r, 4), i) for r, i in near)
            assert got[t, k] == (-best[1], pytest.approx(best[0], abs=1e-4), "MATCH" if best[0] >= 0.5 else "MISMATCH")
