"""Keys that are cut into runs give what folding them in one piece gives."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest

from cuewright.operators import segmentation as D
from cuewright.streaming import events as R

SEGMENTS = "track_id long, seg_idx long, text string, start_ms long, end_ms long"
SENTENCES = "track_id long, sent_idx long, text string, start_ms long, end_ms long, n_words int, speaker string"


def _rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("run_rows", [3, 20, 64])
def test_rolling_segments_in_runs(spark, run_rows):
    rng, rows = random.Random(run_rows), []
    for t, n in ((1, 80), (None, 40), (2, 2), (3, 30)):
        text = ""
        for k in range(n):
            text = rng.choice([text + "ab", text[:-1], text, rng.choice(["a", "xy", "abab"]), "", None]) if text is not None else "z"
            rows.append((t, k, text, 10 * k, 10 * k + 5))
    rows += [(4, k, "a" * (999 - k), k, k + 1) for k in range(5 * run_rows + 20)]  # the first row outlasts all runs
    d = spark.createDataFrame(rows, SEGMENTS)
    assert _rows(D.dedup_rolling_segments(d, run_rows)) == _rows(D.dedup_rolling_segments(d))


@pytest.mark.parametrize("run_rows, most", [(3, 2), (20, 2), (64, 4)])
def test_packed_sentences_in_runs(spark, run_rows, most):
    rng, rows = random.Random(run_rows), []
    for t, n in ((1, 60), (None, 40), (2, 1), (3, 40)):
        at = 0
        for k in range(n):
            w = rng.choice([0, 1, 2, 3, 5, 14, 30]) if t != 3 else 2
            rows.append((t, k, " ".join(["w"] * w), at, at + 100 * w, w, rng.choice(["a", "a", None, "b"]) if t != 3 else "a"))
            at += 100 * w + rng.choice([0, 50, 3000]) if t != 3 else 200
    d = spark.createDataFrame(rows, SENTENCES)
    assert _rows(D.pack_sentences(d, max_sent=most, run_rows=run_rows)) == _rows(D.pack_sentences(d, max_sent=most))


@pytest.mark.parametrize("run_rows", [8, 20, 64])
def test_health_in_runs(spark, run_rows):
    rng, t0 = random.Random(run_rows), dt.datetime(2024, 1, 1, 23, 58)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("a", at(k * 3), rng.random() > 0.04) for k in range(100)]  # each round has five results, in one phase for ever
    rows += [("b", at(k * rng.choice([0.1, 0.7])), rng.random() > 0.1) for k in range(80)]
    rows += [(None, at(k), True) for k in range(40)] + [("c", t0, False), ("a", None, True), ("a", t0, None)]
    d = spark.createDataFrame(rows, "engine string, ts timestamp, ok boolean")
    assert _rows(R.provider_health(d, run_rows=run_rows)) == _rows(R.provider_health(d))


@pytest.mark.parametrize("run_rows", [7, 50])
def test_sentences_in_runs(spark, run_rows):
    rng, rows = random.Random(run_rows), []
    for t, n in ((1, 150), (2, 40), (3, 1)):
        rows += [(t, k, "w" + rng.choice(["", "", "", ",", "." if t == 2 else ","]), 10 * k, 10 * k + 5, rng.choice([None, "a", "a", "a", "b"]) if t == 2 else None) for k in range(n)]
    d = spark.createDataFrame(rows, "track_id long, word_idx long, text string, start_ms long, end_ms long, speaker string")
    assert _rows(D.merge_into_sentences(d, run_rows=run_rows)) == _rows(D.merge_into_sentences(d))


def test_no_rows(spark):
    for run_rows in (0, 5):
        assert D.dedup_rolling_segments(spark.createDataFrame([], SEGMENTS), run_rows).count() == 0
        assert D.pack_sentences(spark.createDataFrame([], SENTENCES), run_rows=run_rows).count() == 0


def test_a_hot_key_is_spread_over_tasks(spark):
    """Runs of one track are folded in several partitions, none with much more than its share."""
    d = spark.range(20_000).selectExpr("1L AS track_id", "id AS seg_idx", "concat('t', id % 97) AS text", "id AS start_ms", "id + 1 AS end_ms")
    out = D.dedup_rolling_segments(d, 2_000)
    sizes = [r["n"] for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert sum(sizes) == out.count() and len(sizes) >= 4 and max(sizes) <= 9_000
