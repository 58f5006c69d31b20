"""Tracks that are cut into parts give what windows over whole tracks give."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuewright.operators import segmentation as D
from cuewright.operators import timeline as W
from cuewright.operators.scans import Scan, in_order


def _rows(df):
    return Counter(tuple(str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("hot_rows", [5, 40])
def test_scans_equal_windows(spark, hot_rows):
    rng = random.Random(hot_rows)
    rows = [(t, k, rng.choice([None, *range(9)])) for t, n in ((1, 120), (None, 60), (2, 3), (3, 41)) for k in range(n)]
    d = spark.createDataFrame(rows, "track_id long, seg_idx long, v long").repartition(3)
    scans = {k: Scan(k, F.col("v")) for k in ("sum_before", "sum_through", "max_through", "lag", "lead", "first", "sum_all", "max_all")}
    one, many = in_order(d, "seg_idx").scan(**scans), in_order(d, "seg_idx", hot_rows=hot_rows).scan(**scans)
    assert many.cut and not one.cut and many.done().columns == one.done().columns
    assert _rows(many.done()) == _rows(one.done())
    # a second scan reads what the first one gave
    again = [o.with_columns(w=F.col("sum_before") + 1).scan(last=Scan("lag", F.col("w"))).done() for o in (one, many)]
    assert _rows(again[0]) == _rows(again[1])
    assert in_order(d.limit(0), "seg_idx").scan(**scans).done().count() == 0


@pytest.mark.parametrize("hot_rows", [7, 50])
def test_timelines_in_parts(spark, hot_rows):
    rng, rows = random.Random(hot_rows), []
    for t, n in ((1, 90), (2, 30), (None, 20)):
        at = 0
        for k in range(n):
            at += rng.choice([0, 0, 300])
            size = rng.choice([0, 400, 900, 1500])
            rows.append((t, k, at, at + size, None if rng.random() < 0.1 else int(size * rng.choice([0.8, 1.0, 1.5])), ["auto_padded:1ms", "x"]))
            at += size
    d = spark.createDataFrame(rows, "track_id long, seg_idx long, start_ms long, end_ms long, tts_ms long, qc_flags array<string>")
    assert _rows(W.zero_gap_timeline(d, 5, hot_rows)) == _rows(W.zero_gap_timeline(d, 5))
    for mode in ("original", "capped", "audio_first"):
        assert _rows(W.recompute_slots(d, mode, hot_rows=hot_rows)) == _rows(W.recompute_slots(d, mode))


@pytest.mark.parametrize("hot_rows", [7, 50])
def test_sentences_and_equal_texts_in_parts(spark, hot_rows):
    rng = random.Random(hot_rows)
    words = [(t, k, rng.choice(["w"] * 20 + ["end.", "Mr."]) if t == 1 else "w", 10 * k, 10 * k + 5, "s") for t, n in ((1, 150), (2, 60), (3, 1)) for k in range(n)]
    d = spark.createDataFrame(words, "track_id long, word_idx long, text string, start_ms long, end_ms long, speaker string")
    assert _rows(D.split_terminator_sentences(d, hot_rows=hot_rows)) == _rows(D.split_terminator_sentences(d))
    texts = [(t, 1000 * k, rng.choice(["same text", "same text", "other", "no", None])) for t, n in ((1, 150), (2, 20)) for k in range(n)]
    f = spark.createDataFrame(texts, "track_id long, ts_ms long, text string")
    assert _rows(D.runs_of_equal_text(f, hot_rows=hot_rows)) == _rows(D.runs_of_equal_text(f))
