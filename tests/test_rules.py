"""Rules by hand-computed cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import joins as J
from cuewright.operators import quality as Q
from cuewright.operators import segmentation as D
from cuewright.operators import tables as U
from cuewright.operators import timeline as W
from cuewright.operators import udfs as X
from cuewright.sources import subtitles as S
from cuewright.streaming import events as R


def value(spark, column, **columns):
    row = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def test_times(spark):
    assert value(spark, T.format_timecode(F.lit(1999))) == "00:00:01,999"
    assert value(spark, T.format_timecode(F.round(F.lit(1999.6)).cast("bigint"))) == "00:00:02,000"
    assert value(spark, T.format_timecode(F.lit(-1000))) == "00:00:00,000"
    assert value(spark, T.parse_timecode(F.lit("01:02:03.500"))) == 3_723_500
    assert value(spark, T.parse_timecode(F.lit("02:03,5"))) == 0


def test_counts(spark):
    assert [value(spark, T.count_words(F.lit(t))) for t in ("", "a  b", "— a!")] == [0, 2, 2]
    assert value(spark, T.count_words_nopunct(F.lit("— a!"))) == 1
    assert value(spark, T.count_words(F.lit(None).cast("string"))) == 0
    assert value(spark, T.target_words(F.lit(2500), F.lit(120))) == 5
    assert value(spark, T.target_words(F.lit(1250), F.lit(120))) == 2


def test_texts(spark):
    assert value(spark, T.parse_numbered_lines(F.lit("1. a\n2) [3.2s] b\nx"), F.lit(3))) == ["a", "b", ""]
    for text, ms, mood in [("what? really?", 1000, "comedic"), ("I miss you", 3000, "emotional"), ("Run!", 3000, "punchy"), ("the table is green", 4000, "neutral")]:
        assert value(spark, T.detect_emotion(F.lit(text), F.lit(""), F.lit(ms))) == mood
    assert value(spark, T.format_lines(F.lit("x" * 42))) == "x" * 42
    long = "a bb ccc dddd eeeee ffffff ggg, hh iii jjjj kkkkk llllll mmm"
    assert value(spark, T.format_lines(F.lit(long))) == "a bb ccc dddd eeeee ffffff ggg,\nhh iii jjjj kkkkk llllll mmm"
    assert value(spark, T.formal_to_spoken(F.lit("अतः वह अतःx"), {"अतः": "इसलिए"})) == "इसलिए वह इसलिएx"
    assert value(spark, T.split_text_chunks(F.lit("Aaa. Bbb. Cccccccccccc. D."), 10)) == ["Aaa. Bbb.", "Cccccccccccc.", "D."]
    assert value(spark, T.prepare_speech_text(F.lit("one two three four five six seven eight nine"), F.lit("en"))) == "one two three four five six seven, eight nine"
    assert value(spark, T.simplify_for_retry(F.lit("Hello there friend. More."), F.lit(3))) == "Hello there friend."
    assert value(spark, T.shorten_by_substitution(F.lit("in order to go now"), F.lit(3), {"in order to": "to"})) == "to go now"


def test_rolling_segments(spark):
    rows = [(1, k, t, k * 10, k * 10 + 5) for k, t in enumerate(["ab", "abc", "c", "xyz"])]
    got = D.dedup_rolling_segments(spark.createDataFrame(rows, "track_id long, seg_idx long, text string, start_ms long, end_ms long")).collect()
    assert [(r["text"], r["start_ms"]) for r in got] == [("abc", 10), ("xyz", 30)]


def test_runs_of_equal_text(spark):
    rows = [(1, k * 1000, t) for k, t in enumerate(["aaaa", "aaaa", "bbbb", "no", "bbbb"])]
    got = D.runs_of_equal_text(spark.createDataFrame(rows, "track_id long, ts_ms long, text string")).orderBy("seg_idx").collect()
    assert [(r["text"], r["start_ms"], r["end_ms"]) for r in got] == [("aaaa", 0, 2000), ("bbbb", 2000, 5000)]


def brute_cuts(cost):
    best = {0: (0.0, [])}
    for j in range(1, len(cost) + 1):
        options = [(best[i][0] + cost[i, j - i - 1], best[i][1] + [i]) for i in range(max(0, j - 16), j) if i in best and np.isfinite(cost[i, j - i - 1])]
        if options:
            best[j] = min(options, key=lambda o: o[0])
    return best.get(len(cost))


def test_optimal_cues():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        start = np.cumsum(rng.integers(150, 700, n)).astype(float)
        end = start + rng.integers(100, 400, n)
        text = [str(t) for t in rng.choice(["word", "longerword", "end.", "comma,", "x"], n)]
        speaker = [None if s == "n" else str(s) for s in np.repeat(rng.choice(["a", "b", "n"], n), 5)[:n]]
        term = [("t" if rng.random() < 0.1 else None) for _ in range(n)]
        cost = D.cue_costs(start, end, text, speaker, term)
        cuts, want = D.cheapest_cuts(cost), brute_cuts(cost)
        if want is None:
            assert cuts is None
        else:
            ends = [*cuts[1:], n]
            assert sum(cost[a, b - a - 1] for a, b in zip(cuts, ends, strict=True)) == pytest.approx(want[0])


def test_forbidden_cues():
    start, end = np.arange(0, 3000, 500.0), np.arange(400, 3400, 500.0)
    text = ["a"] * 6
    cost = D.cue_costs(start, end, text, ["x", "x", "y", "y", None, "y"], [None] * 6)
    assert np.isinf(cost[1, 1]) and np.isfinite(cost[2, 3])
    joined = D.cue_costs(start, end, text, [None] * 6, [None, "t", "t", None, None, None])
    assert np.isinf(joined[0, 1]) and np.isinf(joined[2, 2]) and np.isfinite(joined[1, 1])
    assert D.cheapest_cuts(D.cue_costs(np.array([0.0]), np.array([7000.0]), ["a"], [None], [None])) is None


def test_pack_sentences(spark):
    def packed(sizes):
        rows, at = [], 0
        for k, n in enumerate(sizes):
            rows.append((1, k, " ".join(["w"] * n), at, at + 100 * n, n, "s"))
            at += 100 * n
        d = spark.createDataFrame(rows, "track_id long, sent_idx long, text string, start_ms long, end_ms long, n_words int, speaker string")
        return [r["n_words"] for r in D.pack_sentences(d).orderBy("cue_idx").collect()]

    assert packed([5, 6, 4]) == [11, 4]
    assert packed([25]) == [13, 12]


def test_sections_and_stretch(spark):
    rows = [(1, 0, 0, 1000, 1050), (1, 1, 1050, 2050, 1500), (1, 2, 3000, 4000, 800)]
    clips = spark.createDataFrame(rows, "track_id long, seg_idx long, start_ms long, end_ms long, tts_ms long")
    got = W.sections_adaptive(clips, spark.createDataFrame([(1, 5000)], "track_id long, duration_ms long")).orderBy("sec_idx").collect()
    assert [(r["type"], r["pts_factor"], r["freeze"], r["output_ms"]) for r in got] == [
        ("speech", 1.05, False, 1050), ("speech", 1.1, True, 1500), ("gap", 1.0, False, 950), ("speech", 1.0, False, 1000), ("gap", 1.0, False, 1000)
    ]
    pairs = spark.createDataFrame([(500, 1000), (995, 1000), (1500, 1000), (30_000, 1000), (0, 5)], "audio_ms long, video_ms long")
    assert [r["regime"] for r in W.stretch_plan(pairs).collect()] == ["trim", "copy", "stretch", "stretch_freeze", "invalid"]


def test_recompute_slots(spark):
    rows = [(1, 0, 0, 2000, 3000), (1, 1, 2000, 4000, 1000)]
    cues = spark.createDataFrame([(*r, ["kept", "auto_padded:3ms"]) for r in rows], "track_id long, seg_idx long, start_ms long, end_ms long, tts_ms long, qc_flags array<string>")
    got = W.recompute_slots(cues).orderBy("seg_idx").collect()
    assert [(r["drift_ms"], r["status"], r["qc_flags"]) for r in got] == [(-307.7, "fail", ["kept"]), (1000.0, "fail", ["kept"])]
    with pytest.raises(ValueError, match="mode"):
        W.recompute_slots(cues, mode="odd")


def test_drift(spark):
    for a, b in ((50, 200), (200, 50)):
        assert [value(spark, W.classify_drift(F.lit(d), a, b)) for d in (49.9, 50.0, 199.9, -200.0)] == ["ok", "warn", "warn", "fail"]


def test_speech(spark):
    d = spark.createDataFrame([(1, 10), (2, 10)], "track_id long, duration_ms long")
    e = spark.createDataFrame([(1, 0, "start", 2), (1, 1, "end", 3), (1, 2, "start", 5)], "track_id long, ord long, kind string, t_ms long")
    got = sorted(tuple(r) for r in W.speech_intervals(e, d).collect())
    assert got == [(1, 0, 2), (1, 3, 5), (2, 0, 10)]


def test_speakers(spark):
    s = spark.createDataFrame([(1, 0, 0, 100, "t"), (1, 1, 500, 600, "t")], "track_id long, seg_idx long, start_ms long, end_ms long, text string")
    r = spark.createDataFrame([(1, "b", 0, 50), (1, "a", 50, 100)], "track_id long, speaker string, start_ms long, end_ms long")
    for bucket in (None, 30):
        assert {x["seg_idx"]: x["speaker"] for x in J.assign_speakers(s, r, bucket_ms=bucket).collect()} == {0: "b", 1: "SPEAKER_00"}


def test_quality(spark):
    cues = spark.createDataFrame([(1, 0, 0, 700, "two words"), (1, 1, 0, 3000, "")], "track_id long, seg_idx long, start_ms long, end_ms long, text string")
    assert Q.english_qc(cues).orderBy("seg_idx").first()["qc_flags"] == ["micro:0.7s", "no-punct"]
    assert Q.pre_tts_qc(cues, "text").orderBy("seg_idx").collect()[1]["qc_flags"] == ["empty-hindi"]


def test_states_and_nulls(spark):
    jobs = spark.createDataFrame([(1, "running"), (2, None), (3, "done"), (4, "??")], "id long, state string")
    assert {r["id"]: r["state"] for r in U.recover_states(jobs).collect()} == {1: "error", 2: "error", 3: "done", 4: "error"}
    words = spark.createDataFrame([(1, 0, None)], "track_id long, word_idx long, text string")
    assert U.normalize_words(words).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\r\n00:00:01,000 --> 00:00:03,000\r\n<i>Hello</i>,\r\nworld!\r\n\r\n2\r\n00:00:03.500 --> 00:00:06,000\r\n[SPEAKER_01] Next\r\n\r\n", encoding="utf-8")
    tolerant = S.read_srt_tolerant(spark, str(tmp_path / "a.srt")).orderBy("cue_idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in tolerant] == [(1000, 3000, "Hello, world!"), (3500, 6000, "[SPEAKER_01] Next")]
    strict = S.read_srt_corpus(spark, str(tmp_path / "a.srt")).orderBy("seg_idx").collect()
    assert strict[1]["speaker"] == "SPEAKER_01" and strict[1]["text"] == "Next"
    (tmp_path / "b.vtt").write_text(
        "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\nthe<00:00:01.500><c> quick</c><00:00:02.000><c> fox</c>\n\n00:00:02.900 --> 00:00:05.000\nthe quick fox\njumps<00:00:04.000><c> [music]</c><c> over</c>\n\n00:00:06.000 --> 00:00:07.000\n[Music]\n"
    )
    words = S.read_vtt_words(spark, str(tmp_path / "b.vtt")).orderBy("word_idx").collect()
    assert [r["text"] for r in words][:3] == ["the", "quick", "fox"] and words[1]["start_ms"] == 1500 and words[0]["end_ms"] == 1500
    assert S.read_vtt_segments(spark, str(tmp_path / "b.vtt")).count() == 2
    (tmp_path / "p.json").write_text('{"a": "b", "_x": "y", "n": 3, "m": "7"}')
    assert {(r["src"], r["dst"]) for r in S.read_pronunciation(spark, str(tmp_path / "p.json")).collect()} == {("a", "b"), ("m", "7")}
    (tmp_path / "g.json").write_text('[{"canonical": "Foo", "aliases": ["Fu"]}, {"aliases": []}]')
    g = S.read_glossary(spark, str(tmp_path / "g.json")).collect()
    assert len(g) == 1 and g[0]["action"] == "keep" and g[0]["aliases"] == ["Fu"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, 2000, "Hello, world!", "A"), (1, 1, 3000, 5000, " ", "A"), (2, 0, 5, 6, "x", None)], "track_id long, seg_idx long, start_ms long, end_ms long, text string, speaker string")
    S.write_srt(rows, str(tmp_path / "srt"))
    text = spark.read.text(str(tmp_path / "srt"), wholetext=True).filter("track_id = 1").first()["value"]
    assert text.startswith("1\n00:00:00,000 --> 00:00:02,000\nHello, world!\n") and "2\n" not in text
    S.write_webvtt(rows, str(tmp_path / "vtt"))
    S.export_tts_csv(rows, str(tmp_path / "csv"))
    S.export_cues_json(rows, str(tmp_path / "json"))
    S.export_srt(rows.withColumn("text_hi_raw", F.col("text")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    S.write_stage(rows, str(tmp_path / "stages"), "transcribe")
    assert S.read_stage(spark, str(tmp_path / "stages"), "transcribe").count() == 3
    jobs = spark.createDataFrame([(1, "running", ("u", "hi", "e", {"download": 1.5}))], "id long, state string, payload struct<source_url:string,target_language:string,tts_engine:string,step_times:map<string,double>>")
    S.write_job_store(jobs, str(tmp_path / "jobs"))
    back = S.read_job_store(spark, str(tmp_path / "jobs")).first()
    assert back["state"] == "error" and back["payload"]["step_times"] == {"download": 1.5}


def test_sql_functions(spark):
    X.register_sql(spark)
    r = spark.sql("SELECT similarity_ratio('abcd', 'bcde') AS s, format_srt_time(61001) AS t, overlap_ms(0, 5, 3, 9) AS o").first()
    assert (r["s"], r["t"], r["o"]) == (0.75, "00:01:01,001", 2)


def _events(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)
    rows = [(1, 0, t(0), "download", 0.1, "running"), (1, 1, t(4), "extract", 0.5, "running"), (1, 2, t(10), "extract", 1.0, "done"), (1, 2, t(10), "extract", 1.0, "done"), (2, 0, t(3), "download", 0.2, "running")]
    schema = "job_id long, seq long, ts timestamp, step string, progress double, state string"
    stream = _events(spark, tmp_path, rows, schema)
    batch = spark.createDataFrame(rows, schema)
    _run(R.dedup_events(stream), "dedup", "append")
    assert spark.sql("SELECT * FROM dedup").count() == R.dedup_events(batch).count() == 4
    _run(R.job_state_latest(stream), "latest", "update")
    assert {(r["job_id"], r["state"], r["terminal"]) for r in spark.sql("SELECT * FROM latest").collect()} == {(1, "done", True), (2, "running", False)}
    _run(R.event_windows(stream, "1 minute"), "windows", "update")
    assert spark.sql("SELECT sum(n) AS n FROM windows").first()["n"] == 5
    _run(R.overall_progress(stream), "overall", "append")
    assert spark.sql("SELECT max(overall) AS o FROM overall").first()["o"] == 0.2


def test_stateful_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)
    rows = [(1, 0, t(0), "download"), (1, 1, t(4), "extract"), (1, 2, t(10), "extract"), (2, 0, t(3), "download")]
    schema = "job_id long, seq long, ts timestamp, step string"
    _run(R.step_times_stream(_events(spark, tmp_path, rows, schema)), "steps", "update")
    got = {(r["job_id"], r["step"]): r["seconds"] for r in spark.sql("SELECT * FROM steps").collect()}
    assert got == {(r["job_id"], r["step"]): r["seconds"] for r in R.step_times(spark.createDataFrame(rows, schema)).collect()} == {(1, "download"): 4.0, (1, "extract"): 6.0, (2, "download"): 0.0}


def test_health(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)
    rows = [("a", t(k * 3), k != 0) for k in range(9)] + [("b", t(k), True) for k in range(3)]
    schema = "engine string, ts timestamp, ok boolean"
    last = R.provider_health(spark.createDataFrame(rows, schema)).groupBy("engine").agg(F.max_by("health", "ts").alias("health"))
    batch = {r["engine"]: r["health"] for r in last.collect()}
    _run(R.provider_health_stream(_events(spark, tmp_path, rows, schema)), "health", "update")
    assert {r["engine"]: r["health"] for r in spark.sql("SELECT * FROM health").collect()} == batch == {"a": "degraded", "b": "healthy"}


def _random_words(seed, n=300):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    speaker = None
    for k in range(n):
        if rng.random() < 0.05:
            speaker = [None, "a", "b"][int(rng.integers(3))]
        word = "w" + ["", "", "", "", ",", "."][int(rng.integers(6))] if k > 120 else "w" + ["", "", ","][int(rng.integers(3))]
        rows.append((1, k, word, at, at + 300, speaker))
        at += 400
    return rows


WORDS = "track_id long, word_idx long, text string, start_ms long, end_ms long, speaker string"


def test_sentences_by_fold(spark):
    rows, want, n = _random_words(3), [], 0
    for k, (_, _, word, _, _, speaker) in enumerate(rows):
        if n and rows[k - 1][5] is not None and speaker is not None and rows[k - 1][5] != speaker:
            want.append(n)
            n = 0
        n += 1
        if word[-1] == "." or (word[-1] == "," and n >= 15) or n >= 25:
            want.append(n)
            n = 0
    want += [n] if n else []
    got = D.merge_into_sentences(spark.createDataFrame(rows, WORDS)).orderBy("sent_idx").collect()
    assert [r["n_words"] for r in got] == want
    assert " ".join(r["text"] for r in got) == " ".join(r[2] for r in rows)


def test_greedy_cues_by_fold(spark):
    rows, want, first = _random_words(5), [], 0
    for k, (_, _, word, _, end, _) in enumerate(rows):
        if word[-1] == "." or end - rows[first][3] >= 4500 or k - first + 1 >= 14:
            want.append(k - first + 1)
            first = k + 1
    want += [len(rows) - first] if first < len(rows) else []
    got = D.build_cues_greedy(spark.createDataFrame(rows, WORDS)).orderBy("cue_idx").collect()
    assert [r["n_words"] for r in got] == want


def test_rolling_words(spark):
    rows = [(1, 0, "a", 1000, False), (1, 1, "a", 1003, False), (1, 2, "b", 1500, False), (1, 3, "c", 1400, True), (1, 4, "d", 1600, True), (1, 5, "a", 1700, True)]
    got = D.dedup_rolling_words(spark.createDataFrame(rows, "track_id long, word_idx long, text string, start_ms long, plain boolean")).orderBy("word_idx").collect()
    assert [(r["word_idx"], r["text"], r["start_ms"]) for r in got] == [(0, "a", 1000), (1, "b", 1500), (2, "d", 1600), (3, "a", 1700)]
