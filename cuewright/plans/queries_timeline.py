"""Queries of timelines, segmentation and job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import segmentation as D
from ..operators import timeline as W
from ..streaming import events as R
from ..streaming.jobs import stuck_jobs_stream
from ..streaming.runs import run_available
from . import flow
from .registry import query
from .view_sql import SLOTS_SQL

_ID = "track_id b, seg_idx b"
_W = "OVER (PARTITION BY track_id ORDER BY word_idx)"
_S = "OVER (PARTITION BY track_id ORDER BY seg_idx)"


@query("w01_word_end_times", "track_id b, word_idx b, end_ms b", "words", f"SELECT track_id, word_idx, CASE WHEN e <= start_ms THEN start_ms + 100 ELSE e END AS end_ms FROM (SELECT *, coalesce(lead(start_ms) {_W}, start_ms + 500) AS e FROM words)")
def _(v):
    return W.word_end_times(v.words)


@query("w02_gap_before", "track_id b, word_idx b, gap_ms b, pause s", "words", f"SELECT *, CASE WHEN gap_ms > 500 THEN 'strong' WHEN gap_ms > 300 THEN 'soft' ELSE 'none' END AS pause FROM (SELECT *, start_ms - lag(end_ms) {_W} AS gap_ms FROM words)")
def _(v):
    return W.gap_before(v.words)


@query("w03_speed_fit", f"{_ID}, ratio d, new_ms b", "clips", "SELECT track_id, seg_idx, round(f, 4) AS ratio, round(tts_ms / f)::BIGINT AS new_ms FROM (SELECT *, CASE WHEN slot_ms < 100 OR tts_ms < 100 OR tts_ms / slot_ms BETWEEN 0.95 AND 1.05 THEN 1.0 ELSE greatest(1 / 1.1::DOUBLE, least(1.25, tts_ms / slot_ms)) END AS f FROM clips)")
def _(v):
    return W.speed_fit(v.clips)


def _section_sql(pos: str, factor: str, freeze: str, out: str) -> str:
    return f"""
    WITH c AS (SELECT *, end_ms - start_ms AS slot, tts_ms / greatest(end_ms - start_ms, 1) AS r, coalesce({pos}, 0) AS pos FROM clips),
    rows AS (
        SELECT track_id, seg_idx, 0 AS k, 'gap' AS type, pos AS a, start_ms AS b, 1.0::DOUBLE AS f, false AS z, start_ms - pos AS o FROM c WHERE start_ms > pos + 50
        UNION ALL SELECT track_id, seg_idx, 1, 'speech', start_ms, end_ms, round({factor}, 4), {freeze}, {out} FROM c
        UNION ALL SELECT track_id, m, 9, 'gap', e, d, 1.0, false, d - e FROM (SELECT track_id, max(seg_idx) AS m, max(end_ms) AS e, max(end_ms) + 1000 AS d FROM c GROUP BY track_id))
    SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx, k) - 1 AS sec_idx, type, a AS video_start_ms, b AS video_end_ms, f AS pts_factor, z AS "freeze", o AS output_ms FROM rows"""


_SECTION = "track_id b, sec_idx b, type s, video_start_ms b, video_end_ms b, pts_factor d, freeze o, output_ms b"


@query("w04_sections_adaptive", _SECTION, "clips", _section_sql(f"max(end_ms) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "CASE WHEN r <= 1 THEN 1.0 WHEN r <= 1.1 THEN r ELSE 1.1 END", "r > 1.1", "CASE WHEN r <= 1 THEN slot ELSE tts_ms END"))
def _(v):
    return W.sections_adaptive(v.clips, v.durations.withColumn("duration_ms", F.col("duration_ms") + 1000))


@query("w05_sections_synced", _SECTION, "clips", _section_sql(f"lag(end_ms) {_S}", "greatest(1 / 1.1::DOUBLE, least(1.25, r))", "false", "round(slot * greatest(1 / 1.1::DOUBLE, least(1.25, r)))::BIGINT"))
def _(v):
    return W.sections_synced(v.clips, v.durations.withColumn("duration_ms", F.col("duration_ms") + 1000))


@query("w06_clip_overlaps", f"{_ID}, start_ms b, end_ms b", "segments durations", f"SELECT track_id, seg_idx, greatest(start_ms, coalesce(lag(e) {_S}, start_ms)) AS start_ms, e AS end_ms FROM (SELECT s.track_id, seg_idx, start_ms, least(end_ms + 900, duration_ms) AS e FROM segments s JOIN durations USING (track_id))")
def _(v):
    return W.clip_overlaps(v.segments.withColumn("end_ms", F.col("end_ms") + 900), v.durations)


@query("w07_overlap_profile", "track_id b, from_ms b, to_ms b, concurrency b", "segments", "SELECT * FROM (SELECT track_id, t AS from_ms, lead(t) OVER (PARTITION BY track_id ORDER BY t) AS to_ms, sum(d) OVER (PARTITION BY track_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS concurrency FROM (SELECT track_id, t, sum(d) AS d FROM (SELECT track_id, start_ms AS t, 1 AS d FROM segments UNION ALL SELECT track_id, end_ms + 700, -1 FROM segments) GROUP BY ALL)) WHERE to_ms IS NOT NULL")
def _(v):
    return W.timeline_overlap_profile(v.segments.withColumn("end_ms", F.col("end_ms") + 700))


@query("w08_zero_gap_timeline", f"{_ID}, out_start_ms b, out_end_ms b", "clips", "SELECT track_id, seg_idx, s AS out_start_ms, s + tts_ms AS out_end_ms FROM (SELECT *, coalesce(sum(tts_ms + 200) OVER (PARTITION BY track_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM clips)")
def _(v):
    return W.zero_gap_timeline(v.clips, 200)


@query("w09_stretch_plan", f"{_ID}, regime s, factor d, freeze_ms b", "clips", "SELECT track_id, seg_idx, CASE WHEN tts_ms <= 0 OR slot_ms <= 0 THEN 'invalid' WHEN abs(r - 1) < 0.01 THEN 'copy' WHEN r < 1 THEN 'trim' WHEN r <= 1.2 THEN 'stretch' ELSE 'stretch_freeze' END AS regime, CASE WHEN tts_ms <= 0 OR slot_ms <= 0 OR abs(r - 1) < 0.01 OR r < 1 THEN 1 ELSE round(least(r, 1.2), 4) END AS factor, CASE WHEN r > 1.2 THEN round(tts_ms - slot_ms * 1.2::DOUBLE) ELSE 0 END AS freeze_ms FROM (SELECT *, tts_ms / nullif(slot_ms, 0) AS r FROM clips)")
def _(v):
    return W.stretch_plan(v.clips.withColumnsRenamed({"tts_ms": "audio_ms", "slot_ms": "video_ms"}), 1.2)


@query("w10_recompute_slots", f"{_ID}, new_start_ms d, new_end_ms d, audio_speedup d, video_speed d, drift_ms d, status s", "cues", SLOTS_SQL)
def _(v):
    return W.recompute_slots(v.cues)


@query("w11_classify_drift", f"{_ID}, status s", "clips", "SELECT track_id, seg_idx, CASE WHEN abs(tts_ms - slot_ms) < 50 THEN 'ok' WHEN abs(tts_ms - slot_ms) < 200 THEN 'warn' ELSE 'fail' END AS status FROM clips")
def _(v):
    return v.clips.withColumn("status", W.classify_drift(F.col("tts_ms") - F.col("slot_ms"), 200, 50))


@query("w12_auto_fix", f"{_ID}, flags s, drift_ms d, status s", "clips", "SELECT track_id, seg_idx, CASE WHEN s = 'warn' AND d >= 0 THEN 'auto_padded:' || d || 'ms' WHEN s = 'warn' THEN printf('auto_stretch:%.4f', round(slot_ms / tts_ms, 4)) WHEN s = 'fail' THEN 'needs_resegmentation' ELSE '' END AS flags, CASE WHEN s = 'warn' AND d >= 0 THEN 0 ELSE d END AS drift_ms, CASE WHEN s = 'warn' THEN 'ok' ELSE s END AS status FROM (SELECT *, slot_ms - tts_ms AS d, CASE WHEN abs(slot_ms - tts_ms) < 50 THEN 'ok' WHEN abs(slot_ms - tts_ms) < 2000 THEN 'warn' ELSE 'fail' END AS s FROM clips)")
def _(v):
    d = F.col("slot_ms") - F.col("tts_ms")
    rows = v.clips.withColumns({"drift_ms": d.cast("double"), "status": W.classify_drift(d, 50, 2000), "new_start_ms": F.col("start_ms"), "new_end_ms": F.col("end_ms"), "qc_flags": F.array().cast("array<string>")})
    return W.auto_fix(rows).withColumn("flags", F.array_join("qc_flags", ","))


@query("w13_assign_voices", "track_id b, speaker s, voice s", "segments", "SELECT track_id, speaker, list_extract(CASE c WHEN 'a' THEN ['a1', 'a2'] ELSE ['b1'] END, ((row_number() OVER (PARTITION BY track_id, c ORDER BY speaker) - 1) % CASE c WHEN 'a' THEN 2 ELSE 1 END + 1)::INT) AS voice FROM (SELECT DISTINCT track_id, speaker, CASE WHEN track_id % 2 = 0 THEN 'a' ELSE 'b' END AS c FROM segments)")
def _(v):
    people = v.segments.select("track_id", "speaker", F.when(F.col("track_id") % 2 == 0, "a").otherwise("b").alias("voice_class")).distinct()
    return W.assign_voices(people, {"a": ["a1", "a2"], "b": ["b1"]})


@query("w14_micro_batches", f"{_ID}, batch b, engine s", "segments", f"SELECT *, CASE batch % 2 WHEN 0 THEN 'x' ELSE 'y' END AS engine FROM (SELECT *, (row_number() {_S} - 1) // 3 AS batch FROM segments)")
def _(v):
    return W.micro_batches(v.segments, 3, ("x", "y"))


@query("w15_split_tracks", "track_id b, part b, start_ms b, end_ms b", "durations", "SELECT track_id, p AS part, p * 60000 AS start_ms, least((p + 1) * 60000, duration_ms) AS end_ms FROM (SELECT *, unnest(range(greatest(ceil(duration_ms / 60000)::BIGINT, 1))) AS p FROM durations)")
def _(v):
    return W.split_tracks(v.durations, 1)


@query("w16_offset_chunks", f"{_ID}, start_ms b, end_ms b", "segments", "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx % 2, start_ms, seg_idx) - 1 AS seg_idx, start_ms + 600000 * (seg_idx % 2) AS start_ms, end_ms + 600000 * (seg_idx % 2) AS end_ms FROM segments")
def _(v):
    return W.offset_chunks(v.segments.withColumn("chunk", F.col("seg_idx") % 2))


_SPEECH = """SELECT track_id, a AS start_ms, t_ms AS end_ms FROM (SELECT *, coalesce(lag(t_ms) OVER (PARTITION BY track_id ORDER BY ord), 0) AS a FROM silence_events) WHERE kind = 'start' AND t_ms > a
    UNION ALL SELECT d.track_id, coalesce(m, 0), duration_ms FROM durations d LEFT JOIN (SELECT track_id, max(t_ms) AS m FROM silence_events GROUP BY track_id) s ON d.track_id = s.track_id WHERE duration_ms > coalesce(m, 0)"""


@query("w17_speech_intervals", "track_id b, start_ms b, end_ms b", "silence_events durations", _SPEECH)
def _(v):
    return W.speech_intervals(v.silence_events, v.durations)


@query("w18_pick_window", "track_id b, start_ms b, length_ms b", "silence_events durations", f"""
    SELECT track_id, coalesce(x[2], 20000) AS start_ms, coalesce(x[3], 10000) AS length_ms FROM (
        SELECT track_id, min(CASE WHEN end_ms - greatest(start_ms, 20000) >= 4000 THEN [0, greatest(start_ms, 20000), least(end_ms - greatest(start_ms, 20000), 10000)] WHEN end_ms - start_ms >= 4000 THEN [1, start_ms, least(end_ms - start_ms, 10000)] END) AS x FROM ({_SPEECH}) GROUP BY track_id)""")
def _(v):
    return W.pick_window(W.speech_intervals(v.silence_events, v.durations))


@query("w19_representative_segments", f"{_ID}", "segments", "SELECT * FROM (SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY track_id, speaker ORDER BY start_ms, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM segments WHERE end_ms - start_ms >= 500) WHERE b < 15000")
def _(v):
    return W.representative_segments(v.segments)


@query("w20_redistribute_slots", "track_id b, sent_idx b, start_ms b, end_ms b", "segments", """
    SELECT track_id, seg_idx AS sent_idx, (a + floor((e - a) * p / t))::BIGINT AS start_ms, (a + floor((e - a) * (p + w) / t))::BIGINT AS end_ms FROM (
        SELECT *, min(start_ms) OVER g AS a, max(end_ms) OVER g AS e, sum(w) OVER g AS t, coalesce(sum(w) OVER (PARTITION BY track_id, seg_idx // 2 ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
        FROM (SELECT *, greatest(n, 1) AS w FROM segments) WINDOW g AS (PARTITION BY track_id, seg_idx // 2))""")
def _(v):
    return W.redistribute_slots(v.segments.withColumnRenamed("seg_idx", "sent_idx"))


@query("w21_even_word_spread", "track_id b, word_idx b, text s, start_ms b, end_ms b", "words segments", "SELECT w.track_id, w.word_idx, w.text, s.start_ms + greatest(s.end_ms - s.start_ms, 100) * w.pos // s.n AS start_ms, s.start_ms + greatest(s.end_ms - s.start_ms, 100) * (w.pos + 1) // s.n AS end_ms FROM words w JOIN segments s USING (track_id, seg_idx)")
def _(v):
    return W.even_word_spread(v.segments)


@query("w22_fixed_word_chunks", "track_id b, chunk b, start_ms b, end_ms b, text s", "words", "SELECT track_id, word_idx // 4 AS chunk, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY word_idx) AS text FROM words GROUP BY ALL")
def _(v):
    return W.fixed_word_chunks(v.words, 4)


@query("w23_split_long_rows", f"{_ID}, piece b, text s, start_ms b, end_ms b", "segments", """
    SELECT track_id, seg_idx, k AS piece, array_to_string(toks[k * z + 1:k * z + z], ' ') AS text, start_ms + (end_ms - start_ms) * (k * z) // n AS start_ms, start_ms + (end_ms - start_ms) * least(k * z + z, n) // n AS end_ms FROM (
        SELECT *, unnest(range(ceil(n / z)::BIGINT)) AS k FROM (SELECT *, ceil(n / ceil(n / 8))::BIGINT AS z FROM segments WHERE n > 0))""")
def _(v):
    return W.split_long_rows(v.segments)


# Segmentation --------------------------------------------------------------------------------------------------------

_SENT = "track_id b, sent_idx b, text s, start_ms b, end_ms b, n_words b"


# Folds in SQL: a text takes one letter for each row, the same for rows of one group, so that its trailing letters tell
# how far the last group has come; the next row continues that letter or takes the one after it.
_LAST = "right(t, 1)"
_HELD = "(length(t) - length(rtrim(t, right(t, 1))))"


def _letters(closed: str) -> str:
    """Letters of rows 1 .. n in order, a new one behind a row for which `closed` holds (k: the next row's place)."""
    return f"list_reduce(list_prepend('', list_transform(range(1, n + 1), lambda k: k::VARCHAR)), lambda t, k: t || CASE WHEN t = '' THEN 'A' WHEN {closed} THEN chr(ascii({_LAST}) + 1) ELSE {_LAST} END)"


@query("d01_merge_into_sentences", _SENT, "words", f"""
    WITH a AS (SELECT *, coalesce(lag(regexp_matches(text, '[.!?]$')) {_W} OR lag(speaker) {_W} <> speaker, false)::INT AS cut FROM words),
    b AS (SELECT *, sum(cut) {_W} AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY word_idx) AS k FROM b),
    d AS (SELECT track_id, run, count(*) AS n, list(regexp_matches(text, '[,;:]$') ORDER BY k) AS comma FROM c GROUP BY ALL),
    e AS (SELECT track_id, run, {_letters(f"({_HELD} >= 15 AND comma[k::INT - 1]) OR {_HELD} >= 25")} AS letters FROM d),
    f AS (SELECT c.*, substr(letters, c.k, 1) AS piece FROM c JOIN e USING (track_id, run)),
    g AS (SELECT track_id, min(word_idx) AS f, string_agg(text, ' ' ORDER BY word_idx) AS text, arg_min(start_ms, word_idx) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words FROM f GROUP BY track_id, run, piece)
    SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY f) - 1 AS sent_idx FROM g""")
def _(v):
    return D.merge_into_sentences(v.words)


_TERMINATED = f"""
    WITH a AS (SELECT *, regexp_matches(text, '[.!?]$') AND lower(text) NOT IN {tuple(T.ABBREVIATIONS)} AS e FROM words),
    b AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY track_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, CASE WHEN bool_or(e AND word_idx < 100) OVER (PARTITION BY track_id) THEN 40 ELSE 12 END AS cap FROM a),
    c AS (SELECT *, (row_number() OVER (PARTITION BY track_id, run ORDER BY word_idx) - 1) // cap AS piece FROM b),
    d AS (SELECT track_id, min(word_idx) AS f, string_agg(text, ' ' ORDER BY word_idx) AS text, arg_min(start_ms, word_idx) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words, arg_min(speaker, word_idx) AS speaker FROM c GROUP BY track_id, run, piece)
    SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY f) - 1 AS sent_idx FROM d"""


@query("d02_split_terminator_sentences", _SENT, "words", _TERMINATED)
def _(v):
    return D.split_terminator_sentences(v.words)


@query("d03_dedup_rolling_words", "track_id b, word_idx b, text s, start_ms b", "words", """
    WITH a AS (SELECT track_id, word_idx * 2 AS i, text, start_ms, seg_idx % 3 = 2 AS plain FROM words UNION ALL SELECT track_id, word_idx * 2 + 1, text, start_ms + 2, seg_idx % 3 = 2 FROM words WHERE word_idx % 5 = 0),
    b AS (SELECT *, max(start_ms) FILTER (WHERE NOT plain) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, row_number() OVER (PARTITION BY track_id, text, round(start_ms / 10) ORDER BY i) AS k FROM a)
    SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY i) - 1 AS word_idx, text, start_ms FROM b WHERE k = 1 AND (NOT plain OR l IS NULL OR start_ms > l + 1)""")
def _(v):
    again = v.words.filter("word_idx % 5 = 0").withColumns({"start_ms": F.col("start_ms") + 2, "word_idx": F.col("word_idx") * 2 + 1})
    return D.dedup_rolling_words(v.words.withColumn("word_idx", F.col("word_idx") * 2).unionByName(again).withColumn("plain", F.col("seg_idx") % 3 == 2))


@query("d04_dedup_rolling_segments", f"{_ID}, text s", "segments", """
    WITH a AS (SELECT track_id, seg_idx * 2 AS i, array_to_string(toks[1:n // 2], ' ') AS text FROM segments UNION ALL SELECT track_id, seg_idx * 2 + 1, text FROM segments),
    b AS (SELECT track_id, count(*) AS n, list(text ORDER BY i) AS x FROM a GROUP BY track_id),
    c AS (SELECT track_id, x, string_split(list_reduce(list_transform(range(1, n + 1), lambda k: k::VARCHAR), lambda t, k:
        CASE WHEN contains(x[k::INT], x[regexp_extract(t, '[0-9]+$')::INT]) THEN regexp_replace(t, '[0-9]+$', '') || k
             WHEN contains(x[regexp_extract(t, '[0-9]+$')::INT], x[k::INT]) THEN t ELSE t || ',' || k END), ',') AS kept FROM b)
    SELECT track_id, unnest(range(len(kept))) AS seg_idx, unnest(list_transform(kept, lambda k: x[k::INT])) AS text FROM c""")
def _(v):
    half = F.array_join(F.slice("toks", 1, F.floor(F.col("n") / 2).cast("int")), " ")
    rolled = v.segments.withColumns({"text": half, "seg_idx": F.col("seg_idx") * 2}).unionByName(v.segments.withColumn("seg_idx", F.col("seg_idx") * 2 + 1))
    return D.dedup_rolling_segments(rolled)


@query("d05_runs_of_equal_text", f"{_ID}, text s, start_ms b, end_ms b", "frame_texts", """
    WITH a AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY track_id ORDER BY ts_ms) <> text, true) AS nw FROM frame_texts WHERE length(trim(text)) > 3),
    b AS (SELECT *, sum(nw::INT) OVER (PARTITION BY track_id ORDER BY ts_ms) AS run FROM a),
    c AS (SELECT track_id, run, min(text) AS text, min(ts_ms) AS start_ms, max(ts_ms) AS l FROM b GROUP BY ALL)
    SELECT track_id, run - 1 AS seg_idx, text, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY track_id ORDER BY run), l + 1000) AS end_ms FROM c""")
def _(v):
    return D.runs_of_equal_text(v.frame_texts)


@query("d06_build_cues_dp", "track_id b, cue_idx b, start_ms b, end_ms b, text s, n_words b, method s")
def _(v):
    return D.build_cues_dp(J.glossary_tag_words(v.words, v.glossary))


@query("d07_build_cues_greedy", "track_id b, cue_idx b, start_ms b, end_ms b, text s, n_words b", "words", f"""
    WITH a AS (SELECT *, coalesce(lag(regexp_matches(text, '[.!?]$')) {_W}, false)::INT AS cut FROM words),
    b AS (SELECT *, sum(cut) {_W} AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY word_idx) AS k FROM b),
    d AS (SELECT track_id, run, count(*) AS n, list(start_ms ORDER BY k) AS s, list(end_ms ORDER BY k) AS e FROM c GROUP BY ALL),
    l AS (SELECT track_id, run, {_letters(f"{_HELD} >= 14 OR e[k::INT - 1] - s[k::INT - {_HELD}] >= 4500")} AS letters FROM d),
    f AS (SELECT c.*, substr(letters, c.k, 1) AS piece FROM c JOIN l USING (track_id, run)),
    g AS (SELECT track_id, min(word_idx) AS f, string_agg(text, ' ' ORDER BY word_idx) AS text, arg_min(start_ms, word_idx) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words FROM f GROUP BY track_id, run, piece)
    SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY f) - 1 AS cue_idx FROM g""")
def _(v):
    return D.build_cues_greedy(v.words)


_SAME = "(sp[k::INT] = sp[k::INT - 1] OR sp[k::INT] = '' OR sp[k::INT - 1] = '')"
_FITS = f"NOT big[k::INT] AND NOT big[k::INT - 1] AND {_HELD} < 2 AND list_sum(m[k::INT - {_HELD}:k::INT]) <= 13 AND e[k::INT] - s[k::INT - {_HELD}] <= 5500 AND {_SAME}"
_PACKED = f"""
    WITH x AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM ({_TERMINATED})),
    y AS (SELECT *, len(w) AS z, unnest(range(ceil(len(w) / 13)::BIGINT)) AS p FROM x),
    p AS (SELECT track_id, sent_idx, p, array_to_string(w[p * 13 + 1:p * 13 + 13], ' ') AS text, start_ms + (end_ms - start_ms) * (p * 13) // z AS a, start_ms + (end_ms - start_ms) * least(p * 13 + 13, z) // z AS b,
        least(p * 13 + 13, z) - p * 13 AS m, coalesce(speaker, '') AS speaker, z > 13 AS big, row_number() OVER (PARTITION BY track_id ORDER BY sent_idx, p) AS k FROM y),
    q AS (SELECT track_id, count(*) AS n, list(m ORDER BY k) AS m, list(a ORDER BY k) AS s, list(b ORDER BY k) AS e, list(speaker ORDER BY k) AS sp, list(big ORDER BY k) AS big FROM p GROUP BY track_id),
    l AS (SELECT track_id, {_letters(f"NOT ({_FITS})")} AS letters FROM q)
    SELECT track_id, ascii(substr(letters, k, 1)) - 65 AS cue_idx, min(a) AS start_ms, max(b) AS end_ms, string_agg(text, ' ' ORDER BY k) AS text, sum(m) AS n_words, count(*) AS n_sentences FROM p JOIN l USING (track_id) GROUP BY ALL"""


@query("d08_pack_sentences", "track_id b, cue_idx b, start_ms b, end_ms b, text s, n_words b, n_sentences b", "words", _PACKED)
def _(v):
    return D.pack_sentences(D.split_terminator_sentences(v.words))


@query("d09_plain_fallback_chunks", "track_id b, chunk b, text s", "", """
    SELECT doc_id AS track_id, k AS chunk, array_to_string(t[k * z + 1:k * z + z], ' ') AS text FROM (SELECT doc_id, t, z, unnest(range(ceil(len(t) / z)::BIGINT)) AS k FROM (
        SELECT doc_id, t, CASE WHEN len(t) > 40 AND len(list_filter(t, lambda w: regexp_matches(w, '[.!?]$') AND lower(w) NOT IN {})) = 0 THEN 20 ELSE len(t) END AS z
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents) WHERE len(t) > 0))""".format(tuple(T.ABBREVIATIONS)))
def _(v):
    return D.plain_fallback_chunks(v.table("documents").select(F.col("doc_id").alias("track_id"), "text"))


@query("a02_segmentation_summary", "track_id b, total_words b, total_sentences b, total_cues b, estimated_words b, budget b, max_words b, min_words b, avg_words_per_cue d, avg_sentences_per_cue d", "words", f"""
    SELECT *, floor(total_words * 1.2::DOUBLE) AS estimated_words, 13 AS budget, round(total_sentences / total_cues, 4) AS avg_sentences_per_cue FROM (SELECT track_id, count(*) AS total_words FROM words GROUP BY track_id)
    LEFT JOIN (SELECT track_id, count(*) AS total_sentences FROM ({_TERMINATED}) GROUP BY track_id) USING (track_id)
    LEFT JOIN (SELECT track_id, count(*) AS total_cues, max(n_words) AS max_words, min(n_words) AS min_words, round(avg(n_words), 4) AS avg_words_per_cue FROM ({_PACKED}) GROUP BY track_id) USING (track_id)""")
def _(v):
    s = D.split_terminator_sentences(v.words)
    return A.segmentation_summary(v.words, s, D.pack_sentences(s))


# Events --------------------------------------------------------------------------------------------------------------

_OVERALL = "round(CASE step WHEN 'download' THEN 0.15 * progress WHEN 'extract' THEN 0.15 + 0.05 * progress WHEN 'transcribe' THEN 0.2 + 0.25 * progress WHEN 'translate' THEN 0.45 + 0.15 * progress WHEN 'synthesize' THEN 0.6 + 0.3 * progress ELSE 1 END, 4)"


@query("r01_overall_progress", "job_id b, seq b, overall d", "job_events", f"SELECT *, {_OVERALL} AS overall FROM job_events")
def _(v):
    return R.overall_progress(v.job_events)


@query("r02_step_times", "job_id b, step s, seconds d", "job_events", """
    WITH a AS (SELECT *, coalesce(lag(step) OVER w <> step, true) AS nw FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
    b AS (SELECT *, sum(nw::INT) OVER (PARTITION BY job_id ORDER BY seq) AS run FROM a),
    c AS (SELECT job_id, run, step, min(ts) AS a, max(ts) AS b FROM b GROUP BY ALL),
    d AS (SELECT *, epoch_us(coalesce(lead(a) OVER (PARTITION BY job_id ORDER BY run), b)) - epoch_us(a) AS us FROM c)
    SELECT job_id, step, round(sum(us) / 1e6, 1) AS seconds FROM d GROUP BY ALL""")
def _(v):
    return R.step_times(v.job_events)


@query("r03_job_state_latest", "job_id b, state s, step s, terminal o", "job_events", "SELECT job_id, state, step, state IN ('done', 'error', 'waiting_for_srt') AS terminal FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1")
def _(v):
    return R.job_state_latest(v.job_events)


@query("r04_eta", "job_id b, seq b, eta_s d", "job_events", f"""
    WITH a AS (SELECT *, {_OVERALL} AS p FROM job_events),
    b AS (SELECT *, (epoch_us(ts) - epoch_us(first(ts) OVER (PARTITION BY job_id ORDER BY seq))) / 1e6 AS e, coalesce(max(p) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM a)
    SELECT job_id, seq, CASE WHEN p > 0.01 AND p < 1 AND e > 2 AND p > m THEN round((1 - p) * e / p, 1) END AS eta_s FROM b""")
def _(v):
    return R.eta(v.job_events)


@query("r04_eta_stream", "job_id b, seq b, eta_s d", "job_events", f"""
    WITH a AS (SELECT *, {_OVERALL} AS p FROM job_events),
    b AS (SELECT *, (epoch_us(ts) - epoch_us(first(ts) OVER w)) / 1e6 AS e, coalesce(max(p) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM a WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq))
    SELECT job_id, seq, CASE WHEN p > 0.01 AND p < 1 AND e > 2 AND p > m THEN round((1 - p) * e / p, 1) END AS eta_s FROM b
    WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM job_events)""")
def _(v):
    return run_available(R.eta(v.job_event_stream, "0 seconds"), "eta-stream")


@query("r05_success_rate_window", "engine s, window_start t, success b, failure b, rate d", "provider_results", "SELECT engine, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failure, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (WHERE ok) / count(*), 4) END AS rate FROM provider_results GROUP BY ALL")
def _(v):
    return R.success_rate_window(v.provider_results, "1 hour")


@query("r06_provider_health", "engine s, ts t, health s", "provider_results", f"""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts, ok) AS k FROM provider_results),
    b AS (SELECT engine, count(*) AS n, list(epoch_us(ts) ORDER BY k) AS u FROM a GROUP BY engine),
    l AS (SELECT engine, {_letters(f"{_HELD} >= 5 AND u[k::INT - 1] - u[k::INT - {_HELD}] >= 10000000")} AS letters FROM b),
    c AS (SELECT a.*, substr(letters, k, 1) AS round FROM a JOIN l USING (engine)),
    d AS (SELECT *, count(*) OVER r AS n, avg(ok::INT) OVER r AS rate, k = max(k) OVER r AND epoch_us(ts) - min(epoch_us(ts)) OVER r >= 10000000 AND count(*) OVER r >= 5 AS ends FROM c WINDOW r AS (PARTITION BY engine, round))
    SELECT engine, ts, coalesce(last_value(CASE WHEN NOT ok THEN 'degraded' WHEN ends AND rate > 0.95 THEN 'healthy' WHEN ends AND rate < 0.8 THEN 'struggling' END IGNORE NULLS) OVER (PARTITION BY engine ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'healthy') AS health FROM d""")
def _(v):
    return R.provider_health(v.provider_results)


@query("r07_stuck_jobs", "job_id b, state s, message s, idle_s d", "job_events", "SELECT job_id, 'error' AS state, 'restarted' AS message, round(i, 1) AS idle_s FROM (SELECT *, (epoch_us((SELECT max(ts) FROM job_events)) - epoch_us(ts)) / 1e6 AS i FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1) WHERE state = 'running' AND i > 3600")
def _(v):
    return R.stuck_jobs(v.job_events, 3600)


@query("r07_stuck_jobs_stream", "job_id b, state s, message s, idle_s d", "job_events", """
    WITH a AS (SELECT *, max(epoch_ms(ts)) OVER () AS now FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)
    SELECT job_id, 'error' AS state, 'restarted' AS message, round((now * 1000 - epoch_us(ts)) / 1e6, 1) AS idle_s FROM a
    WHERE state = 'running' AND now >= epoch_ms(ts) + 1 + 3600000""")
def _(v):
    return run_available(stuck_jobs_stream(v.job_event_stream, 3600, delay="0 seconds"), "stuck-jobs-stream")


@query("r09_event_windows_tumbling", "step s, state s, window_start t, n b", "job_events", "SELECT step, state, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM job_events GROUP BY ALL")
def _(v):
    return R.event_windows(v.job_events, "1 hour")


@query("r09_event_windows_sliding", "step s, state s, window_start t, n b", "job_events", "SELECT step, state, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start, count(*) AS n FROM job_events, (SELECT unnest(range(4)) AS k) GROUP BY ALL")
def _(v):
    return R.event_windows(v.job_events, "1 hour", "15 minutes")


@query("r09_event_windows_session", "job_id b, window_start t, window_end t, n b", "job_events", """
    WITH a AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job_id ORDER BY ts)) >= 1800000000, true) AS nw FROM job_events),
    b AS (SELECT *, sum(nw::INT) OVER (PARTITION BY job_id ORDER BY ts) AS run FROM a)
    SELECT job_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM b GROUP BY job_id, run""")
def _(v):
    return R.event_windows(v.job_events, "", gap="30 minutes")


@query("r10_dedup_events", "job_id b, seq b, step s", "job_events", "SELECT job_id, seq, step FROM job_events")
def _(v):
    return R.dedup_events(v.job_events.unionByName(v.job_events.filter("seq % 3 = 0")))


@query("flow_run_full", "track_id b, seg_idx b, start_ms b, end_ms b, text s, n_flags b, new_start_ms d, new_end_ms d, status s")
def _(v):
    return flow.run_full(v)
