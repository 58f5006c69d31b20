"""Queries of row-wise operators, quality rules, roll-ups and table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import quality as Q
from ..operators import tables as U
from ..operators import timeline as W
from ..operators import udfs as X
from ..sources import subtitles as S
from ..sources.scratch import scratch_dir
from .registry import query
from .view_sql import SLOTS_SQL

_ID = "track_id b, seg_idx b"
_ANY = "track_id, seg_idx"


def _noisy(v):
    """Segments with the texts that the cleaning rules are about."""
    k = F.col("seg_idx") % 6
    text = F.when(k == 0, F.concat(F.lit("[Music] "), "text")).when(k == 1, F.concat(F.lit("<i>"), "text", F.lit("</i>  x"))).when(k == 2, F.lit("(laughs)")).when(k == 3, F.lit("  ")).when(k == 4, F.lit("♪ la ♪")).otherwise(F.col("text"))
    return v.segments.withColumn("text", text)


_NOISY = "(SELECT * REPLACE (CASE seg_idx % 6 WHEN 0 THEN '[Music] ' || text WHEN 1 THEN '<i>' || text || '</i>  x' WHEN 2 THEN '(laughs)' WHEN 3 THEN '  ' WHEN 4 THEN '♪ la ♪' ELSE text END AS text) FROM segments)"


@query("p01_normalize_words", f"{_ID}, text s", "segments", f"SELECT track_id, seg_idx, CASE WHEN regexp_matches(trim(text), '^(\\[.*\\]|\\(.*\\)|♪.*♪)$') THEN '' ELSE trim(text) END AS text FROM {_NOISY} WHERE NOT regexp_matches(trim(text), '^(\\[.*\\]|\\(.*\\)|♪.*♪)$') AND trim(text) <> ''")
def _(v):
    return U.normalize_words(_noisy(v))


@query("p02_strip_inline_noise", f"{_ID}, text s", "segments", f"SELECT track_id, seg_idx, trim(regexp_replace(text, '\\s*\\[(music|applause|laughter|silence|noise|sound|cheering|singing)\\]\\s*', ' ', 'gi')) AS text FROM {_NOISY}")
def _(v):
    return _noisy(v).withColumn("text", T.strip_inline_noise(F.col("text")))


@query("p03_strip_markup", f"{_ID}, text s", "segments", f"SELECT track_id, seg_idx, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM {_NOISY}")
def _(v):
    return _noisy(v).withColumn("text", T.strip_markup(F.col("text")))


@query("p04_drop_blank_segments", f"{_ID}, text s", "segments", f"SELECT track_id, seg_idx, text FROM {_NOISY} WHERE trim(text) <> ''")
def _(v):
    return U.drop_blank_segments(_noisy(v))


@query("p05_limit_duration", f"{_ID}, start_ms b", "segments", "SELECT * FROM segments WHERE start_ms < 120000")
def _(v):
    return U.limit_duration(v.segments, 2)


@query("p06_is_garbage_translation", f"{_ID}, engine s, garbage o", "translations", "SELECT *, trim(text_translated) = '' OR regexp_matches(lower(text_translated), 'error 500|server error|that''s an error|<html|<!doctype') AS garbage FROM translations")
def _(v):
    return v.translations.withColumn("garbage", T.is_garbage_translation(F.col("text_translated")))


@query("p07_is_bad_translation", f"{_ID}, engine s, bad o", "segments translations", "SELECT t.*, trim(t.text_translated) = '' OR trim(t.text_translated) = trim(s.text) OR (length(trim(s.text)) > 10 AND length(trim(t.text_translated)) * 10 < length(trim(s.text)) * 3) AS bad FROM translations t JOIN segments s USING (track_id, seg_idx)")
def _(v):
    both = v.translations.join(v.segments.select("track_id", "seg_idx", "text"), ["track_id", "seg_idx"])
    return both.withColumn("bad", T.is_bad_translation(F.col("text"), F.col("text_translated")))


@query("p08_is_bad_clip", f"{_ID}, bad o", "clips", "SELECT *, tts_ms * 3 < 1000 OR tts_ms < 200 AS bad FROM clips")
def _(v):
    return v.clips.withColumn("bad", T.is_bad_clip(F.col("tts_ms") * 3, F.col("tts_ms")))


@query("p09_long_text_flag", f"{_ID}, too_long o, too_long_in_track b", "segments", "SELECT *, length(text) > 300 AS too_long, count(*) FILTER (WHERE length(text) > 300) OVER (PARTITION BY track_id) AS too_long_in_track FROM segments")
def _(v):
    return U.long_text_flag(v.segments, 300)


@query("p10_valid_language_code", "doc_id b, valid o", "", "SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN lang || '-' || upper(lang) WHEN doc_id % 7 = 0 THEN lang || '_x' ELSE lang END, '^[a-zA-Z]{2,5}(-[a-zA-Z]{2,5})?$') AS valid FROM documents")
def _(v):
    code = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-"), F.upper("lang"))).when(F.col("doc_id") % 7 == 0, F.concat("lang", F.lit("_x"))).otherwise(F.col("lang"))
    return v.table("documents").select("doc_id", T.valid_language_code(code).alias("valid"))


@query("p11_video_id_from_url", "page_id b, video_id s", "", "SELECT page_id, nullif(regexp_extract(u, '(?:[?&]v=|youtu\\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})', 1), '') AS video_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://x.example/watch?v=' || substr(md5(url), 1, 11) WHEN 1 THEN 'https://youtu.be/' || substr(md5(url), 1, 11) WHEN 2 THEN 'https://x.example/shorts/' || substr(md5(url), 1, 9) ELSE url END AS u FROM pages)")
def _(v):
    h = F.md5("url")
    u = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://x.example/watch?v="), F.substring(h, 1, 11))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://youtu.be/"), F.substring(h, 1, 11))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://x.example/shorts/"), F.substring(h, 1, 9))).otherwise(F.col("url"))
    return v.table("pages").select("page_id", T.video_id_from_url(u).alias("video_id"))


@query("p12_cue_metrics", f"{_ID}, duration_ms b, word_count b, wps d", "cues", "SELECT *, end_ms - start_ms AS duration_ms, n AS word_count, CASE WHEN end_ms > start_ms THEN round(n * 1000.0 / (end_ms - start_ms), 4) ELSE 0 END AS wps FROM cues")
def _(v):
    return Q.with_cue_metrics(v.cues)


@query("p13_latin_leak_filter", f"{_ID}", "segments", f"SELECT * FROM {_NOISY} WHERE regexp_matches(text, '[A-Za-z]')")
def _(v):
    return U.latin_leak_filter(_noisy(v))


@query("p14_long_segments", f"{_ID}, n_words b", "segments", "SELECT *, n AS n_words FROM segments WHERE n > 15")
def _(v):
    return U.long_segments(v.segments)


@query("p15_manual_review_queue", "job_id b, segment_idx b, tts_ms b, in_job b", "job_segments", "SELECT *, count(*) OVER (PARTITION BY job_id) AS in_job FROM job_segments WHERE qc_status = 'manual_review'")
def _(v):
    return U.manual_review_queue(v.job_segments)


# Functions -----------------------------------------------------------------------------------------------------------


@query("t01_parse_timecode", f"{_ID}, ms b, back s, bad b", "segments", "SELECT track_id, seg_idx, start_ms AS ms, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000) AS back, 0 AS bad FROM segments")
def _(v):
    s = T.format_timecode(F.col("start_ms"))
    return v.segments.select("track_id", "seg_idx", T.parse_timecode(s).alias("ms"), s.alias("back"), T.parse_timecode(F.substring(s, 4, 9)).alias("bad"))


@query("t02_format_timecode", f"{_ID}, vtt s, clock s", "segments", "SELECT track_id, seg_idx, printf('%02d:%02d:%02d.%03d', end_ms // 3600000, (end_ms // 60000) % 60, (end_ms // 1000) % 60, end_ms % 1000) AS vtt, lpad((end_ms % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((end_ms % 1000)::VARCHAR, 3, '0') AS clock FROM segments")
def _(v):
    return v.segments.select("track_id", "seg_idx", T.format_timecode(F.col("end_ms"), "vtt").alias("vtt"), T.format_timecode(F.col("end_ms") % 60_000, "clock").alias("clock"))


@query("t03_count_words", "doc_id b, n b", "", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.count_words(F.col("text")).alias("n"))


@query("t04_count_words_nopunct", "doc_id b, n b", "", "SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '')) AS n FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.count_words_nopunct(F.col("text")).alias("n"))


@query("t05_target_word_count", "doc_id b, target_words b", "", "SELECT doc_id, greatest(round_even(n_chars * 40 * CASE lang WHEN 'en' THEN 150 WHEN 'fr' THEN 155 WHEN 'de' THEN 130 WHEN 'es' THEN 160 ELSE 135 END / 60000.0::DOUBLE, 0), 1) AS target_words FROM documents")
def _(v):
    dim = v.spark.createDataFrame([(k, w) for k, w in T.LANGUAGE_WPM.items()], "lang string, wpm int")
    return U.target_word_count(v.table("documents").withColumn("ms", F.col("n_chars") * 40), dim, "ms", "lang")


@query("t06_translation_hints", f"{_ID}, duration_ms b, target_words b", "segments", "SELECT track_id, seg_idx, end_ms - start_ms AS duration_ms, greatest(3, (end_ms - start_ms) * 120 // 60000) AS target_words FROM segments WHERE trim(text) <> ''")
def _(v):
    return U.translation_hints(v.segments).filter("hints is not null").select("track_id", "seg_idx", "hints.duration_ms", "hints.target_words")


@query("t07_translation_prompt_rows", f"{_ID}, system s, user s", "segments", "SELECT track_id, seg_idx, 'Translate subtitles into natural spoken Hindi.' AS system, '[' || (end_ms - start_ms) || 'ms | ~' || greatest(3, (end_ms - start_ms) * 120 // 60000) || 'w] ' || text AS \"user\" FROM segments WHERE trim(text) <> ''".replace('AS "user"', "AS user"))
def _(v):
    return U.translation_prompt_rows(v.segments)


@query("t08_numbered_batches", "track_id b, batch b, prompt s, back s", "segments", "SELECT track_id, k // 3 AS batch, string_agg((k % 3 + 1) || '. ' || text, chr(10) ORDER BY k) AS prompt, string_agg(trim(regexp_replace(text, chr(10), ' ', 'g')), '|' ORDER BY k) AS back FROM (SELECT track_id, regexp_replace(text, '\\s+', ' ', 'g') AS text, row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) - 1 AS k FROM segments) GROUP BY ALL")
def _(v):
    rows = U.numbered_batch_prompt(v.segments.withColumn("text", F.regexp_replace("text", r"\s+", " ")), 3)
    n = F.size(F.split("prompt", "\n"))
    return rows.withColumn("back", F.array_join(T.parse_numbered_lines(F.col("prompt"), n), "|"))


@query("t09_detect_emotion", f"{_ID}, emotion s", "segments", "SELECT track_id, seg_idx, CASE WHEN asks >= 2 OR (asks >= 1 AND len(list_filter({comedic}, lambda w: contains(low, w))) > 0) THEN 'comedic' WHEN len(list_filter({emotional}, lambda w: contains(low, w))) > 0 OR (end_ms - start_ms > 3000 AND (contains(low, '...') OR contains(low, '…'))) THEN 'emotional' WHEN contains(low, '!') OR len(list_filter({punchy}, lambda w: contains(low, w))) > 0 OR end_ms - start_ms < 2000 THEN 'punchy' ELSE 'neutral' END AS emotion FROM (SELECT *, lower(text || ' ') AS low, length(regexp_replace(text, '[^?]', '', 'g')) AS asks FROM segments)".format(comedic=T.COMEDIC_WORDS, emotional=T.EMOTIONAL_WORDS, punchy=T.PUNCHY_WORDS))
def _(v):
    return v.segments.withColumn("emotion", T.detect_emotion(F.col("text"), F.lit(""), F.col("end_ms") - F.col("start_ms")))


_SPOKEN = {"किन्तु": "लेकिन", "के द्वारा": "से"}


@query("t10_formal_to_spoken", "doc_id b, text s", "", "SELECT doc_id, replace(t, 'के द्वारा', 'से') || CASE WHEN doc_id % 2 = 0 THEN ' लेकिन वे' ELSE ' xकिन्तुओं' END AS text FROM (SELECT doc_id, text || ' के द्वारा' AS t FROM documents)")
def _(v):
    tail = F.when(F.col("doc_id") % 2 == 0, " किन्तु वे").otherwise(" xकिन्तुओं")
    return v.table("documents").select("doc_id", T.formal_to_spoken(F.concat("text", F.lit(" के द्वारा"), tail), _SPOKEN).alias("text"))


@query("t11_normalize_punct", f"{_ID}, text s", "segments", "SELECT track_id, seg_idx, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ',{2,}', ',', 'g'), '।{2,}', '।', 'g'), '!{2,}', '!', 'g'), ',\\s*([।!?])', '\\1', 'g'), '\\s{2,}', ' ', 'g'), '\\s+([।!?,])', '\\1', 'g')) AS text FROM (SELECT track_id, seg_idx, replace(text || ' ,, x !! y , ?  z ।।', '।।', '।') AS t FROM segments)")
def _(v):
    return v.segments.withColumn("text", T.normalize_punct(F.concat("text", F.lit(" ,, x !! y , ?  z ।।"))))


_SUBS, _FILL = {"that": "to", "thing": "it"}, ["the ", "of "]


def _shorter(target: str) -> str:
    """The view segments with texts t: _SUBS by characters saved and _FILL in order, then the shortest clause between commas."""
    count = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
    rules = [*(f"{k}|{v}" for k, v in sorted(_SUBS.items(), key=lambda kv: len(kv[1]) - len(kv[0]))), *(f"{f}|" for f in _FILL)]
    once = "substr(t, 1, strpos(t, split_part(r, '|', 1)) - 1) || split_part(r, '|', 2) || substr(t, strpos(t, split_part(r, '|', 1)) + length(split_part(r, '|', 1)))"
    squeeze = "trim(regexp_replace({}, '\\s{{2,}}', ' ', 'g'))"
    return f"""
    WITH a AS (SELECT *, {target} AS target FROM segments),
    b AS (SELECT *, list_reduce(list_prepend(text, {rules}), lambda t, r: CASE WHEN {count.format("t")} > target AND contains(t, split_part(r, '|', 1)) THEN {squeeze.format(once)} ELSE t END) AS t FROM a),
    c AS (SELECT *, string_split(t, ',') AS parts FROM b),
    d AS (SELECT *, -list_min([{{'n': {count.format("parts[k + 1]")}, 'b': -k}} for k in range(1, len(parts)) if {count.format("parts[k + 1]")} > 0]).b AS worst FROM c),
    e AS (SELECT *, CASE WHEN worst IS NOT NULL THEN {squeeze.format("array_to_string(list_concat(parts[1:worst], parts[worst + 2:len(parts)]), ',')")} END AS cut FROM d)
    SELECT * REPLACE (CASE WHEN {count.format("t")} > target AND cut IS NOT NULL THEN cut || CASE WHEN cut = '' OR right(cut, 1) IN ('।', '!', '?', ',') THEN '' ELSE '।' END ELSE t END AS t) FROM e"""


@query("t12_shorten_by_substitution", f"{_ID}, text s, n b", "segments", f"SELECT track_id, seg_idx, t AS text, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS n FROM ({_shorter('floor(n * 0.9::DOUBLE)::INT')})")
def _(v):
    short = T.shorten_by_substitution(F.col("text"), F.floor(F.col("n") * 0.9).cast("int"), _SUBS, _FILL)
    return v.segments.withColumn("text", short).withColumn("n", T.count_words(F.col("text")))


@query("t13_compress_if_needed", f"{_ID}, text s", "segments", f"SELECT track_id, seg_idx, CASE WHEN (end_ms - start_ms) // 2 > 300 AND n * 60000 / 120 > ((end_ms - start_ms) // 2) * 1.25 THEN t ELSE text END AS text FROM ({_shorter('greatest(floor(((end_ms - start_ms) // 2) * 1.25::DOUBLE * 120 / 60000)::INT, 3)')})")
def _(v):
    slot = F.floor((F.col("end_ms") - F.col("start_ms")) / 2)  # half of what the texts took to say
    return v.segments.withColumn("text", T.compress_if_needed(F.col("text"), slot, _SUBS, _FILL))


@query("t14_naturalness_score", f"{_ID}, score d", "segments", "SELECT track_id, seg_idx, round(greatest(0, least(1, 1.0 - CASE WHEN length(text) > 200 THEN 0.1 ELSE 0 END - 0.05 * len(list_filter(toks, lambda w: length(w) > 15)))), 4) AS score FROM segments")
def _(v):
    return v.segments.withColumn("score", T.naturalness_score(F.col("text")))


@query("t15_format_lines", f"{_ID}, text s", "segments", """
    SELECT track_id, seg_idx, CASE WHEN l <= 42 OR n < 4 OR a = '' OR b = '' OR length(a) > 42 OR length(b) > 42 THEN text ELSE a || chr(10) || b END AS text FROM (
        SELECT *, trim(substr(text, 1, cut)) AS a, trim(substr(text, cut + 1)) AS b FROM (
            SELECT *, coalesce(list_min([{'d': abs(p - 1 - l // 2), 'p': p} for p in range(1, l + 1) if contains(',।;', substr(text, p, 1)) AND (p - 1) * 4 > l AND (p - 1) * 4 < l * 3]).p, length(array_to_string(toks[1:n // 2], ' '))) AS cut
            FROM (SELECT *, length(text) AS l FROM segments)))""")
def _(v):
    return v.segments.withColumn("text", T.format_lines(F.col("text")))


@query("t16_prepare_speech_text", f"{_ID}, text s")
def _(v):
    return v.segments.withColumn("text", T.prepare_speech_text(F.concat("text", F.lit("... 5 — 10")), F.lit("hi"), {"the": "thuh"}))


@query("t17_apply_pronunciation", f"{_ID}, text s", "segments", "SELECT track_id, seg_idx, replace(replace(text, 'tion', 'shun'), 'the', 'thuh') AS text FROM segments")
def _(v):
    return v.segments.withColumn("text", T.apply_pronunciation(F.col("text"), {"the": "thuh", "tion": "shun"}))


@query("t18_simplify_for_retry", f"{_ID}, two s, half s", "segments", "SELECT track_id, seg_idx, array_to_string(toks[1:greatest(3, floor(n * 0.8)::INT)], ' ') AS two, array_to_string(toks[1:greatest(3, n // 2)], ' ') AS half FROM segments")
def _(v):
    bare = F.regexp_replace("text", "[।.!?]", "")
    return v.segments.select("track_id", "seg_idx", T.simplify_for_retry(F.col("text"), F.lit(2)).alias("two"), T.simplify_for_retry(F.regexp_replace(bare, "^$", ""), F.lit(3)).alias("bare"), F.array_join(F.slice("toks", 1, F.greatest(F.floor(F.col("n") / 2).cast("int"), F.lit(3))), " ").alias("half"))


@query("t19_apply_glossary_replacement", f"{_ID}, text s", "segments", "SELECT track_id, seg_idx, replace(text, 'and', '&') AS text FROM segments")
def _(v):
    return v.segments.withColumn("text", T.apply_glossary_replacement(F.col("text"), {"and": "&"}))


@query("t23_content_key", f"{_ID}, k s, compat s", "segments", "SELECT track_id, seg_idx, sha256(text || chr(31) || speaker) AS k, sha256(text || speaker) AS compat FROM segments")
def _(v):
    return v.segments.select("track_id", "seg_idx", T.content_key(F.col("text"), F.col("speaker")).alias("k"), T.content_key(F.col("text"), F.col("speaker"), compat=True).alias("compat"))


@query("t24_split_text_chunks", "doc_id b, chunk_idx b, chunk s", "", """
    SELECT doc_id, unnest(range(len(c))) AS chunk_idx, unnest(c) AS chunk FROM (
        SELECT doc_id, string_split(list_reduce(s, lambda t, x: CASE WHEN length(string_split(t, chr(2))[-1]) + 1 + length(x) <= 4500 THEN t || ' ' || x ELSE t || chr(2) || x END), chr(2)) AS c FROM (
            SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) WHERE len(s) > 0)""")
def _(v):
    return v.table("documents").select("doc_id", F.posexplode(T.split_text_chunks(F.col("text"), 4500)).alias("chunk_idx", "chunk"))


# Quality -------------------------------------------------------------------------------------------------------------


@query("q01_english_qc", f"{_ID}, flags s", "segments", """SELECT track_id, seg_idx, concat_ws('|',
    CASE WHEN d > 5.5 THEN printf('dur:%.1fs>5.5', d) END,
    CASE WHEN d < 0.8 AND n > 1 AND NOT regexp_matches(trim(text), '[.!?]$') THEN printf('micro:%.1fs', d) END,
    CASE WHEN n > 16 THEN 'words:' || n || '>16' END,
    CASE WHEN d > 0.3 AND n / d > 5.2 THEN printf('wps:%.1f', n / d) END,
    CASE WHEN n > 0 AND NOT regexp_matches(trim(text), '[.!?,;:]$') THEN 'no-punct' END,
    CASE WHEN length(text) > 84 THEN 'cpl:' || length(text) END) AS flags FROM (SELECT *, (end_ms - start_ms) / 1000.0::DOUBLE AS d FROM segments)""")
def _(v):
    return Q.english_qc(v.cues).withColumn("flags", F.array_join("qc_flags", "|"))


@query("q02_pre_tts_qc", f"{_ID}, flags s", "segments glossary", """
    WITH a AS (SELECT *, CASE WHEN seg_idx % 7 = 0 THEN '' ELSE array_to_string(toks[1:n // 2], ' ') END AS t, array_to_string(toks[n * 3 // 4 + 1:n], ' ') AS src, (end_ms - start_ms) / 1000.0::DOUBLE AS d FROM segments),
    b AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM a),
    c AS (SELECT *, len(w) AS m, list_filter(w, lambda x: length(x) > 2) AS long FROM b),
    e AS (SELECT *, list_min(list_filter(list_distinct(long), lambda x: len(list_filter(long, lambda y: y = x)) >= 3)) AS again,
        list_filter(list_transform(string_split(t, chr(10)), lambda x: length(x)), lambda k: k > 42)[1] AS line,
        (SELECT string_agg('glossary-miss:' || canonical, '|' ORDER BY ord) FROM glossary WHERE contains(lower(c.text), lower(canonical)) AND NOT contains(lower(c.t), lower(canonical)) AND NOT contains(lower(c.src), lower(canonical))) AS missed FROM c)
    SELECT track_id, seg_idx, CASE WHEN trim(t) = '' THEN 'empty-hindi' ELSE concat_ws('|',
        CASE WHEN d > 0.3 AND m * 60.0 / 120 > d * 1.5 THEN printf('hi-overlong:%.1fs>%.1fs', m / 2.0::DOUBLE, d) END,
        CASE WHEN m < 2 AND d > 1.0 THEN 'hi-micro' END,
        'repeated:' || again,
        CASE WHEN NOT regexp_matches(t, '[।,!?.]') THEN 'hi-no-punct' END,
        missed,
        'hi-cpl:' || line) END AS flags FROM e""")
def _(v):
    from ..operators import joins as J

    half = F.when(F.col("seg_idx") % 7 == 0, "").otherwise(F.array_join(F.slice("toks", 1, F.floor(F.col("n") / 2).cast("int")), " "))
    tail = F.floor(F.col("n") * 3 / 4).cast("int")
    cues = J.glossary_tag_cues(v.segments, v.glossary).withColumns({"text_translated": half, "src": F.array_join(F.slice("toks", tail + 1, F.col("n")), " ")})
    return Q.pre_tts_qc(cues, source="src").withColumn("flags", F.array_join("qc_flags", "|"))


@query("q03_clip_retry_plan", f"{_ID}, chosen_attempt b, manual_review o", "clips", "SELECT track_id, seg_idx, coalesce(min(a) FILTER (WHERE ok), max(a)) AS chosen_attempt, count(*) FILTER (WHERE ok) = 0 AS manual_review FROM (SELECT track_id, seg_idx, a, a >= rerender_count AND rerender_count < 3 AS ok FROM clips, (SELECT unnest(range(4)) AS a)) GROUP BY ALL")
def _(v):
    tries = v.clips.select("track_id", "seg_idx", "rerender_count", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    return Q.clip_retry_plan(tries.withColumn("ok", (F.col("attempt") >= F.col("rerender_count")) & (F.col("rerender_count") < 3)))


@query("q04_clip_duration_qc", "job_id b, segment_idx b, ratio d, verdict s", "job_segments", "SELECT *, CASE WHEN expected_ms > 100 THEN round(tts_ms * 3 / expected_ms::DOUBLE, 4) END AS ratio, CASE WHEN tts_ms * 3 > 2.5 * expected_ms AND expected_ms > 100 THEN 'too_long' ELSE 'ok' END AS verdict FROM job_segments")
def _(v):
    return Q.clip_duration_qc(v.job_segments.withColumn("tts_ms", F.col("tts_ms") * 3))


@query("q05_sample_qc", "vec_id b, peak d, silent_share d, ok o", "samples", "SELECT vec_id, round(list_max(a), 6) AS peak, round(len(list_filter(a, lambda s: s < 0.01)) / len(a), 6) AS silent_share, NOT (list_max(a) > 0.5 OR len(list_filter(a, lambda s: s < 0.01)) / len(a) > 0.8) AS ok FROM (SELECT vec_id, list_transform(samples, lambda s: abs(s::DOUBLE)) AS a FROM samples)")
def _(v):
    return Q.sample_qc(v.samples, clip=0.5)


@query("q06_trim_bounds", "vec_id b, first_frame b, last_frame b", "samples", "SELECT vec_id, coalesce(list_min(p), 0) AS first_frame, coalesce(list_max(p), 1) AS last_frame FROM (SELECT vec_id, list_filter(range(len(samples)), lambda k: abs(samples[k + 1]::DOUBLE) > 0.05) AS p FROM samples)")
def _(v):
    return Q.trim_bounds(v.samples, threshold=0.05)


# Roll-ups ------------------------------------------------------------------------------------------------------------


@query("a01_qc_summary", "total_cues b, flagged_cues b, pass_rate d, no_punct b", "segments", "SELECT count(*) AS total_cues, count(*) FILTER (WHERE f) AS flagged_cues, round(1 - count(*) FILTER (WHERE f) / count(*), 4) AS pass_rate, count(*) FILTER (WHERE np) AS no_punct FROM (SELECT n > 0 AND NOT regexp_matches(trim(text), '[.!?,;:]$') AS np, (end_ms - start_ms > 5500 OR (end_ms - start_ms < 800 AND n > 1 AND NOT regexp_matches(trim(text), '[.!?]$')) OR n > 16 OR (n > 0 AND NOT regexp_matches(trim(text), '[.!?,;:]$')) OR length(text) > 84) AS f FROM segments)")
def _(v):
    return A.qc_summary(Q.english_qc(v.cues)).withColumn("no_punct", F.coalesce(F.col("categories")["no-punct"], F.lit(0)))


_TOTALS = """count(*) AS cues, sum(end_ms - start_ms) AS original_ms, round(sum(new_end_ms - new_start_ms), 1) AS new_ms,
    round(CASE WHEN sum(end_ms - start_ms) > 0 THEN (sum(new_end_ms - new_start_ms) - sum(end_ms - start_ms)) * 100.0 / sum(end_ms - start_ms) ELSE 0 END, 2) AS expansion_pct,
    count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'fail') AS fail,
    coalesce(min(video_speed) FILTER (WHERE video_speed <> 1), 1) AS min_speed, coalesce(max(video_speed) FILTER (WHERE video_speed <> 1), 1) AS max_speed"""
_TOTAL_COLUMNS = "cues b, original_ms b, new_ms d, expansion_pct d, ok b, warn b, fail b, min_speed d, max_speed d"


@query("a03_slot_summary", f"track_id b, {_TOTAL_COLUMNS}", "cues", f"SELECT track_id, {_TOTALS} FROM ({SLOTS_SQL}) GROUP BY track_id")
def _(v):
    return A.slot_summary(W.recompute_slots(v.cues))


@query("a06_slot_report_totals", _TOTAL_COLUMNS, "cues", f"SELECT {_TOTALS} FROM ({SLOTS_SQL})")
def _(v):
    return A.slot_report_totals(W.recompute_slots(v.cues))


@query("a04_global_stretch", "track_id b, words b, raw_ms b, audio_ms d, overflow_ms d, video_speed d", "clips segments durations", "SELECT track_id, words, raw_ms, round(raw_ms / 1.25, 4) AS audio_ms, round(raw_ms / 1.25 - duration_ms, 4) AS overflow_ms, CASE WHEN raw_ms / 1.25 > duration_ms THEN round(duration_ms / (raw_ms / 1.25), 4) ELSE 1 END AS video_speed FROM (SELECT track_id, sum(tts_ms)::DOUBLE AS raw_ms FROM clips GROUP BY ALL) JOIN (SELECT track_id, sum(len(list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: x <> ''))) AS words FROM segments GROUP BY ALL) USING (track_id) JOIN durations USING (track_id)")
def _(v):
    return A.global_stretch(v.clips, v.segments, v.durations)


@query("a07_post_verify", "track_id b, expected_ms b, drift_ms b, status s", "clips durations", "SELECT *, CASE WHEN abs(drift_ms) < 50 THEN 'OK' WHEN abs(drift_ms) < 200 THEN 'WARNING' ELSE 'DRIFT TOO LARGE' END AS status FROM (SELECT track_id, duration_ms AS expected_ms, (track_id * 37) % 300 AS drift_ms FROM durations)")
def _(v):
    actual = v.durations.select("track_id", (F.col("duration_ms") + (F.col("track_id") * 37) % 300).alias("actual_ms"))
    return A.post_verify(v.cues.withColumn("new_end_ms", F.lit(None).cast("bigint")), actual)


@query("a08_job_metrics", "id b, state s, total_segments b, manual_review_count b, pass_rate_first_try d", "jobs job_segments", "SELECT id, state, coalesce(n, 0) AS total_segments, coalesce(m, 0) AS manual_review_count, CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE round((n - m) / n, 4) END AS pass_rate_first_try FROM jobs LEFT JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE qc_status = 'manual_review') AS m FROM job_segments GROUP BY ALL) ON id = job_id")
def _(v):
    return A.job_metrics(v.jobs, v.job_segments)


@query("a09_job_metrics_rollup", "tts_engine s, target_language s, state s, level b, jobs b, segments b, avg_duration_error_ms d, manual_reviews b", "jobs job_segments", "SELECT tts_engine, target_language, state, grouping(tts_engine, target_language, state) AS level, count(*) AS jobs, coalesce(sum(n), 0) AS segments, round(sum(e) / sum(n), 4) AS avg_duration_error_ms, coalesce(sum(m), 0) AS manual_reviews FROM jobs LEFT JOIN (SELECT job_id, count(*) AS n, sum(tts_ms - expected_ms)::BIGINT AS e, count(*) FILTER (WHERE qc_status = 'manual_review') AS m FROM job_segments GROUP BY ALL) ON id = job_id GROUP BY ROLLUP (tts_engine, target_language, state)")
def _(v):
    return A.job_metrics_rollup(v.jobs, v.job_segments)


@query("a10_segment_duration_error", "job_id b, n b, avg_duration_error_ms d", "job_segments", "SELECT job_id, count(*) AS n, round(avg(tts_ms - expected_ms), 4) AS avg_duration_error_ms FROM job_segments GROUP BY job_id")
def _(v):
    return A.mean_duration_error(v.job_segments)


@query("a11_batch_progress", "progress_pct b, completed b, error b, running b", "jobs", "SELECT round(avg(CASE WHEN state = 'done' THEN 1.0 ELSE 0.5 END) * 100) AS progress_pct, count(*) FILTER (WHERE state = 'done') AS completed, count(*) FILTER (WHERE state = 'error') AS error, count(*) FILTER (WHERE state = 'running') AS running FROM jobs")
def _(v):
    return A.batch_progress(v.jobs.withColumn("progress", F.when(F.col("state") == "done", 1.0).otherwise(0.5)))


@query("a12_quota_usage", "month s, credential s, chars b, headroom b, exhausted o", "usage", "SELECT strftime(ts, '%Y-%m') AS month, credential, sum(chars) AS chars, greatest(950000 - sum(chars), 0) AS headroom, sum(chars) >= 950000 AS exhausted FROM usage GROUP BY ALL")
def _(v):
    return A.quota_usage(v.usage)


@query("a13_translated_ratio_gate", "track_id b, ratio d, passes o", "segments translations", "SELECT track_id, round(count(*) FILTER (WHERE trim(t.text_translated) <> trim(s.text)) / count(*), 4) AS ratio, ratio >= 0.3 AS passes FROM segments s JOIN translations t USING (track_id, seg_idx) WHERE engine = 'e3' GROUP BY track_id")
def _(v):
    t = v.translations.filter("engine = 'e3'").drop("engine")
    return A.translated_ratio_gate(v.segments.join(t, ["track_id", "seg_idx"]))


@query("a15_extract_glossary", "track_id b, canonical s, rule s", "words", """
    WITH t AS (SELECT track_id, string_agg(text, ' ' ORDER BY word_idx) AS t FROM words GROUP BY track_id),
    f AS (SELECT track_id, unnest(regexp_extract_all(t, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1)) AS canonical, 1 AS k, 'phrase' AS rule FROM t
        UNION ALL SELECT track_id, unnest(regexp_extract_all(t, '\\b((?i:[A-Z]{1,2}[-\\s]?(?:rank|class|tier|level)(?:ed)?))\\b', 1)), 2, 'rank' FROM t
        UNION ALL SELECT track_id, text, 3, 'repeated' FROM words WHERE length(text) > 2 AND regexp_matches(text, '^\\p{Lu}') AND text <> upper(text) GROUP BY track_id, text HAVING count(*) >= 3)
    SELECT track_id, canonical, arg_min(rule, k) AS rule FROM f GROUP BY track_id, canonical""")
def _(v):
    return A.extract_glossary(v.words)


@query("a16_tts_budget", "track_id b, total_words b, max_words_segment b", "segments", "SELECT track_id, sum(n) AS total_words, max(n) AS max_words_segment FROM segments GROUP BY track_id")
def _(v):
    return A.tts_budget(v.segments)


@query("a17_full_narrative", "track_id b, narrative s, context s", "segments", "SELECT track_id, string_agg(text, ' ' ORDER BY seg_idx) AS narrative, (SELECT substr(string_agg(x.text, ' ' ORDER BY x.seg_idx), 1, 1500) FROM (SELECT text, seg_idx FROM segments i WHERE i.track_id = s.track_id AND seg_idx < 20 AND trim(text) <> '' ORDER BY seg_idx LIMIT 15) x) AS context FROM segments s GROUP BY track_id")
def _(v):
    return A.full_narrative(v.segments)


@query("a18_auto_rate", "track_id b, words b, rate_pct b", "segments durations", "SELECT track_id, words, least(25, greatest(0, ceil(round(words * 6000000.0::DOUBLE / (130 * duration_ms) - 100, 6)))) AS rate_pct FROM (SELECT track_id, sum(n)::BIGINT AS words FROM segments GROUP BY ALL) JOIN durations USING (track_id)")
def _(v):
    return A.auto_rate(v.segments, v.durations)


@query("a19_word_match_verify", f"{_ID}, expected_words b, heard_words b, verdict s", "segments translations", "SELECT s.track_id, s.seg_idx, n AS expected_words, h AS heard_words, CASE WHEN h / n < 0.3 THEN 'truncated' ELSE 'retry' END AS verdict FROM segments s JOIN (SELECT track_id, seg_idx, len(list_filter(regexp_split_to_array(text_translated, '\\s+'), lambda x: x <> '')) AS h FROM translations WHERE engine = 'e2') USING (track_id, seg_idx) WHERE n > 0 AND abs(h - n) / n > 0.15")
def _(v):
    return A.word_match_verify(v.segments, v.translations.filter("engine = 'e2'").withColumnRenamed("text_translated", "text"))


# Tables --------------------------------------------------------------------------------------------------------------


@query("u01_recent_jobs", "id b, state s, created_at t", "jobs", "SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 20")
def _(v):
    return U.recent_jobs(v.jobs)


@query("u02_last_n_events", "job_id b, seq b, step s", "job_events", "SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 50")
def _(v):
    return U.last_n_events(v.job_events, 50)


@query("u03_retention_victims", "id b, state s", "jobs", "SELECT * FROM jobs WHERE state IN ('done', 'error') QUALIFY row_number() OVER (ORDER BY created_at, id) <= (SELECT count(*) - 9000 FROM jobs)")
def _(v):
    return U.retention_victims(v.jobs, 9000)


@query("u05_upsert_latest", "job_id b, segment_idx b, part b, tts_ms b, qc_status s, updated_at t", "job_segments", "SELECT job_id, segment_idx, part, tts_ms + CASE WHEN part % 2 = 0 THEN 1 ELSE 0 END AS tts_ms, qc_status, updated_at FROM (SELECT job_id, segment_idx, part, max(tts_ms) AS tts_ms, max(qc_status) AS qc_status, max(updated_at) AS updated_at FROM job_segments GROUP BY ALL)")
def _(v):
    base = v.job_segments.groupBy("job_id", "segment_idx", "part").agg(F.max("tts_ms").alias("tts_ms"), F.max("qc_status").alias("qc_status"), F.max("updated_at").alias("updated_at"))
    delta = base.filter("part % 2 = 0").withColumn("tts_ms", F.col("tts_ms") + 1)
    return U.upsert_latest(base, delta, ["job_id", "segment_idx", "part"], "updated_at")


@query("u06_recover_states", "id b, state s, message s", "jobs", "SELECT id, CASE WHEN state IN ('running') OR id % 7 = 0 THEN 'error' ELSE state END AS state, CASE WHEN id % 7 = 0 THEN 'unknown state' WHEN state = 'running' THEN 'interrupted by restart' END AS message FROM jobs")
def _(v):
    return U.recover_states(v.jobs.withColumn("state", F.when(F.col("id") % 7 == 0, "odd").otherwise(F.col("state"))))


@query("u07_union_chunks", f"{_ID}, start_ms b", "segments", "SELECT * FROM segments")
def _(v):
    return U.union_chunks(v.segments.filter("seg_idx % 2 = 0"), v.segments.filter("seg_idx % 2 = 1"))


@query("u08_word_set_diff", "track_id b, word s, side s", "words words_alt", "SELECT track_id, word, CASE WHEN a THEN 'missing' ELSE 'extra' END AS side FROM (SELECT coalesce(x.track_id, y.track_id) AS track_id, coalesce(x.word, y.word) AS word, x.word IS NOT NULL AS a, y.word IS NOT NULL AS b FROM (SELECT DISTINCT track_id, lower(text) AS word FROM words) x FULL JOIN (SELECT DISTINCT track_id, lower(text) AS word FROM words_alt) y ON x.track_id = y.track_id AND x.word = y.word) WHERE a <> b")
def _(v):
    return U.word_set_diff(v.words, v.words_alt)


@query("u09_dedupe_links", "url s, id b, preset s", "links", "SELECT url, min(id) AS id, arg_max(preset, added_at) FILTER (WHERE preset IS NOT NULL) AS preset FROM links GROUP BY url")
def _(v):
    return U.dedupe_links(v.links)


@query("u11_sort_segments", f"{_ID}, start_ms b", "segments", "SELECT * FROM segments")
def _(v):
    return U.sort_segments(v.segments)


@query("u12_merge_with_priority", "track_id b, source s, n b", "segments", "SELECT track_id, speaker AS source, count(*) AS n FROM segments WHERE trim(text) <> '' AND (track_id, CASE speaker WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) IN (SELECT track_id, min(CASE speaker WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) FROM segments WHERE trim(text) <> '' GROUP BY track_id) GROUP BY ALL")
def _(v):
    rows = U.merge_with_priority(v.segments.withColumn("source", F.col("speaker")), ["assistant", "user"])
    return rows.groupBy("track_id", "source").agg(F.count("*").alias("n"))


# Sources and sinks over derived texts --------------------------------------------------------------------------------

_TIME = "printf('%02d:%02d:%02d{m}%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"


def _cue_sql(mark: str, head: str, text: str = "trim(text)") -> str:
    a, b = _TIME.format(m=mark, c="start_ms"), _TIME.format(m=mark, c="end_ms")
    return f"SELECT track_id, {head} || string_agg(k || chr(10) || {a} || ' --> ' || {b} || chr(10) || {text} || chr(10), chr(10) ORDER BY k) AS srt FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS k FROM segments WHERE trim(text) <> '') GROUP BY track_id"


@query("s10_srt_text", "track_id b, srt s", "segments", _cue_sql(",", "''", "'[' || speaker || '] ' || trim(text)"))
def _(v):
    return S.srt_text(v.segments, include_speaker=True)


@query("s11_exported_srt", "track_id b, srt s", "segments", _cue_sql(",", "''", "text"))
def _(v):
    return S.exported_srt(v.segments.withColumn("text_hi_raw", F.col("text")))


@query("s12_webvtt_text", "track_id b, srt s", "segments", _cue_sql(".", "'WEBVTT' || chr(10) || chr(10)"))
def _(v):
    return S.webvtt_text(v.segments)


@query("s01_parse_srt", "track_id b, seg_idx b, start_ms b, end_ms b, text s", "segments", "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) - 1 AS seg_idx, start_ms, end_ms, trim(regexp_replace(text, '\\n', ' ', 'g')) AS text FROM segments WHERE trim(text) <> ''")
def _(v):
    return S.parse_srt(S.srt_text(v.segments.withColumn("text", F.regexp_replace("text", "\n", " "))).withColumnsRenamed({"srt": "value", "track_id": "track"})).withColumnRenamed("track", "track_id")


@query("s02_parse_srt_tolerant", "track_id b, cue_idx b, start_ms b, end_ms b, text s", "segments", "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) - 1 AS cue_idx, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM segments WHERE trim(text) <> ''")
def _(v):
    return S.parse_srt_tolerant(S.srt_text(v.segments).withColumnsRenamed({"srt": "value", "track_id": "track"})).withColumnRenamed("track", "track_id")


@query("s03_parse_vtt_segments", "track_id b, seg_idx b, start_ms b, end_ms b, text s", "segments", "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) - 1 AS seg_idx, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM segments WHERE trim(text) <> ''")
def _(v):
    return S.parse_vtt_segments(S.webvtt_text(v.segments).withColumnsRenamed({"srt": "value", "track_id": "track"})).withColumnRenamed("track", "track_id")


@query("s04_parse_vtt_words", "track_id b, word_idx b, text s, start_ms b, end_ms b", "words", """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY track_id, text, round(start_ms / 10) ORDER BY word_idx) AS k FROM words),
    b AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY word_idx) - 1 AS word_idx, text, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY track_id ORDER BY word_idx), start_ms + 500) AS e FROM a WHERE k = 1)
    SELECT *, CASE WHEN e <= start_ms THEN start_ms + 100 ELSE e END AS end_ms FROM b""")
def _(v):
    return S.parse_vtt_words(S.webvtt_text(v.segments).withColumnsRenamed({"srt": "value", "track_id": "track"})).withColumnRenamed("track", "track_id")


@query("s05_words_from_segments", "track_id b, word_idx b, text s, start_ms b, end_ms b", "words segments", "SELECT w.track_id, row_number() OVER (PARTITION BY w.track_id ORDER BY w.word_idx) - 1 AS word_idx, w.text, s.start_ms, s.end_ms FROM words w JOIN segments s USING (track_id, seg_idx) WHERE NOT regexp_matches(w.text, '^(\\[.*\\]|\\(.*\\)|♪.*♪)$')")
def _(v):
    return S.words_from_segments(v.segments)


@query("s06_read_plain_transcript", "track_id b, sent_idx b, text s", "", """
    WITH a AS (SELECT doc_id AS track_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '\\b\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?\\b', ' ', 'g'), '\\[[a-z ]+\\]|♪', ' ', 'gi'), '\\s+'), lambda x: x <> '') AS t FROM documents),
    b AS (SELECT track_id, len(t) AS n, unnest(range(len(t))) AS pos, unnest(t) AS w FROM a),
    c AS (SELECT *, (regexp_matches(w, '[.!?]$') AND lower(w) NOT IN {})::INT AS e FROM b),
    d AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, max(e) OVER (PARTITION BY track_id) = 0 AND n > 40 AS plain FROM c),
    g AS (SELECT track_id, CASE WHEN plain THEN pos // 20 ELSE run END AS cut, string_agg(w, ' ' ORDER BY pos) AS text FROM d GROUP BY ALL)
    SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY cut) - 1 AS sent_idx, text FROM g""".format(tuple(T.ABBREVIATIONS)))
def _(v):
    return S.read_plain_transcript(v.table("documents").select(F.col("doc_id").alias("track_id"), "text"))


@query("s07_parse_glossary", "ord b, canonical s, target_spelling s, action s, pronunciation s, aliases b", "glossary", "SELECT 2 * ord + 1 AS ord, canonical, CASE WHEN ord % 2 = 0 THEN '' ELSE target_spelling END AS target_spelling, CASE WHEN ord % 2 = 0 THEN 'keep' ELSE 'fixed_translation' END AS action, pronunciation, CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS aliases FROM glossary")
def _(v):
    """A file of the terms with one that has no name before each; every other one leaves out what has a default."""
    even = F.to_json(F.struct("canonical", F.array("canonical").alias("aliases"), "pronunciation"))
    odd = F.to_json(F.struct("canonical", "target_spelling", "action", "pronunciation"))
    entry = F.struct("ord", F.concat(F.lit('{"aliases": ["nameless"]}, '), F.when(F.col("ord") % 2 == 0, even).otherwise(odd)).alias("j"))
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["j"])
    file = v.glossary.agg(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")).alias("value"))
    return S.parse_glossary(file).withColumn("aliases", F.size("aliases"))


@query("s08_parse_pronunciation", "src s, dst s", "glossary", "SELECT canonical AS src, target_spelling AS dst FROM glossary WHERE ord % 3 <> 1")
def _(v):
    """Every third entry is a comment (its key begins with _) or a number."""
    key = F.when((F.col("ord") % 3 == 1) & (F.col("ord") % 2 == 0), F.concat(F.lit("_"), "canonical")).otherwise(F.col("canonical"))
    value = F.when((F.col("ord") % 3 == 1) & (F.col("ord") % 2 == 1), F.col("ord").cast("string")).otherwise(F.concat(F.lit('"'), "target_spelling", F.lit('"')))
    pairs = F.collect_list(F.concat(F.lit('"'), key, F.lit('": '), value))
    return S.parse_pronunciation(v.glossary.agg(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("value")))


@query("s09_parse_job_store", "id b, state s, message s, source_url s, tts_engine s, seconds d", "jobs", "SELECT id, CASE WHEN state IN ('running') OR id % 7 = 0 THEN 'error' ELSE state END AS state, CASE WHEN id % 7 = 0 THEN 'unknown state' WHEN state = 'running' THEN 'interrupted by restart' END AS message, source_url, tts_engine, CASE WHEN id % 3 <> 0 THEN (id % 100) / 4.0 END AS seconds FROM jobs")
def _(v):
    times = F.when(F.col("id") % 3 != 0, F.create_map(F.lit("download"), (F.col("id") % 100) / 4))
    payload = F.to_json(F.struct("source_url", "target_language", "tts_engine", times.alias("step_times")))
    rows = v.jobs.select("id", F.when(F.col("id") % 7 == 0, "odd").otherwise(F.col("state")).alias("state"), payload.alias("payload"))
    return S.parse_job_store(rows).select("id", "state", "message", "payload.source_url", "payload.tts_engine", F.col("payload.step_times")["download"].alias("seconds"))


@query("s09_job_store_upsert", "id b, state s, tts_engine s, created_at t, updated_at t", "jobs", """
    SELECT id, CASE WHEN id % 5 = 0 THEN 'done' WHEN state = 'running' THEN 'error' ELSE state END AS state,
        CASE WHEN id % 5 = 0 THEN upper(tts_engine) ELSE tts_engine END AS tts_engine, created_at,
        CASE WHEN id % 5 = 0 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS updated_at FROM jobs""")
def _(v):
    """A store of all jobs but some, then an upsert of changed and of new ones, and one that is out of date."""
    root = scratch_dir(v.spark, "job-store")
    none = F.lit(None).cast("map<string,double>")
    stored = lambda jobs, engine: jobs.select("id", "state", F.struct("source_url", "target_language", engine.alias("tts_engine"), none.alias("step_times")).alias("payload"), "created_at", "updated_at")
    jobs = v.jobs.withColumns({"created_at": F.col("created_at").cast("timestamp_ntz")}).withColumn("updated_at", F.col("created_at"))
    S.create_job_store(stored(jobs.filter("id % 10 <> 0"), F.col("tts_engine")), root, buckets=16)
    later = jobs.filter("id % 5 = 0").withColumns({"state": F.lit("done"), "updated_at": F.expr("updated_at + INTERVAL 1 DAY"), "created_at": F.expr("created_at + INTERVAL 1 HOUR")})
    S.save_jobs(stored(jobs.filter("id % 10 = 0"), F.col("tts_engine")), root)
    S.save_jobs(stored(later, F.upper("tts_engine")), root)
    S.save_jobs(stored(jobs.filter("id % 25 = 0").withColumn("state", F.lit("queued")), F.lit("old")), root)
    return S.load_jobs(v.spark, root).select("id", "state", "payload.tts_engine", "created_at", "updated_at")


@query("s13_tts_rows", "track_id b, speaker s, start_time d, end_time d, translation s", "segments", "SELECT track_id, speaker, round(start_ms / 1000.0, 3) AS start_time, round(end_ms / 1000.0, 3) AS end_time, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS translation FROM segments")
def _(v):
    return S.tts_rows(v.cues)


@query("s14_cue_json", f"{_ID}, n b", "segments", "SELECT track_id, seg_idx, n FROM segments")
def _(v):
    j = S.cue_json(v.segments.select("track_id", "seg_idx", "text", "n"))
    return j.withColumn("n", F.get_json_object("json", "$.n"))


@query("s15_export_tts_segments", f"{_ID}, start_ms b, original_start_ms b, text_translated s", "segments", "SELECT track_id, seg_idx, start_ms + 5 AS start_ms, start_ms AS original_start_ms, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text_translated FROM segments")
def _(v):
    return S.export_tts_segments(v.cues.withColumns({"new_start_ms": F.col("start_ms") + 5, "new_end_ms": F.col("end_ms") + 5}))


@query("s16_pending_tracks", "track_id b", "segments", "SELECT DISTINCT track_id FROM segments WHERE track_id % 3 <> 0")
def _(v):
    return S.pending_tracks(v.segments, v.segments.filter("track_id % 3 = 0"))


@query("s17_slot_fit_report", "track_id b, id b, original_start_ms b, original_end_ms b, tts_ms d, audio_speedup d, word_count b, new_start_ms d, new_end_ms d, video_speed d, drift_ms d, status s", "cues", f"SELECT track_id, seg_idx AS id, start_ms AS original_start_ms, end_ms AS original_end_ms, spoken_ms AS tts_ms, audio_speedup, n AS word_count, new_start_ms, new_end_ms, video_speed, drift_ms, status FROM ({SLOTS_SQL})")
def _(v):
    return S.slot_fit_report_rows(W.recompute_slots(v.cues))


@query("x01_map_text", f"{_ID}, text_hi_raw s", "segments", "SELECT track_id, seg_idx, CASE WHEN trim(text) <> '' THEN reverse(text) END AS text_hi_raw FROM segments")
def _(v):
    return X.map_text(v.segments, lambda t, hints: t[::-1])


@query("x02_similarity_ratio", f"{_ID}, ratio d")
def _(v):
    return v.segments.withColumn("ratio", X.similarity_ratio(F.col("text"), F.expr("substring(text, 10)")))


@query("x03_with_retry_fallback", f"{_ID}, text_translated s", "segments", "SELECT track_id, seg_idx, CASE WHEN n % 2 = 0 THEN reverse(text) ELSE text || '!' END AS text_translated FROM segments WHERE trim(text) <> ''")
def _(v):
    fns = [lambda t, h: t[::-1] if len(t.split()) % 2 == 0 else "", lambda t, h: t + "!"]
    return X.with_retry_fallback(v.segments.filter(F.trim("text") != ""), fns, T.is_bad_translation)


@query("x04_sql_functions", f"{_ID}, t s", "segments", f"SELECT track_id, seg_idx, {_TIME.format(m=',', c='start_ms')} AS t FROM segments")
def _(v):
    X.register_sql(v.spark)
    return v.segments.selectExpr("track_id", "seg_idx", "format_srt_time(start_ms) AS t")
