"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from .registry import query

_ID = "track_id b, seg_idx b"

_RECONCILE = """
    SELECT track_id, word_idx, text, start_ms, end_ms, speaker, source FROM (
        SELECT a.track_id, a.word_idx, a.text, coalesce(b.start_ms, a.start_ms) AS start_ms, coalesce(b.end_ms, a.end_ms) AS end_ms,
               coalesce(b.speaker, a.speaker) AS speaker, CASE WHEN b.word_idx IS NULL THEN 'parakeet' ELSE 'reconciled' END AS source,
               row_number() OVER (PARTITION BY a.track_id, a.word_idx ORDER BY least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) DESC NULLS LAST, b.word_idx) AS k
        FROM words a LEFT JOIN words_alt b ON a.track_id = b.track_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms)
    WHERE k = 1"""


@query("j01_reconcile_words", "track_id b, word_idx b, text s, start_ms b, end_ms b, speaker s, source s", "words words_alt", _RECONCILE)
def _(v):
    return J.reconcile_words(v.words, v.words_alt, bucket_ms=10_000)


@query("j01_reconcile_words_plain", "track_id b, word_idx b, start_ms b, source s", "words words_alt", _RECONCILE)
def _(v):
    return J.reconcile_words(v.words, v.words_alt, bucket_ms=None)


@query("j02_assign_speakers", f"{_ID}, speaker s", "segments speaker_ranges", """
    SELECT s.track_id, s.seg_idx, coalesce(b.speaker, 'SPEAKER_00') AS speaker FROM segments s LEFT JOIN (
        SELECT track_id, seg_idx, speaker, row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY n DESC, f) AS k FROM (
            SELECT s.track_id, s.seg_idx, r.speaker, sum(least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms)) AS n, min(r.start_ms) AS f
            FROM segments s JOIN speaker_ranges r ON s.track_id = r.track_id AND s.start_ms < r.end_ms AND r.start_ms < s.end_ms GROUP BY ALL)) b
    ON s.track_id = b.track_id AND s.seg_idx = b.seg_idx AND k = 1""")
def _(v):
    return J.assign_speakers(v.segments, v.speaker_ranges)


_ALIGN = """
    SELECT s.track_id, s.seg_idx, r.ref_idx AS best_ref, o AS overlap_ms, round(o / greatest(s.end_ms - s.start_ms, 100), 4) AS ratio,
           CASE WHEN r.ref_idx IS NULL THEN 'NO_REF' WHEN o > 500 THEN 'COVERED' ELSE 'GAP' END AS status
    FROM segments s LEFT JOIN (
        SELECT s.track_id, s.seg_idx, r.ref_idx, least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) AS o,
               row_number() OVER (PARTITION BY s.track_id, s.seg_idx ORDER BY least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) DESC, r.ref_idx) AS k
        FROM segments s JOIN ref_segments r ON s.track_id = r.track_id AND least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) > -2000) r
    ON s.track_id = r.track_id AND s.seg_idx = r.seg_idx AND k = 1"""


@query("j03_align_reference_coverage", f"{_ID}, best_ref b, overlap_ms b, ratio d, status s", "segments ref_segments", _ALIGN)
def _(v):
    return J.align_reference(v.segments, v.ref_segments)


@query("j03_align_reference_text", f"{_ID}, best_ref b, ratio d, status s")
def _(v):
    return J.align_reference(v.segments, v.ref_segments, mode="text")


#: The other engine counts bytes in edit distances. In lower-case texts A-Z are free, and so are most control characters, so
#: every character of several bytes gets one of these instead, each its own, which leaves all distances as they are.
_ALIGN_FAST = """
    WITH ch AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT unnest(string_split(lower(text), '')) AS c FROM segments) WHERE c <> '' AND ord(c) > 127),
    m AS (SELECT coalesce(string_agg(c, '' ORDER BY k), '') AS a, coalesce(string_agg(chr(CASE WHEN k < 27 THEN 64 + k ELSE k - 26 END::INT), '' ORDER BY k), '') AS b FROM ch),
    s1 AS (SELECT *, translate(lower(text), a, b) AS t, length(text) AS z FROM segments, m), r1 AS (SELECT *, translate(lower(text), a, b) AS t, length(text) AS z FROM ref_segments, m),
    p AS (SELECT s.track_id, s.seg_idx, r.ref_idx, round(1 - levenshtein(s.t, r.t) / greatest(s.z, r.z, 1), 4) AS ratio
        FROM s1 s JOIN r1 r ON s.track_id = r.track_id AND least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) > -2000),
    q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY track_id, seg_idx ORDER BY ratio DESC, ref_idx) = 1)
    SELECT s.track_id, s.seg_idx, ref_idx AS best_ref, ratio, CASE WHEN ref_idx IS NULL THEN 'NO_REF' WHEN ratio >= 0.5 THEN 'MATCH' ELSE 'MISMATCH' END AS status
    FROM segments s LEFT JOIN q ON q.track_id = s.track_id AND q.seg_idx = s.seg_idx"""


@query("j03_align_reference_fast", f"{_ID}, best_ref b, ratio d, status s", "segments ref_segments", _ALIGN_FAST)
def _(v):
    return J.align_reference(v.segments, v.ref_segments, mode="text", fast=True)


@query("j04_glossary_tag_words", "track_id b, word_idx b, protected o, term_id s", "words glossary", "SELECT w.track_id, w.word_idx, g.canonical IS NOT NULL AS protected, g.canonical AS term_id FROM words w LEFT JOIN (SELECT lower(canonical) AS k, arg_max(canonical, ord) AS canonical FROM glossary GROUP BY 1) g ON lower(w.text) = g.k")
def _(v):
    return J.glossary_tag_words(v.words, v.glossary)


@query("j05_glossary_tag_cues", f"{_ID}, terms s", "segments glossary", "SELECT track_id, seg_idx, coalesce((SELECT string_agg(canonical, ',' ORDER BY ord) FROM glossary WHERE contains(lower(s.text), lower(canonical))), '') AS terms FROM segments s")
def _(v):
    return J.glossary_tag_cues(v.segments, v.glossary).withColumn("terms", F.array_join("protected_terms", ","))


@query("j06_glossary_validate", f"{_ID}, flags s", "segments translations glossary", """
    SELECT s.track_id, s.seg_idx, coalesce(string_agg(CASE WHEN action = 'keep' THEN 'glossary-miss:' ELSE 'glossary-drift:' END || canonical, ',' ORDER BY ord), '') AS flags
    FROM segments s JOIN translations t ON t.track_id = s.track_id AND t.seg_idx = s.seg_idx AND engine = 'e2'
    LEFT JOIN glossary g ON contains(lower(s.text), lower(canonical)) AND NOT contains(lower(t.text_translated), CASE WHEN action = 'keep' THEN lower(canonical) ELSE lower(target_spelling) END)
    GROUP BY ALL""")
def _(v):
    t = v.translations.filter("engine = 'e2'").drop("engine")
    return J.glossary_validate(v.segments.join(t, ["track_id", "seg_idx"]), v.glossary).withColumn("flags", F.array_join("qc_flags", ","))


@query("j07_translation_memory", "k s, n b, hit o", "segments", "SELECT k, CASE WHEN hit THEN count(*) ELSE 1 END AS n, hit FROM (SELECT sha256(text || chr(31) || speaker) AS k, bool_or(track_id % 2 = 0) OVER (PARTITION BY text, speaker) AS hit FROM segments) GROUP BY k, hit")
def _(v):
    from ..functions.text import content_key

    known = v.segments.filter("track_id % 2 = 0").select(content_key(F.col("text"), F.col("speaker")).alias("key"), F.upper("text").alias("output")).dropDuplicates(["key"])
    hits, misses = J.translation_memory_lookup(v.segments, known, ["text", "speaker"])
    rows = hits.select(F.col("key").alias("k"), F.lit(True).alias("hit")).unionByName(misses.select(F.col("key").alias("k"), F.lit(False).alias("hit")))
    return rows.groupBy("k", "hit").agg(F.count("*").alias("n"))


@query("j08_mark_completed", "id b, url s, completed o", "links completed", "SELECT *, url IN (SELECT url FROM completed) AS completed FROM links")
def _(v):
    return J.mark_completed(v.links, v.completed)


@query("j09_jobs_for_url", "id b, source_url s", "jobs", "SELECT * FROM jobs WHERE source_url IN (SELECT DISTINCT 'https://video.example/' || (c_custkey % 10) FROM customer)")
def _(v):
    urls = v.table("customer").select(F.concat(F.lit("https://video.example/"), (F.col("c_custkey") % 10).cast("string")).alias("url")).distinct()
    return J.jobs_for_url(v.jobs, urls)


@query("j09_urls_without_jobs", "url s", "jobs", "SELECT url FROM (SELECT DISTINCT 'https://video.example/' || (c_custkey % 60) AS url FROM customer) WHERE url NOT IN (SELECT source_url FROM jobs)")
def _(v):
    urls = v.table("customer").select(F.concat(F.lit("https://video.example/"), (F.col("c_custkey") % 60).cast("string")).alias("url")).distinct()
    return J.urls_without_jobs(urls, v.jobs)


@query("j10_attach_by_index", f"{_ID}, text_translated s", "translations", "SELECT * FROM translations WHERE engine = 'e1'")
def _(v):
    return J.attach_by_index(v.cues, v.translations.filter("engine = 'e1'"))


@query("j11_parallel_corpus", f"{_ID}, src_text s, tgt_text s", "segments translations", "SELECT s.track_id, s.seg_idx, s.text AS src_text, text_translated AS tgt_text FROM segments s JOIN translations t ON s.track_id = t.track_id AND s.seg_idx = t.seg_idx AND engine = 'e3' WHERE trim(s.text) <> '' AND trim(text_translated) <> ''")
def _(v):
    return J.parallel_corpus(v.segments, v.translations.filter("engine = 'e3'"))


@query("j12_compare_engines", f"{_ID}, e1 s, e2 s, e3 s", "segments translations", "SELECT s.track_id, s.seg_idx, max(text_translated) FILTER (WHERE engine = 'e1') AS e1, max(text_translated) FILTER (WHERE engine = 'e2') AS e2, max(text_translated) FILTER (WHERE engine = 'e3') AS e3 FROM (SELECT * FROM segments WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY seg_idx) <= 3) s JOIN translations t USING (track_id, seg_idx) GROUP BY ALL")
def _(v):
    return J.compare_engines(v.segments, v.translations, ["e1", "e2", "e3"], 3)


@query("j13_resolve_voice", f"{_ID}, voice s", "segments", "SELECT track_id, seg_idx, CASE speaker WHEN 'user' THEN 'v-user' ELSE 'v-default' END AS voice FROM segments")
def _(v):
    voices = v.segments.filter("speaker = 'user'").select("speaker").distinct().withColumn("voice", F.lit("v-user"))
    return J.resolve_voice(v.segments, voices, "v-default")


@query("j14_clip_to_cue", f"{_ID}, tts_ms b", "clips", "SELECT track_id, seg_idx, CASE WHEN seg_idx % 3 = 0 OR tts_ms <= 0 THEN slot_ms ELSE tts_ms END AS tts_ms FROM clips")
def _(v):
    return J.clip_to_cue(v.cues, v.clips.filter("seg_idx % 3 <> 0"))


@query("j15_text_swap_by_alignment", "track_id b, word_idx b, text s", "words words_alt", """
    SELECT track_id, word_idx, text FROM (SELECT a.track_id, a.word_idx,
        CASE WHEN b.word_idx IS NOT NULL AND regexp_replace(lower(a.text), '[^\\p{L}\\p{N}_\\s]', '', 'g') <> regexp_replace(lower('x' || b.text), '[^\\p{L}\\p{N}_\\s]', '', 'g') THEN 'x' || b.text ELSE a.text END AS text,
        row_number() OVER (PARTITION BY a.track_id, a.word_idx ORDER BY least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) DESC NULLS LAST, b.word_idx) AS k
        FROM words a LEFT JOIN words_alt b ON a.track_id = b.track_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms) WHERE k = 1""")
def _(v):
    return J.text_swap_by_alignment(v.words, v.words_alt.withColumn("text", F.concat(F.lit("x"), "text")))


@query("a05_alignment_score", "track_id b, matched b, total b, score d, resource o", "segments ref_segments", f"SELECT track_id, count(*) FILTER (WHERE status = 'COVERED') AS matched, count(*) AS total, round(matched / total, 4) AS score, round(matched / total, 4) < 0.4 AS resource FROM ({_ALIGN}) GROUP BY track_id")
def _(v):
    return A.alignment_score(J.align_reference(v.segments, v.ref_segments))
