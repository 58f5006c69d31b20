"""Joins of timed tables: interval, dictionary, key and membership joins.

Interval joins always carry the track as an equality. For long tracks a time bucket joins the key: a row enters every
bucket that it touches, and a pair counts in the first bucket that both share.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from .terms import TERM_BLOCK, find_terms

#: Dictionaries are broadcast up to so many rows; larger ones join by shuffling.
BROADCAST_ROWS = 100_000
#: Interval joins deal a track by minutes; None would compare all pairs of a track.
BUCKET_MS = 60_000


def dimension(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is small; counts no further than one row past the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def _by_bucket(left: DataFrame, right: DataFrame, slack_ms: int, bucket_ms: int | None, how: str, bucket: str | None = None) -> DataFrame:
    """Rows l.*, r, overlap_ms of one evaluation of the join. With buckets a left join gives a row that overlaps nothing
    in some of its buckets a null r there, besides what it overlaps in others. bucket: a column to keep the bucket in."""
    r = right.select(F.col("track_id").alias("_t"), F.struct(*[c for c in right.columns if c != "track_id"]).alias("r"))
    r = r.withColumns({"_from": F.col("r.start_ms"), "_to": F.col("r.end_ms")})
    over = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r.start_ms"), F.col("r.end_ms"))
    # over > -slack_ms, said so that most pairs need one or two comparisons; a time that is null is in one that fails
    near = [b - a > -slack_ms for a, b in ((F.col("_from"), F.col("end_ms")), (F.col("start_ms"), F.col("_to")), (F.col("start_ms"), F.col("end_ms")), (F.col("_from"), F.col("_to")))]
    on = reduce(and_, near, F.col("track_id") == F.col("_t"))
    if bucket_ms is not None:
        at = lambda c: F.floor(c / bucket_ms).cast("bigint")
        ends = lambda s, e: F.sequence(at(s), F.greatest(at(s), at(e)))
        left = left.withColumn("_b", F.explode_outer(ends(F.col("start_ms") - slack_ms, F.col("end_ms") + slack_ms)))
        r = r.withColumn("_c", F.explode(ends(F.col("_from"), F.col("_to"))))
        on = on & (F.col("_b") == F.col("_c")) & (F.col("_b") == F.greatest(at(F.col("start_ms") - slack_ms), at(F.col("_from"))))
    pairs = left.join(r, on, how).withColumn("overlap_ms", F.when(F.col("r").isNotNull(), over)).drop("_t", "_c", "_from", "_to")
    return pairs.drop("_b") if bucket is None else pairs.withColumnRenamed("_b", bucket)


def interval_join(left: DataFrame, right: DataFrame, *, slack_ms: int = 0, bucket_ms: int | None = BUCKET_MS, how: str = "left") -> DataFrame:
    """Rows l.*, r (a struct of right's row, null where nothing overlaps), overlap_ms > -slack_ms, of one track.

    A left join keeps rows without a time, and rows that repeat come out each. bucket_ms None compares all pairs of a
    track.
    """
    if how == "inner" or bucket_ms is None:
        return _by_bucket(left, right, slack_ms, bucket_ms, how)
    numbered = stored(left.withColumn("_id", F.monotonically_increasing_id()), "numbered-rows")  # so that the numbers stay
    pairs = _by_bucket(numbered, right, slack_ms, bucket_ms, how)
    w = Window.partitionBy("_id")
    hits = F.count("r").over(w)
    first = F.row_number().over(w.orderBy(F.col("r").isNull()))
    pairs = pairs.withColumns({"_hits": hits, "_k": first}).filter(F.col("r").isNotNull() | ((F.col("_hits") == 0) & (F.col("_k") == 1)))
    return pairs.drop("_id", "_hits", "_k")


def best_overlap(left: DataFrame, right: DataFrame, key: str, rank: Column, *, slack_ms: int = 0, bucket_ms: int | None = BUCKET_MS, extra: dict[str, Column] | None = None, sure: Column | None = None, rival: Column | None = None) -> DataFrame:
    """Each row of left (one for a track and key) with the overlapping row of right that ranks highest: l.*, r,
    overlap_ms, and the `extra` expressions of both; null where nothing overlaps. rank may use r, overlap_ms and extra.

    sure: pairs that only others of the kind, or those of `rival`, can equal in rank. Where a row has one, `extra` is not
    evaluated for the rest.

    With buckets (and without `sure`) the best of each bucket is found where the join has put its rows, and stored; only rows
    that touch several buckets are shuffled once more.
    """
    apart = bucket_ms is not None and sure is None
    pairs = _by_bucket(left, right, slack_ms, bucket_ms, "left", "_at" if apart else None)
    if sure is not None:
        pairs = pairs.withColumn("_sure", F.coalesce(sure, F.lit(False)))
        settled = F.max("_sure").over(Window.partitionBy("track_id", key))
        pairs = pairs.withColumn("_settled", settled).filter(F.col("_sure") | ~F.col("_settled") | F.coalesce(rival, F.lit(False))).drop("_sure", "_settled")
    pairs = pairs.withColumns(extra or {})
    found = F.col("r").isNotNull()
    own = [c for c in left.columns if c not in ("track_id", key)]
    theirs = ["r", "overlap_ms", *(extra or {})]

    def of(rows: DataFrame, *keys: str) -> DataFrame:
        best = rows.groupBy(*keys).agg(F.first(F.struct(*own)).alias("_own"), F.max_by(F.struct(*theirs), F.when(found, rank)).alias("_best"))
        return best.select("track_id", key, "_own.*", "_best.*")

    if not apart:
        return of(pairs, "track_id", key)
    at = lambda c: F.floor(c / bucket_ms)
    several = F.coalesce(at(F.col("end_ms") + slack_ms) > at(F.col("start_ms") - slack_ms), F.lit(False))
    best = stored(of(pairs, "track_id", "_at", key).withColumn("_several", several), "best-of-buckets")
    again = of(best.filter("_several").drop("_several"), "track_id", key)
    return best.filter("not _several").drop("_several").unionByName(again)


def reconcile_words(text_words: DataFrame, timing_words: DataFrame, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Each text word with the timing word of largest positive overlap (ties: the earlier word).

    Text from the left, times from the right, speaker from the right or else the left; source tells which. A word without
    overlap keeps its own times. If one side of a track has no words the other side's are returned for that track.
    """
    ours = text_words.select("track_id", "word_idx", "text", "start_ms", "end_ms", "speaker")
    theirs = timing_words.select("track_id", "word_idx", "start_ms", "end_ms", "speaker")
    best = best_overlap(ours, theirs, "word_idx", F.struct("overlap_ms", -F.col("r.word_idx")), bucket_ms=bucket_ms)
    hit = F.col("r").isNotNull()
    ours = best.select(
        "track_id",
        "word_idx",
        "text",
        F.when(hit, F.col("r.start_ms")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(hit, F.col("r.end_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.coalesce("r.speaker", "speaker").alias("speaker"),
        F.when(hit, "reconciled").otherwise("parakeet").alias("source"),
    )
    rest = timing_words.join(text_words.select("track_id").distinct(), "track_id", "left_anti")
    kind = F.col("source") if "source" in rest.columns else F.lit("timing")
    return ours.unionByName(rest.withColumn("source", kind).select(*ours.columns))


def assign_speakers(segments: DataFrame, ranges: DataFrame, default: str = "SPEAKER_00", bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Adds speaker: of the largest summed overlap (ties: whose range starts first), else the default."""
    pairs = interval_join(segments.select("track_id", "seg_idx", "start_ms", "end_ms"), ranges, bucket_ms=bucket_ms, how="inner")
    total = pairs.groupBy("track_id", "seg_idx", F.col("r.speaker").alias("_who")).agg(F.sum("overlap_ms").alias("n"), F.min("r.start_ms").alias("first"))
    best = total.groupBy("track_id", "seg_idx").agg(F.max_by("_who", F.struct("n", -F.col("first"))).alias("speaker"))
    return segments.drop("speaker").join(best, ["track_id", "seg_idx"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(default)))


def align_reference(ours: DataFrame, ref: DataFrame, mode: str = "coverage", slack_ms: int = 2000, fast: bool = False, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Adds best_ref, ratio, overlap_ms and status.

    coverage: the reference row of largest overlap; COVERED if that is over 0.5 s, else GAP; ratio to the own duration.
    text: the most similar text among near rows; MATCH from 0.5, else MISMATCH; fast: by edit distance instead.
    NO_REF where no row is near.
    """
    sure = rival = None
    if mode == "coverage":
        ratio = F.col("overlap_ms") / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(100))
        rank = F.struct("overlap_ms", -F.col("r.ref_idx"))
    else:
        from .udfs import similarity_ratio

        a, b = F.lower("text"), F.lower("r.text")
        near = F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))
        ratio = near if fast else similarity_ratio(a, b)
        rank = F.struct("ratio", -F.col("r.ref_idx"))
        sure, rival = a == b, F.length(a) + F.length(b) >= 10_000  # unlike texts as long as that may be alike in four digits
    ratio = F.when(F.col("r").isNotNull(), F.round(ratio, 4))
    best = best_overlap(ours.select("track_id", "seg_idx", "start_ms", "end_ms", "text"), ref, "seg_idx", rank, slack_ms=slack_ms, bucket_ms=bucket_ms, extra={"ratio": ratio}, sure=sure, rival=rival)
    good = F.col("overlap_ms") > 500 if mode == "coverage" else F.col("ratio") >= 0.5
    words = ("COVERED", "GAP") if mode == "coverage" else ("MATCH", "MISMATCH")
    status = F.when(F.col("r").isNull(), "NO_REF").when(good, words[0]).otherwise(words[1])
    return best.select("track_id", "seg_idx", F.col("r.ref_idx").alias("best_ref"), "ratio", "overlap_ms", status.alias("status"))


# Dictionaries --------------------------------------------------------------------------------------------------------


def glossary_words(glossary: DataFrame) -> DataFrame:
    """word, term: each single lower-case word of a term's canonical form and aliases; later terms win."""
    forms = F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    words = glossary.select("ord", "canonical", forms.alias("form")).select("ord", "canonical", F.explode(T.tokens(F.lower("form"))).alias("word"))
    return words.groupBy("word").agg(F.max_by("canonical", "ord").alias("term"))


def glossary_tag_words(words: DataFrame, glossary: DataFrame) -> DataFrame:
    """Adds protected and term_id by equality with a term's words, whatever the case."""
    terms = dimension(glossary_words(glossary)).withColumnRenamed("word", "_w")
    out = words.drop("protected", "term_id").join(terms, F.lower("text") == F.col("_w"), "left").drop("_w")
    return out.withColumn("protected", F.col("term").isNotNull()).withColumnRenamed("term", "term_id")


def _with_terms(cues: DataFrame, glossary: DataFrame, col: str, block_chars: int = TERM_BLOCK) -> DataFrame:
    """Adds _terms: the glossary's terms (ord, canonical, target_spelling, action, pronunciation), in its order, whose
    canonical form the text contains, whatever the case. Terms without a character are passed over, a null text has none.
    """
    g = glossary.select("ord", "canonical", "target_spelling", "action", "pronunciation").filter("canonical <> ''")
    rows = find_terms(cues.withColumn("_low", F.lower(F.col(col))), "_low", g.withColumn("_form", F.lower("canonical")), "_form", "_terms", block_chars)
    return rows.drop("_low").withColumn("_terms", F.array_sort("_terms"))


def glossary_tag_cues(cues: DataFrame, glossary: DataFrame, col: str = "text", block_chars: int = TERM_BLOCK) -> DataFrame:
    """Adds protected_terms (in glossary order) and pronunciation_overrides (by target spelling or canonical form)."""
    said = F.filter("_terms", lambda t: F.coalesce(t["pronunciation"], F.lit("")) != "")
    name = lambda t: F.coalesce(F.nullif(t["target_spelling"], F.lit("")), t["canonical"])
    pairs = F.transform(said, lambda t: F.struct(name(t).alias("key"), t["pronunciation"].alias("value")))
    out = _with_terms(cues, glossary, col, block_chars)
    return out.withColumns({"protected_terms": F.transform("_terms", lambda t: t["canonical"]), "pronunciation_overrides": F.map_from_entries(F.array_distinct(pairs))}).drop("_terms")


def glossary_validate(cues: DataFrame, glossary: DataFrame, source: str = "text", target: str = "text_translated", block_chars: int = TERM_BLOCK) -> DataFrame:
    """Appends glossary-miss:t (a kept term is absent) and glossary-drift:t (a fixed translation is absent) to qc_flags."""
    out = F.lower(F.col(target))
    miss = lambda t: (t["action"] == "keep") & ~F.contains(out, F.lower(t["canonical"]))
    drift = lambda t: (t["action"] == "fixed_translation") & ~F.contains(out, F.lower(t["target_spelling"]))
    flag = lambda t: F.when(miss(t), F.concat(F.lit("glossary-miss:"), t["canonical"])).when(drift(t), F.concat(F.lit("glossary-drift:"), t["canonical"]))
    none = F.array().cast("array<string>")
    old = F.coalesce("qc_flags", none) if "qc_flags" in cues.columns else none
    return _with_terms(cues, glossary, source, block_chars).withColumn("qc_flags", F.concat(old, F.array_compact(F.transform("_terms", flag)))).drop("_terms")


# Keys ----------------------------------------------------------------------------------------------------------------


def translation_memory_lookup(todo: DataFrame, memory: DataFrame, keys: list[str], compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits with output, misses once for each key) by content key. memory: key, output."""
    keyed = todo.withColumn("key", T.content_key(*map(F.col, keys), compat=compat))
    hits = keyed.join(memory.select("key", "output"), "key")
    return hits, keyed.join(memory.select("key"), "key", "left_anti").dropDuplicates(["key"])


def mark_completed(links: DataFrame, completed: DataFrame) -> DataFrame:
    done = completed.select(F.col("url").alias("_url")).distinct()
    return links.join(done, F.col("url") == F.col("_url"), "left").withColumn("completed", F.col("_url").isNotNull()).drop("_url")


def jobs_for_url(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    return jobs.join(urls.select(F.col("url").alias("source_url")), "source_url", "left_semi")


def urls_without_jobs(links: DataFrame, jobs: DataFrame) -> DataFrame:
    return links.join(jobs.select(F.col("source_url").alias("url")), "url", "left_anti")


def attach_by_index(cues: DataFrame, segments: DataFrame, col: str = "text_translated") -> DataFrame:
    """The cues that have a segment of the same place in their track, with its text."""
    return cues.drop(col).join(segments.select("track_id", "seg_idx", col), ["track_id", "seg_idx"])


def parallel_corpus(src: DataFrame, tgt: DataFrame, how: str = "index", bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """track_id, seg_idx, src_text, tgt_text: by place or by best overlap; blank sides are left out."""
    if how == "index":
        both = src.select("track_id", "seg_idx", F.col("text").alias("src_text")).join(tgt.select("track_id", "seg_idx", F.col("text_translated").alias("tgt_text")), ["track_id", "seg_idx"])
    else:
        pairs = interval_join(src.select("track_id", "seg_idx", "start_ms", "end_ms", F.col("text").alias("src_text")), tgt, bucket_ms=bucket_ms, how="inner")
        k = F.row_number().over(Window.partitionBy("track_id", "seg_idx").orderBy(F.desc("overlap_ms"), "r.ref_idx"))
        both = pairs.withColumn("_k", k).filter("_k = 1").select("track_id", "seg_idx", "src_text", F.col("r.text").alias("tgt_text"))
    return both.filter((F.trim("src_text") != "") & (F.trim("tgt_text") != ""))


def compare_engines(segments: DataFrame, translations: DataFrame, engines: list[str], n: int = 10) -> DataFrame:
    """The first n non-blank segments of each track with a column for each engine's text (null: not translated)."""
    k = F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx"))
    first = segments.filter(F.trim("text") != "").withColumn("_k", k).filter(F.col("_k") <= n).select("track_id", "seg_idx", "text")
    return first.join(translations, ["track_id", "seg_idx"], "left").groupBy("track_id", "seg_idx", "text").pivot("engine", engines).agg(F.first("text_translated"))


def resolve_voice(segments: DataFrame, voice_map: DataFrame, default: str) -> DataFrame:
    """Adds voice: voice_map's for the speaker, else the default."""
    return segments.join(dimension(voice_map.select("speaker", "voice")), "speaker", "left").withColumn("voice", F.coalesce("voice", F.lit(default)))


def clip_to_cue(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Adds tts_ms: the clip's duration, or the cue's own where the clip is missing or failed."""
    c = clips.select("track_id", "seg_idx", F.when(F.col("tts_ms") > 0, F.col("tts_ms")).alias("tts_ms"))
    return cues.drop("tts_ms").join(c, ["track_id", "seg_idx"], "left").withColumn("tts_ms", F.coalesce("tts_ms", F.col("end_ms") - F.col("start_ms")))


def text_swap_by_alignment(asr_words: DataFrame, sub_words: DataFrame, mode: str = "diff", bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """asr_words with the text of the subtitle word they overlap most: always (full) or where the words differ (diff)."""
    columns = ["track_id", "word_idx", "text", "start_ms", "end_ms"]
    best = best_overlap(asr_words.select(*columns), sub_words.select(*columns), "word_idx", F.struct("overlap_ms", -F.col("r.word_idx")), bucket_ms=bucket_ms)
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""))
    swap = F.col("r").isNotNull() & (F.lit(mode == "full") | (bare(F.col("text")) != bare(F.col("r.text"))))
    return best.select("track_id", "word_idx", F.when(swap, F.col("r.text")).otherwise(F.col("text")).alias("text"), "start_ms", "end_ms")
