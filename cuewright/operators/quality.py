"""Quality rules over cues, clips and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _flags(*flags: Column) -> Column:
    return F.array_compact(F.array(*flags))


def _tenths(x: Column) -> Column:
    return F.format_string("%.1f", x)


def with_cue_metrics(cues: DataFrame) -> DataFrame:
    """Adds duration_ms, new_duration_ms, word_count (of the first non-empty layer) and wps (0 without duration)."""
    layers = [c for c in ("text_fit", "text_clean_en", "text") if c in cues.columns]
    n = T.count_words(F.coalesce(T.first_nonempty(*layers), F.lit("")))
    new = (F.col("new_end_ms") - F.col("new_start_ms")) if "new_start_ms" in cues.columns else F.lit(None).cast("bigint")
    out = cues.withColumns({"duration_ms": F.col("end_ms") - F.col("start_ms"), "new_duration_ms": new, "word_count": n})
    return out.withColumn("wps", F.when(F.col("duration_ms") > 0, F.round(F.col("word_count") * 1000.0 / F.col("duration_ms"), 4)).otherwise(0.0))


def english_qc(cues: DataFrame, col: str = "text") -> DataFrame:
    """qc_flags: dur, micro, words, wps, no-punct, cpl."""
    t, d = F.col(col), (F.col("end_ms") - F.col("start_ms")) / 1000.0
    n = T.count_words(t)
    ends = F.coalesce(F.trim(t).rlike(r"[.!?]$"), F.lit(False))
    wps = F.when(d > 0, n / d).otherwise(0.0)
    flags = _flags(
        F.when(d > 5.5, F.concat(F.lit("dur:"), _tenths(d), F.lit("s>5.5"))),
        F.when((d < 0.8) & (n > 1) & ~ends, F.concat(F.lit("micro:"), _tenths(d), F.lit("s"))),
        F.when(n > 16, F.concat(F.lit("words:"), n.cast("string"), F.lit(">16"))),
        F.when((d > 0.3) & (wps > 5.2), F.concat(F.lit("wps:"), _tenths(wps))),
        F.when((n > 0) & ~F.coalesce(F.trim(t).rlike(r"[.!?,;:]$"), F.lit(False)), "no-punct"),
        F.when(F.length(t) > 84, F.concat(F.lit("cpl:"), F.length(t).cast("string"))),
    )
    return cues.withColumn("qc_flags", flags)


def pre_tts_qc(cues: DataFrame, col: str = "text_translated", wpm: int = 120, *, source: str = "text", terms: str = "protected_terms", display: str = "text_hi_display") -> DataFrame:
    """qc_flags before speech is made: empty-hindi alone, or hi-overlong (estimated over 150 % of a slot of more than
    0.3 s), hi-micro (fewer than two words in more than a second), repeated (the smallest word of three letters or more
    that stands there three times), hi-no-punct, glossary-miss (each protected term in neither text, whatever the case),
    hi-cpl (the first displayed line of more than 42 characters). Without the columns terms and display no term is
    protected and the text itself is displayed."""
    t, d = F.col(col), (F.col("end_ms") - F.col("start_ms")) / 1000.0
    words = T.tokens(t)
    n = F.size(words)
    spoken = n * 60.0 / wpm
    long = F.filter(words, lambda w: F.length(w) > 2)
    again = F.array_min(F.filter(F.array_distinct(long), lambda w: F.size(F.filter(long, lambda x: x == w)) >= 3))
    shown = T.first_nonempty(display, col) if display in cues.columns else t
    line = F.get(F.filter(F.transform(F.split(shown, "\n"), F.length), lambda k: k > 42), 0)
    flags = _flags(
        F.when((d > 0.3) & (spoken > d * 1.5), F.concat(F.lit("hi-overlong:"), _tenths(spoken), F.lit("s>"), _tenths(d), F.lit("s"))),
        F.when((n < 2) & (d > 1.0), "hi-micro"),
        F.when(again.isNotNull(), F.concat(F.lit("repeated:"), again)),
        F.when(~t.rlike(r"[।,!?.]"), "hi-no-punct"),
    )
    if terms in cues.columns:
        other = F.lower(F.coalesce(F.col(source), F.lit(""))) if source in cues.columns else F.lit("")
        absent = lambda term: ~F.contains(F.lower(t), F.lower(term)) & ~F.contains(other, F.lower(term))
        missed = F.filter(F.coalesce(terms, F.array().cast("array<string>")), absent)
        flags = F.concat(flags, F.transform(missed, lambda term: F.concat(F.lit("glossary-miss:"), term)))
    flags = F.concat(flags, _flags(F.when(line > 42, F.concat(F.lit("hi-cpl:"), line.cast("string")))))
    return cues.withColumn("qc_flags", F.when(F.coalesce(F.trim(t), F.lit("")) == "", F.array(F.lit("empty-hindi"))).otherwise(flags))


def clip_retry_plan(attempts: DataFrame) -> DataFrame:
    """By clip: the first attempt that passed, else the last one with manual_review. attempts: attempt, ok."""
    out = attempts.groupBy("track_id", "seg_idx").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("good"), F.max("attempt").alias("last"))
    return out.select("track_id", "seg_idx", F.coalesce("good", "last").alias("chosen_attempt"), F.col("good").isNull().alias("manual_review"))


def clip_duration_qc(clips: DataFrame) -> DataFrame:
    """Adds ratio (where more than 0.1 s is expected) and verdict: too_long above 2.5, too_short below 0.15, else ok."""
    ratio = F.when(F.col("expected_ms") > 100, F.col("tts_ms") / F.col("expected_ms"))
    out = clips.withColumn("ratio", F.round(ratio, 4))
    return out.withColumn("verdict", F.when(ratio > 2.5, "too_long").when(ratio < 0.15, "too_short").otherwise("ok"))


def sample_qc(df: DataFrame, col: str = "samples", clip: float = 0.98, silence: float = 0.01, max_silent: float = 0.8) -> DataFrame:
    """Adds peak, silent_share, issues (clipping, silent) and ok, from samples in -1..1; no samples are silent."""
    size = F.transform(F.col(col), lambda s: F.abs(s.cast("double")))
    peak = F.coalesce(F.array_max(size), F.lit(0.0))
    quiet = F.size(F.filter(size, lambda s: s < silence)) / F.greatest(F.size(size), F.lit(1))
    out = df.withColumns({"peak": F.round(peak, 6), "silent_share": F.round(F.when(F.size(size) > 0, quiet).otherwise(1.0), 6)})
    issues = _flags(F.when(peak > clip, "clipping"), F.when(F.col("silent_share") > max_silent, "silent"))
    return out.withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)


def trim_bounds(df: DataFrame, col: str = "samples", threshold: float = 300 / 32767) -> DataFrame:
    """Adds first_frame and last_frame above the threshold; where all is silent, the first two frames."""
    loud = F.transform(F.col(col), lambda s: F.abs(s.cast("double")) > threshold)
    first = F.array_position(loud, True)
    last = F.size(loud) - F.array_position(F.reverse(loud), True)
    return df.withColumns({"first_frame": F.when(first > 0, first - 1).otherwise(0).cast("bigint"), "last_frame": F.when(first > 0, last).otherwise(1).cast("bigint")})
