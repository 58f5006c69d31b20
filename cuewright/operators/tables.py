"""Filters, limits, upserts, set operations and review queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import dealt_anew

STATES = ["queued", "running", "done", "error", "waiting_for_srt"]


def drop_blank_segments(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(F.trim(col) != "")


def normalize_words(words: DataFrame) -> DataFrame:
    return words.withColumn("text", T.normalize_word(F.col("text"))).filter("text <> ''")


def limit_duration(df: DataFrame, minutes: float = 0) -> DataFrame:
    return df if minutes <= 0 else df.filter(F.col("start_ms") < int(minutes * 60_000))


def long_text_flag(df: DataFrame, limit: int = 500) -> DataFrame:
    """Adds too_long, and too_long_in_track, how many of its track are."""
    out = df.withColumn("too_long", F.length("text") > limit)
    return out.withColumn("too_long_in_track", F.count_if("too_long").over(Window.partitionBy("track_id")))


def latin_leak_filter(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(T.has_latin(F.col(col)) | (T.strip_inline_noise(F.col(col)) != F.trim(col)))


def long_segments(df: DataFrame, threshold: int = 15) -> DataFrame:
    return df.withColumn("n_words", T.count_words(F.col("text"))).filter(F.col("n_words") > threshold)


def manual_review_queue(segments: DataFrame, job_id: int | None = None) -> DataFrame:
    """Segments that wait for a person, with their job's count."""
    rows = segments.filter(F.col("qc_status") == "manual_review")
    rows = rows if job_id is None else rows.filter(F.col("job_id") == job_id)
    return rows.withColumn("in_job", F.count("*").over(Window.partitionBy("job_id")))


def recent_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def last_n_events(events: DataFrame, n: int = 500) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    return events.withColumn("_k", k).filter(F.col("_k") <= n).drop("_k")


def retention_victims(jobs: DataFrame, max_jobs: int = 200) -> DataFrame:
    """The oldest finished jobs that must go to bring the table down to max_jobs.

    Finished jobs are counted by day first, so that only the days around the cut are ranked, not the whole table.
    """
    over = jobs.agg(F.greatest(F.count("*") - max_jobs, F.lit(0)).alias("_over"))
    done = jobs.filter(F.col("state").isin("done", "error")).withColumn("_day", F.to_date("created_at"))
    days = done.groupBy("_day").agg(F.count("*").alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each day
    rows = done.join(before.select("_day", "_before"), "_day").crossJoin(F.broadcast(over)).filter("_before < _over")  # over: one row
    k = F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy("created_at", "id"))
    return rows.withColumn("_k", k).filter("_k <= _over").drop("_k", "_before", "_over", "_day")


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], ts: str, created: str | None = None) -> DataFrame:
    """One row for each key, the latest by ts (delta wins ties); created keeps its earliest value."""
    every = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, "_new")).alias("_r"), *([F.min(created).alias("_c")] if created else []))
    out = [F.col("_c").alias(c) if c == created else F.col(f"_r.{c}").alias(c) for c in rest if c != "_new"]
    return best.select(*keys, *out)


def recover_states(jobs: DataFrame) -> DataFrame:
    """Unknown and null states become error; running ones too, with a message."""
    running = F.col("state") == "running"
    bad = running | F.col("state").isNull() | ~F.col("state").isin(STATES)
    message = F.when(running, "interrupted by restart").when(bad, "unknown state")
    return jobs.withColumn("message", message).withColumn("state", F.when(bad, "error").otherwise(F.col("state")))


def union_chunks(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def word_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """track_id, word, side: words of only one of two tables (missing: of a alone, extra: of b alone)."""
    words = lambda df, s: df.select("track_id", F.lower("text").alias("word")).distinct().withColumn("s", F.lit(s))
    both = words(a, 1).unionByName(words(b, 2)).groupBy("track_id", "word").agg(F.sum("s").alias("s"))
    return both.filter("s < 3").select("track_id", "word", F.when(F.col("s") == 1, "missing").otherwise("extra").alias("side"))


def dedupe_links(links: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row for each URL with the smallest id; a later preset replaces an earlier one."""
    last = F.max_by("preset", F.when(F.col("preset").isNotNull(), F.struct("added_at", "id"))) if "preset" in links.columns else None
    return links.groupBy(*keys).agg(F.min("id").alias("id"), F.min("added_at").alias("added_at"), *([last.alias("preset")] if last is not None else []))


def sort_segments(df: DataFrame) -> DataFrame:
    """Rows of one track in one partition, by start."""
    return dealt_anew(df, "track_id").sortWithinPartitions("track_id", "start_ms", "seg_idx")


def merge_with_priority(df: DataFrame, priority: list[str]) -> DataFrame:
    """By track the rows of the first source that has text. df: track_id, source, text and more."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0)), F.lit(len(priority) + 1))
    rows = df.filter(F.trim("text") != "").withColumn("_rank", rank)
    best = rows.groupBy("track_id").agg(F.min("_rank").alias("_rank"))
    return rows.join(best, ["track_id", "_rank"]).drop("_rank")


def translation_hints(cues: DataFrame, wpm: int = 120) -> DataFrame:
    """Adds hints (null for blank texts): duration_ms, target_words, protected_terms, speaker, emotion."""
    d = F.col("end_ms") - F.col("start_ms")
    have = lambda c, kind: F.col(c) if c in cues.columns else F.lit(None).cast(kind)
    hints = F.struct(
        d.alias("duration_ms"),
        F.greatest(F.floor(d * wpm / 60_000).cast("int"), F.lit(3)).alias("target_words"),
        have("protected_terms", "array<string>").alias("protected_terms"),
        have("speaker", "string").alias("speaker"),
        have("emotion", "string").alias("emotion"),
    )
    return cues.withColumn("hints", F.when(F.trim("text") != "", hints))


def translation_prompt_rows(cues: DataFrame, language: str = "Hindi") -> DataFrame:
    """track_id, seg_idx, system, user: requests for a translator, with protected terms and the room there is."""
    rows = translation_hints(cues).filter("hints is not null")
    terms = F.coalesce(F.array_join("hints.protected_terms", ", "), F.lit(""))
    keep = F.when(terms != "", F.concat(F.lit(" Keep these terms unchanged: "), terms, F.lit("."))).otherwise("")
    system = F.concat(F.lit(f"Translate subtitles into natural spoken {language}."), keep)
    user = F.concat(F.lit("["), F.col("hints.duration_ms").cast("string"), F.lit("ms | ~"), F.col("hints.target_words").cast("string"), F.lit("w] "), F.col("text"))
    return rows.select("track_id", "seg_idx", system.alias("system"), user.alias("user"))


def numbered_batch_prompt(df: DataFrame, size: int = 30) -> DataFrame:
    """track_id, batch, prompt: the batch's texts as lines `1. text`."""
    k = F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx")) - 1
    rows = df.withColumn("_k", k).withColumn("batch", F.floor(F.col("_k") / size).cast("int"))
    line = F.struct("_k", F.concat((F.col("_k") % size + 1).cast("string"), F.lit(". "), F.col("text")).alias("x"))
    return rows.groupBy("track_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda v: v["x"]), "\n").alias("prompt"))


def target_word_count(df: DataFrame, lang_dim: DataFrame, ms_col: str, lang_col: str, default: int = T.DEFAULT_WPM) -> DataFrame:
    """Adds target_words by the language's rate. lang_dim: lang, wpm."""
    dim = lang_dim.select(F.col("lang").alias("_l"), F.col("wpm").alias("_wpm"))
    out = df.join(F.broadcast(dim), F.col(lang_col) == F.col("_l"), "left")  # a few dozen languages
    words: Column = T.target_words(F.col(ms_col), F.coalesce("_wpm", F.lit(default)))
    return out.withColumn("target_words", words).drop("_l", "_wpm")
