"""Subtitle and transcript corpora, glossaries and job stores as tables, and back.

Readers take any path that Spark reads, one file to a track; no text leaves the JVM. track is the file's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .keyed_store import create_store, read_store, replace_in_store, upsert_store

_NOISE = r"^\s*(\[.*\]|\(.*\)|♪.*♪?)\s*$"


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).withColumn("track", F.input_file_name())
    return raw.withColumn("value", F.replace(F.replace(F.regexp_replace("value", "^﻿", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def parse_srt(files: DataFrame, text_key: str = "text") -> DataFrame:
    """files: track, value. Blocks of three lines or more with a time range in the second; [SPEAKER_nn] is taken off."""
    blocks = files.select("track", F.posexplode(F.split(F.trim("value"), r"\n[ \t]*\n")).alias("k", "b"))
    lines = blocks.withColumn("l", F.split(F.trim("b"), "\n")).filter(F.size("l") >= 3)
    times = F.split(F.col("l")[1], r"\s*-->\s*")
    body = F.trim(F.array_join(F.slice("l", 3, F.size("l")), " "))
    speaker = F.nullif(F.regexp_extract(body, r"^\[(SPEAKER_\d+)\]", 1), F.lit(""))
    rows = lines.filter(F.col("l")[1].contains("-->"))
    idx = F.row_number().over(Window.partitionBy("track").orderBy("k")) - 1
    return rows.select(
        "track", idx.alias("seg_idx"), T.parse_timecode(times[0]).alias("start_ms"), T.parse_timecode(times[1]).alias("end_ms"),
        F.trim(F.regexp_replace(body, r"^\[SPEAKER_\d+\]\s*", "")).alias(text_key), speaker.alias("speaker"),
    )


def _cues(files: DataFrame, timeline: str) -> DataFrame:
    """track, cue, start_ms, end_ms, lines: each line below a time range, up to the next one; cue numbers are left out."""
    lines = files.select("track", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    w = Window.partitionBy("track").orderBy("n")
    is_time = F.col("line").rlike(timeline)
    lines = lines.withColumn("t", is_time).withColumn("next", F.coalesce(F.lead("t").over(w), F.lit(False)))
    lines = lines.withColumn("cue", F.sum(F.col("t").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.col("next") & F.col("line").rlike(r"^\s*\d+\s*$")
    kept = lines.filter("cue > 0").filter(~number)
    text = F.transform(F.array_sort(F.collect_list(F.when(~F.col("t"), F.struct("n", "line")))), lambda x: x["line"])
    out = kept.groupBy("track", "cue").agg(F.max(F.when(F.col("t"), F.col("line"))).alias("range"), text.alias("lines"))
    a = F.regexp_extract("range", timeline, 1)
    b = F.regexp_extract("range", timeline, 2)
    return out.select("track", "cue", T.parse_timecode(a).alias("start_ms"), T.parse_timecode(b).alias("end_ms"), "lines")


_SRT_RANGE = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})"
_VTT_RANGE = r"(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})"


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("track").orderBy("cue")) - 1)


def parse_srt_tolerant(files: DataFrame) -> DataFrame:
    """Cues with or without numbers, either mark before ms; tags and control characters out, blanks squeezed."""
    rows = _cues(files, _SRT_RANGE)
    clean = F.regexp_replace(F.array_join("lines", " "), "[\\x00-\\x08\\x0b-\\x1f\\x7f​-‏ -‮﻿]", "")
    rows = rows.withColumn("text", T.strip_markup(clean)).filter("text <> ''")
    return _numbered(rows, "cue_idx").select("track", "cue_idx", "start_ms", "end_ms", "text")


def parse_vtt_segments(files: DataFrame) -> DataFrame:
    rows = _cues(files, _VTT_RANGE).withColumn("text", T.strip_markup(F.array_join("lines", " ")))
    rows = rows.filter("text <> ''").filter(~F.col("text").rlike(_NOISE))
    return _numbered(rows, "seg_idx").select("track", "seg_idx", "start_ms", "end_ms", "text")


def parse_vtt_words(files: DataFrame, dedup: str = "exact") -> DataFrame:
    """Words with inline times; words of a cue without them are spread evenly over it. dedup: exact, or none."""
    from ..operators.segmentation import dedup_rolling_words
    from ..operators.timeline import word_end_times

    rows = _cues(files, _VTT_RANGE).withColumn("t", T.strip_inline_noise(F.array_join("lines", " ")))
    rows = rows.withColumn("plain", ~F.col("t").rlike(r"<\d{2}:\d{2}:\d{2}\.\d{3}>"))
    parts = F.split(F.regexp_replace("t", r"</?c[^>]*>", ""), r"(?=<\d{2}:\d{2}:\d{2}\.\d{3}>)")
    timed = rows.select("track", "cue", "start_ms", "end_ms", "plain", F.posexplode(parts).alias("p", "part"))
    mark = F.nullif(F.regexp_extract("part", r"^<(\d{2}:\d{2}:\d{2}\.\d{3})>", 1), F.lit(""))
    at = F.when(mark.isNotNull(), T.parse_timecode(mark)).otherwise(F.col("start_ms"))
    words = timed.withColumn("at", at).withColumn("w", T.tokens(T.strip_markup(F.col("part"))))
    n = F.size("w")
    words = words.select("track", "cue", "p", "plain", "start_ms", "end_ms", "at", n.alias("n"), F.posexplode("w").alias("k", "text"))
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(100))
    start = F.when(F.col("plain"), F.col("start_ms") + F.floor(span * F.col("k") / F.col("n"))).otherwise(F.col("at")).cast("bigint")
    idx = F.row_number().over(Window.partitionBy("track").orderBy("cue", "p", "k")) - 1
    out = words.select(F.col("track").alias("track_id"), idx.alias("word_idx"), "text", start.alias("start_ms"), "plain")
    if dedup == "exact":
        out = dedup_rolling_words(out)
    return word_end_times(out.withColumn("end_ms", F.lit(None).cast("bigint"))).drop("plain").withColumnRenamed("track_id", "track")


def read_srt_corpus(spark: SparkSession, paths: str | list[str], text_key: str = "text") -> DataFrame:
    return parse_srt(_files(spark, paths), text_key)


def read_srt_tolerant(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_srt_tolerant(_files(spark, paths))


def read_vtt_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_vtt_segments(_files(spark, paths))


def read_vtt_words(spark: SparkSession, paths: str | list[str], dedup: str = "exact") -> DataFrame:
    return parse_vtt_words(_files(spark, paths), dedup)


def words_from_segments(segments: DataFrame) -> DataFrame:
    """Nested words where a segment has them, else its tokens, each with the whole segment's span; blank ones left out."""
    span = F.transform(T.tokens(F.col("text")), lambda w: F.struct(w.alias("text"), F.col("start_ms").alias("start_ms"), F.col("end_ms").alias("end_ms")))
    nested = F.when(F.size("words") > 0, F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms")))) if "words" in segments.columns else F.lit(None)
    rows = segments.select("track_id", "seg_idx", F.posexplode(F.coalesce(nested, span) if "words" in segments.columns else span).alias("pos", "w"))
    rows = rows.select("track_id", "seg_idx", "pos", T.normalize_word(F.col("w.text")).alias("text"), "w.start_ms", "w.end_ms").filter("text <> ''")
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx", "pos")) - 1
    return rows.select("track_id", idx.alias("word_idx"), "text", "start_ms", "end_ms", F.lit("imported").alias("source"))


def read_plain_transcript(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Pasted text as sentences: time stamps and noise out, cut after . ! ? but not behind abbreviations; text of more
    than forty words that nothing cuts comes in chunks of twenty. df: track_id and the text."""
    clean = F.regexp_replace(F.regexp_replace(text_col, r"(?<!\w)\d{1,2}:\d{2}(:\d{2})?(?!\w)", " "), r"(?i)\[[a-z ]+\]|♪", " ")
    words = df.select("track_id", F.posexplode(T.tokens(clean)).alias("pos", "w"))
    ends = F.col("w").rlike(r"[.!?]$") & ~F.lower("w").isin(T.ABBREVIATIONS)
    before = Window.partitionBy("track_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("track_id")
    rows = words.withColumn("e", ends.cast("int")).withColumn("run", F.coalesce(F.sum("e").over(before), F.lit(0)))
    inner = F.max(F.when(F.col("run") > 0, 1).otherwise(0)).over(whole)
    plain = (inner == 0) & (F.max("e").over(whole) == 0) & (F.count("*").over(whole) > 40)
    rows = rows.withColumn("cut", F.when(plain, F.floor(F.col("pos") / 20)).otherwise(F.col("run")))
    items = F.array_sort(F.collect_list(F.struct("pos", "w")))
    out = rows.groupBy("track_id", "cut").agg(F.array_join(F.transform(items, lambda x: x["w"]), " ").alias("text"))
    return out.select("track_id", (F.row_number().over(Window.partitionBy("track_id").orderBy("cut")) - 1).alias("sent_idx"), "text")


GLOSSARY = "canonical string, aliases array<string>, source_spelling string, target_spelling string, action string, pronunciation string"


def parse_glossary(files: DataFrame) -> DataFrame:
    """files: value, a JSON array of terms. Terms with defaults; malformed entries are left out."""
    rows = files.select(F.posexplode(F.from_json("value", f"array<struct<{GLOSSARY.replace(' ', ':').replace(',:', ',')}>>")).alias("ord", "t"))
    rows = rows.select("ord", "t.*").filter(F.coalesce("canonical", F.lit("")) != "")
    return rows.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "action": F.coalesce(T.first_nonempty("action"), F.lit("keep"))} | {c: F.coalesce(c, F.lit("")) for c in ("source_spelling", "target_spelling", "pronunciation")})


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return parse_glossary(spark.read.text(path, wholetext=True))


def parse_pronunciation(files: DataFrame) -> DataFrame:
    """files: value, a flat JSON object. src, dst; keys that begin with _ and values that are no strings are left out."""
    rows = files.select(F.parse_json("value").alias("v"))
    pairs = rows.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("v").outer()))
    strings = pairs.filter((F.schema_of_variant("value") == "STRING") & ~F.col("key").startswith("_"))
    return strings.select(F.col("key").alias("src"), F.variant_get("value", "$", "string").alias("dst"))


def read_pronunciation(spark: SparkSession, path: str) -> DataFrame:
    return parse_pronunciation(spark.read.text(path, wholetext=True))


PAYLOAD = "source_url string, target_language string, tts_engine string, step_times map<string,double>"


def parse_job_store(rows: DataFrame, payload: str = PAYLOAD) -> DataFrame:
    """Job rows with their JSON payload parsed and states made good."""
    from ..operators.tables import recover_states

    return recover_states(rows.withColumn("payload", F.from_json("payload", payload)))


def read_job_store(spark: SparkSession, path: str, payload: str = PAYLOAD) -> DataFrame:
    return parse_job_store(spark.read.parquet(path), payload)


def write_job_store(jobs: DataFrame, path: str) -> None:
    jobs.withColumn("payload", F.to_json("payload")).write.mode("overwrite").parquet(path)


def create_job_store(jobs: DataFrame, root: str, buckets: int = 64) -> None:
    """A store of jobs (id, state, payload, created_at, updated_at, and more) that save_jobs keeps up to date."""
    create_store(jobs.withColumn("payload", F.to_json("payload")), root, ["id"], buckets)


def save_jobs(jobs: DataFrame, root: str) -> int:
    """Insert or overwrite jobs by id, the latest updated_at winning; created_at stays. Only the buckets that these ids are in
    are written, and a failed write leaves the store as it was. Returns how many were."""
    return upsert_store(jobs.withColumn("payload", F.to_json("payload")), root, ["id"], "updated_at", "created_at")


def load_jobs(spark: SparkSession, root: str, payload: str = PAYLOAD) -> DataFrame:
    """The stored jobs with their payload parsed and states made good."""
    return parse_job_store(read_store(spark, root), payload)


# Sinks ---------------------------------------------------------------------------------------------------------------


def _numbered_text(segments: DataFrame, start: Column, end: Column, text: Column, style: str, head: str = "") -> DataFrame:
    """track_id, srt: the numbered cues of a track in one text."""
    rows = segments.filter(F.trim(text) != "").withColumn("_n", F.row_number().over(Window.partitionBy("track_id").orderBy(start, "seg_idx")))
    cue = F.concat(F.col("_n").cast("string"), F.lit("\n"), T.format_timecode(start, style), F.lit(" --> "), T.format_timecode(end, style), F.lit("\n"), text, F.lit("\n"))
    rows = rows.withColumn("_c", F.struct("_n", cue.alias("c")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_c")), lambda x: x["c"]), "\n")
    return rows.groupBy("track_id").agg(F.concat(F.lit(head), body).alias("srt"))


def srt_text(segments: DataFrame, text_key: str = "text", include_speaker: bool = False) -> DataFrame:
    text = F.trim(text_key)
    if include_speaker:
        text = F.concat(F.coalesce(F.concat(F.lit("["), F.nullif("speaker", F.lit("")), F.lit("] ")), F.lit("")), text)
    return _numbered_text(segments, F.col("start_ms"), F.col("end_ms"), F.when(F.trim(text_key) != "", text), "srt")


def exported_srt(cues: DataFrame, text_key: str = "text_hi_display", use_revised_timeline: bool = False) -> DataFrame:
    """The key's text, else the fitted, else the raw one; the revised times where both are set and wanted."""
    layers = [c for c in (text_key, "text_fit", "text_hi_raw") if c in cues.columns]
    revised = F.lit(use_revised_timeline) & F.col("new_start_ms").isNotNull() & F.col("new_end_ms").isNotNull() if "new_start_ms" in cues.columns else F.lit(False)
    start = F.when(revised, F.floor("new_start_ms")).otherwise(F.col("start_ms")) if "new_start_ms" in cues.columns else F.col("start_ms")
    end = F.when(revised, F.floor("new_end_ms")).otherwise(F.col("end_ms")) if "new_start_ms" in cues.columns else F.col("end_ms")
    return _numbered_text(cues, start, end, T.first_nonempty(*layers), "srt")


def webvtt_text(segments: DataFrame, text_key: str = "text") -> DataFrame:
    return _numbered_text(segments, F.col("start_ms"), F.col("end_ms"), F.trim(text_key), "vtt", "WEBVTT\n\n")


def _write_text(texts: DataFrame, path: str) -> None:
    texts.select("track_id", F.col("srt").alias("value")).write.mode("overwrite").partitionBy("track_id").text(path)


def write_srt(segments: DataFrame, path: str, text_key: str = "text", include_speaker: bool = False) -> None:
    _write_text(srt_text(segments, text_key, include_speaker), path)


def export_srt(cues: DataFrame, path: str, text_key: str = "text_hi_display", use_revised_timeline: bool = False) -> None:
    _write_text(exported_srt(cues, text_key, use_revised_timeline), path)


def write_webvtt(segments: DataFrame, path: str) -> None:
    _write_text(webvtt_text(segments), path)


def tts_rows(cues: DataFrame) -> DataFrame:
    """track_id, speaker (S1 by default), start_time and end_time in seconds, transcription, translation."""
    layers = [c for c in ("text_fit", "text_hi_raw", "text_translated") if c in cues.columns]
    return cues.select(
        "track_id", F.coalesce(T.first_nonempty("speaker"), F.lit("S1")).alias("speaker"), T.seconds(F.col("start_ms")).alias("start_time"),
        T.seconds(F.col("end_ms")).alias("end_time"), F.coalesce("text", F.lit("")).alias("transcription"), F.coalesce(T.first_nonempty(*layers), F.lit("")).alias("translation"),
    )


def export_tts_csv(cues: DataFrame, path: str) -> None:
    tts_rows(cues).write.mode("overwrite").csv(path, header=True, escape='"')


def cue_json(cues: DataFrame) -> DataFrame:
    return cues.select("track_id", "seg_idx", F.to_json(F.struct(*cues.columns)).alias("json"))


def export_cues_json(cues: DataFrame, path: str) -> None:
    cues.write.mode("overwrite").json(path)


def export_tts_segments(cues: DataFrame) -> DataFrame:
    """The times to speak at (revised where set), the original ones, texts, flags and speeds."""
    have = lambda c, d: F.col(c) if c in cues.columns else d
    return cues.select(
        "track_id", "seg_idx", F.coalesce(have("new_start_ms", F.lit(None)), "start_ms").cast("bigint").alias("start_ms"), F.coalesce(have("new_end_ms", F.lit(None)), "end_ms").cast("bigint").alias("end_ms"),
        F.col("start_ms").alias("original_start_ms"), F.col("end_ms").alias("original_end_ms"), "text", have("text_translated", F.lit("")).alias("text_translated"),
        F.coalesce(F.array_join(have("qc_flags", F.array().cast("array<string>")), ","), F.lit("")).alias("qc_flags"), have("audio_speedup", F.lit(1.0)).alias("audio_speedup"), have("video_speed", F.lit(1.0)).alias("video_speed"),
    )


def slot_fit_report_rows(cues: DataFrame) -> DataFrame:
    return cues.select(
        "track_id", F.col("seg_idx").alias("id"), F.col("start_ms").alias("original_start_ms"), F.col("end_ms").alias("original_end_ms"), "tts_ms", "audio_speedup",
        T.count_words(F.col("text")).alias("word_count"), "new_start_ms", "new_end_ms", "video_speed", "drift_ms", "status",
    )


# Stages --------------------------------------------------------------------------------------------------------------


def write_stage(df: DataFrame, root: str, stage: str, buckets: int = 64) -> None:
    """Rows of the stage's tracks, replacing those that are there. Tracks share a bounded number of folders, by a hash; only
    those that df's tracks are in are written anew, and count once all are complete."""
    replace_in_store(df, f"{root}/stage={stage}", ["track_id"], buckets)


def read_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return read_store(spark, f"{root}/stage={stage}")


def pending_tracks(every: DataFrame, done: DataFrame, stage: str = "transcribe") -> DataFrame:
    """Tracks without usable rows of the stage: any row, for translate any translated one."""
    good = done.filter(F.col("text_translated") != "") if stage == "translate" else done
    return every.select("track_id").distinct().join(good.select("track_id"), "track_id", "left_anti")
