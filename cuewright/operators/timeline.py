"""Window and timeline operators. Times are whole milliseconds; one shuffle by track where rows depend on neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scans import Scan, in_order

SLOWEST, FASTEST = 1 / 1.1, 1.25


def track(order: str = "seg_idx"):
    return Window.partitionBy("track_id").orderBy(order)


def running_before(c: Column, order: str = "seg_idx") -> Column:
    """Sum over the rows before this one; 0 for the first."""
    return F.coalesce(F.sum(c).over(track(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def word_end_times(words: DataFrame) -> DataFrame:
    """end = the next start; the last ends 0.5 s after its start; ends not after starts become start + 0.1 s."""
    end = F.coalesce(F.lead("start_ms").over(track("word_idx")), F.col("start_ms") + 500)
    return words.withColumn("end_ms", F.when(end <= F.col("start_ms"), F.col("start_ms") + 100).otherwise(end))


def gap_before(words: DataFrame, order: str = "word_idx", soft: int = 300, strong: int = 500) -> DataFrame:
    """Adds gap_ms (null for the first) and pause: strong, soft or none."""
    gap = F.col("start_ms") - F.lag("end_ms").over(track(order))
    return words.withColumn("gap_ms", gap).withColumn("pause", F.when(F.col("gap_ms") > strong, "strong").when(F.col("gap_ms") > soft, "soft").otherwise("none"))


def speed_fit(clips: DataFrame, lo: float = SLOWEST, hi: float = FASTEST, audio_priority: bool = False) -> DataFrame:
    """Adds ratio and new_ms: clips within 5 % of the slot, or with a side below 0.1 s, keep their duration."""
    ratio = F.col("tts_ms") / F.col("slot_ms")
    same = (F.col("slot_ms") < 100) | (F.col("tts_ms") < 100) | F.lit(audio_priority)
    near = (ratio >= 0.95) & (ratio <= 1.05)
    fit = F.when(same, 1.0).when(near, 1.0).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), ratio)))
    return clips.withColumn("ratio", F.round(fit, 4)).withColumn("new_ms", F.round(F.col("tts_ms") / fit).cast("bigint"))


def _sections(clips: DataFrame, durations: DataFrame, pos: Column, factor: Column, freeze: Column, out_ms: Column) -> DataFrame:
    """Alternating gap and speech rows, and a last gap up to the track's duration."""
    rows = clips.withColumn("_pos", pos)
    gap = F.when(
        F.col("start_ms") > F.col("_pos") + 50,
        F.struct(F.lit("gap").alias("type"), F.col("_pos").alias("a"), F.col("start_ms").alias("b"), F.lit(1.0).alias("f"), F.lit(False).alias("z"), (F.col("start_ms") - F.col("_pos")).alias("o")),
    )
    speech = F.struct(F.lit("speech").alias("type"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), factor.alias("f"), freeze.alias("z"), out_ms.alias("o"))
    made = rows.select("track_id", "seg_idx", F.posexplode(F.array_compact(F.array(gap, speech))).alias("k", "s"))
    end = clips.groupBy("track_id").agg(F.max("end_ms").alias("e"), F.max("seg_idx").alias("seg_idx"))
    tail = end.join(durations.select("track_id", "duration_ms"), "track_id").filter(F.col("duration_ms") > F.col("e") + 50)
    span = F.struct(F.lit("gap").alias("type"), F.col("e").alias("a"), F.col("duration_ms").alias("b"), F.lit(1.0).alias("f"), F.lit(False).alias("z"), (F.col("duration_ms") - F.col("e")).alias("o"))
    made = made.unionByName(tail.select("track_id", "seg_idx", F.lit(9).alias("k"), span.alias("s")))
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx", "k")) - 1
    names = {"type": "type", "a": "video_start_ms", "b": "video_end_ms", "f": "pts_factor", "z": "freeze", "o": "output_ms"}
    return made.select("track_id", idx.alias("sec_idx"), *(F.col(f"s.{k}").alias(n) for k, n in names.items()))


def sections_adaptive(clips: DataFrame, durations: DataFrame, slow_max: float = 1.1) -> DataFrame:
    """Video slows down to slow_max, then freezes for the rest of the clip; gaps start at the latest end so far."""
    slot, clip = F.col("end_ms") - F.col("start_ms"), F.col("tts_ms")
    ratio = clip / F.greatest(slot, F.lit(1))
    pos = F.coalesce(F.max("end_ms").over(track().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    factor = F.round(F.when(ratio <= 1, 1.0).when(ratio <= slow_max, ratio).otherwise(F.lit(slow_max)), 4)
    return _sections(clips, durations, pos, factor, ratio > slow_max, F.when(ratio <= 1, slot).otherwise(clip))


def sections_synced(clips: DataFrame, durations: DataFrame, lo: float = SLOWEST, hi: float = FASTEST) -> DataFrame:
    """As above, but the factor is clip over slot within bounds and gaps start at the last end."""
    slot, clip = F.col("end_ms") - F.col("start_ms"), F.col("tts_ms")
    factor = F.greatest(F.lit(lo), F.least(F.lit(hi), clip / F.greatest(slot, F.lit(1))))
    pos = F.coalesce(F.lag("end_ms").over(track()), F.lit(0))
    return _sections(clips, durations, pos, F.round(factor, 4), F.lit(False), F.round(slot * factor).cast("bigint"))


def clip_overlaps(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Starts moved to the end before, ends cut at the track's duration."""
    rows = segments.join(durations.select("track_id", "duration_ms"), "track_id")
    end = F.least("end_ms", "duration_ms")
    before = F.lag(end).over(track())
    return rows.withColumn("_s", F.greatest("start_ms", F.coalesce(before, F.col("start_ms")))).withColumn("end_ms", end).withColumn("start_ms", F.col("_s")).drop("_s", "duration_ms")


def timeline_overlap_profile(clips: DataFrame) -> DataFrame:
    """track_id, from_ms, to_ms, concurrency: how many clips sound in each stretch between two boundaries."""
    edges = clips.select("track_id", F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    points = edges.groupBy("track_id", F.col("e.t").alias("from_ms")).agg(F.sum("e.d").alias("d"))
    w = track("from_ms")
    level = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return points.select("track_id", "from_ms", F.lead("from_ms").over(w).alias("to_ms"), level.alias("concurrency")).filter("to_ms is not null")


def zero_gap_timeline(clips: DataFrame, gap_ms: int = 0, hot_rows: int | None = None) -> DataFrame:
    """Adds out_start_ms and out_end_ms: clips back to back with a fixed gap. Tracks of more than hot_rows clips are spread over
    tasks."""
    rows = in_order(clips, "seg_idx", hot_rows=hot_rows).scan(out_start_ms=Scan("sum_before", F.col("tts_ms") + gap_ms)).done()
    return rows.withColumn("out_end_ms", F.col("out_start_ms") + F.col("tts_ms"))


def stretch_plan(pairs: DataFrame, max_stretch: float = 20.0, slow_only: bool = False) -> DataFrame:
    """pairs: audio_ms, video_ms. Adds regime (invalid, copy, trim, stretch, stretch_freeze), factor, freeze_ms."""
    most = min(20.0, max(1.0, max_stretch))
    ratio = F.col("audio_ms") / F.when(F.col("video_ms") > 0, F.col("video_ms"))
    bad = F.coalesce((F.col("audio_ms") <= 0) | (F.col("video_ms") <= 0), F.lit(True))
    copy, trim = F.abs(ratio - 1) < 0.01, ratio < 1
    regime = F.when(bad, "invalid").when(copy, "copy").when(trim, "copy" if slow_only else "trim").when(ratio <= most, "stretch").otherwise("stretch_freeze")
    factor = F.when(bad | copy | trim, 1.0).otherwise(F.round(F.least(ratio, F.lit(most)), 4))
    freeze = F.when(~bad & (ratio > most), F.round(F.col("audio_ms") - F.col("video_ms") * most)).otherwise(0).cast("bigint")
    return pairs.withColumns({"regime": regime, "factor": factor, "freeze_ms": freeze})


def classify_drift(d: Column, warn: float = 50, fail: float = 200) -> Column:
    lo, hi = min(warn, fail), max(warn, fail)
    return F.when(F.abs(d) < lo, "ok").when(F.abs(d) < hi, "warn").otherwise("fail")


def recompute_slots(cues: DataFrame, mode: str = "capped", max_speedup: float = 1.30, min_video_speed: float = 0.70, warn: int = 50, fail: int = 200, hot_rows: int | None = None) -> DataFrame:
    """New slots for clips that overflow their track. cues: track_id, seg_idx, start_ms, end_ms, tts_ms, qc_flags.

    original: nothing moves. capped: clips longer than their slot are sped up, at most max_speedup. audio_first: clips
    stay. If a track's clips exceed its slots by more than 10 ms every slot becomes its clip's duration, which is where
    proportional widening and shrinking ends up; else the timeline stays. Adds audio_speedup, new_start_ms, new_end_ms,
    video_speed, drift_ms, status, and flags for slots without duration or below the least video speed. Tracks of more than
    hot_rows cues are spread over tasks.
    """
    if mode not in ("original", "capped", "audio_first"):
        raise ValueError(f"unknown mode {mode!r}")
    slot, own = F.col("end_ms") - F.col("start_ms"), F.coalesce("tts_ms", F.col("end_ms") - F.col("start_ms"))
    mine = lambda f: f.startswith("video_speed_below_floor") | f.startswith("zero_duration_cue_expanded") | f.startswith("auto_padded") | f.startswith("auto_stretch") | (f == "needs_resegmentation")
    flags = F.filter(F.coalesce("qc_flags", F.array().cast("array<string>")), lambda f: ~mine(f))
    rows = cues.withColumn("qc_flags", flags).withColumn("tts_ms", own.cast("double")).withColumn("_slot", slot.cast("double"))
    if mode == "original":
        return rows.withColumns({"audio_speedup": F.lit(1.0), "new_start_ms": F.col("start_ms").cast("double"), "new_end_ms": F.col("end_ms").cast("double"), "video_speed": F.lit(1.0), "drift_ms": F.lit(0.0), "status": F.lit("ok")}).drop("_slot")
    over = (F.col("tts_ms") > F.col("_slot")) & (F.col("_slot") > 0) & F.lit(mode == "capped")
    rows = rows.withColumn("audio_speedup", F.when(over, F.round(F.least(F.col("tts_ms") / F.col("_slot"), F.lit(max_speedup)), 4)).otherwise(1.0))
    rows = rows.withColumn("tts_ms", F.round(F.col("tts_ms") / F.col("audio_speedup"), 1))
    at = in_order(rows, "seg_idx", hot_rows=hot_rows)
    at = at.scan(_told=Scan("sum_all", F.col("tts_ms")), _slots=Scan("sum_all", F.col("_slot")), _before=Scan("lag", F.col("end_ms")), _first=Scan("first", F.col("start_ms")))
    moves = F.col("_told") - F.col("_slots") > 10
    gap = F.greatest(F.coalesce(F.col("start_ms") - F.col("_before"), F.lit(0)), F.lit(0))
    at = at.with_columns(_moves=moves, _gap=gap, _new=F.when(moves, F.col("tts_ms")).otherwise(F.col("_slot")))
    rows = at.scan(_shift=Scan("sum_before", F.col("_new")), _gaps=Scan("sum_through", F.col("_gap"))).done()
    start = F.col("_first") + F.col("_shift") + F.col("_gaps")
    moved = F.round(F.when(F.col("_moves"), start).otherwise(F.col("start_ms").cast("double")), 1)
    rows = rows.withColumn("new_start_ms", moved).withColumn("new_end_ms", F.round(F.col("new_start_ms") + F.col("_new"), 1))
    raw = F.round(F.col("_slot") / F.when(F.col("_new") > 0, F.col("_new")), 4)
    low = F.col("_moves") & (F.col("_slot") > 0) & (raw < min_video_speed)
    zero = F.col("_moves") & (F.col("_slot") <= 0)
    mark = F.array_compact(F.array(F.when(zero, "zero_duration_cue_expanded"), F.when(low, F.concat(F.lit("video_speed_below_floor:"), F.format_string("%.2f", raw), F.lit(f"<{min_video_speed:.2f}")))))
    speed = F.when(~F.col("_moves") | zero, 1.0).otherwise(F.greatest(raw, F.lit(min_video_speed)))
    rows = rows.withColumns({"video_speed": speed, "qc_flags": F.concat("qc_flags", mark), "drift_ms": F.round(F.col("_new") - F.col("tts_ms"), 1)})
    return rows.withColumn("status", classify_drift(F.col("drift_ms"), warn, fail)).drop("_slot", "_moves", "_new", "_gap", "_told", "_slots", "_before", "_first", "_shift", "_gaps")


def auto_fix(cues: DataFrame) -> DataFrame:
    """warn and early: padded, drift 0; warn and late: the stretch to apply; fail: to be cut anew."""
    d, status = F.col("drift_ms"), F.col("status")
    pad, stretch = (status == "warn") & (d >= 0), (status == "warn") & (d < 0)
    ratio = F.round((F.col("new_end_ms") - F.col("new_start_ms")) / F.when(F.col("tts_ms") > 0, F.col("tts_ms")), 4)
    flag = F.when(pad, F.concat(F.lit("auto_padded:"), F.round(d).cast("bigint").cast("string"), F.lit("ms"))).when(stretch, F.concat(F.lit("auto_stretch:"), F.format_string("%.4f", ratio))).when(status == "fail", "needs_resegmentation")
    flags = F.when(flag.isNotNull(), F.array_append(F.coalesce("qc_flags", F.array().cast("array<string>")), flag)).otherwise(F.col("qc_flags"))
    return cues.withColumns({"qc_flags": flags, "drift_ms": F.when(pad, 0.0).otherwise(d), "status": F.when(pad | stretch, "ok").otherwise(status)})


def assign_voices(speakers: DataFrame, pools: Mapping[str, Sequence[str]]) -> DataFrame:
    """speakers: track_id, speaker, voice_class. Adds voice: round robin in the class's pool, speakers in order."""
    pool = F.create_map(*[x for k, v in pools.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    n = F.row_number().over(Window.partitionBy("track_id", "voice_class").orderBy("speaker"))
    rows = speakers.withColumn("_p", pool[F.col("voice_class")]).withColumn("_n", n)
    return rows.withColumn("voice", F.try_element_at("_p", ((F.col("_n") - 1) % F.size("_p") + 1).cast("int"))).drop("_p", "_n")


def micro_batches(df: DataFrame, size: int = 50, engines: Sequence[str] = ()) -> DataFrame:
    """Adds batch (by place in the track) and engine (round robin by batch)."""
    out = df.withColumn("batch", F.floor((F.row_number().over(track()) - 1) / size).cast("int"))
    if not engines:
        return out
    return out.withColumn("engine", F.element_at(F.array(*map(F.lit, engines)), (F.col("batch") % len(engines) + 1).cast("int")))


def split_tracks(durations: DataFrame, minutes: int = 30) -> DataFrame:
    """track_id, part, start_ms, end_ms: parts of at most so many minutes; one part for 0 minutes or short tracks."""
    length = F.lit(minutes * 60_000) if minutes > 0 else F.greatest("duration_ms", F.lit(1))
    n = F.greatest(F.ceil(F.col("duration_ms") / length).cast("int"), F.lit(1))
    parts = durations.select("track_id", "duration_ms", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    start = (F.col("part") * length).cast("bigint")
    return parts.select("track_id", "part", start.alias("start_ms"), F.least(start + length, F.col("duration_ms")).cast("bigint").alias("end_ms"))


def offset_chunks(segments: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Times within chunks (column chunk) become times of the track; seg_idx is renumbered by chunk and time."""
    moved = segments.withColumns({c: F.col(c) + F.col("chunk") * chunk_ms for c in ("start_ms", "end_ms")})
    return moved.withColumn("seg_idx", F.row_number().over(Window.partitionBy("track_id").orderBy("chunk", "start_ms", "seg_idx")) - 1)


def speech_intervals(silence_events: DataFrame, durations: DataFrame) -> DataFrame:
    """The complement of silence: a start closes speech, an end opens it; speech is on at 0."""
    before = F.coalesce(F.lag("t_ms").over(track("ord")), F.lit(0))
    kind_before = F.coalesce(F.lag("kind").over(track("ord")), F.lit("end"))
    rows = silence_events.withColumns({"a": before, "k": kind_before}).filter((F.col("kind") == "start") & (F.col("k") == "end") & (F.col("t_ms") > F.col("a")))
    closed = rows.select("track_id", F.col("a").alias("start_ms"), F.col("t_ms").alias("end_ms"))
    last = silence_events.groupBy("track_id").agg(F.max_by("kind", "ord").alias("kind"), F.max("t_ms").alias("t_ms"))
    tail = durations.join(last, "track_id", "left").filter(F.coalesce("kind", F.lit("end")) == "end")
    tail = tail.select("track_id", F.coalesce("t_ms", F.lit(0)).alias("start_ms"), F.col("duration_ms").alias("end_ms")).filter("end_ms > start_ms")
    return closed.unionByName(tail)


def pick_window(intervals: DataFrame, skip_ms: int = 20_000, min_ms: int = 4_000, target_ms: int = 10_000) -> DataFrame:
    """By track: the first long enough stretch of speech behind skip_ms, else from the start, else the naive slice."""
    def tried(skip: int, k: int) -> Column:
        a = F.greatest("start_ms", F.lit(skip))
        return F.when(F.col("end_ms") - a >= min_ms, F.struct(F.lit(k).alias("k"), a.alias("start_ms"), F.least(F.col("end_ms") - a, F.lit(target_ms)).alias("length_ms")))

    naive = F.struct(F.lit(2).alias("k"), F.lit(skip_ms).cast("bigint").alias("start_ms"), F.lit(target_ms).cast("bigint").alias("length_ms"))
    best = intervals.groupBy("track_id").agg(F.min(F.least(tried(skip_ms, 0), tried(0, 1))).alias("s"))
    s = F.coalesce("s", naive)
    return best.select("track_id", s["start_ms"].alias("start_ms"), s["length_ms"].alias("length_ms"))


def representative_segments(segments: DataFrame, budget_ms: int = 15_000, min_ms: int = 500) -> DataFrame:
    """By speaker in time order, without short ones, until their total has reached the budget."""
    w = Window.partitionBy("track_id", "speaker").orderBy("start_ms", "seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    d = F.col("end_ms") - F.col("start_ms")
    return segments.filter(d >= min_ms).withColumn("_b", F.coalesce(F.sum(d).over(w), F.lit(0))).filter(F.col("_b") < budget_ms).drop("_b")


def redistribute_slots(sentences: DataFrame, per_group: int = 2) -> DataFrame:
    """Groups of sentences share their joint span by words. sentences: track_id, sent_idx, text, start_ms, end_ms."""
    n = T.count_words(F.col("text"))
    g = Window.partitionBy("track_id", "_g")
    rows = sentences.withColumn("_g", F.floor(F.col("sent_idx") / per_group)).withColumn("_n", F.greatest(n, F.lit(1)))
    before = F.coalesce(F.sum("_n").over(g.orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_a": F.min("start_ms").over(g), "_e": F.max("end_ms").over(g), "_all": F.sum("_n").over(g), "_before": before})
    span = F.col("_e") - F.col("_a")
    at = lambda words: (F.col("_a") + F.floor(span * words / F.col("_all"))).cast("bigint")
    return rows.withColumn("start_ms", at(F.col("_before"))).withColumn("end_ms", at(F.col("_before") + F.col("_n"))).drop("_g", "_n", "_a", "_e", "_all", "_before")


def even_word_spread(cues: DataFrame) -> DataFrame:
    """Words of a cue spread evenly over at least 0.1 s; starts and ends are cut to whole ms."""
    t = T.tokens(F.col("text"))
    rows = cues.select("track_id", "seg_idx", "start_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(100)).alias("span"), F.size(t).alias("n"), F.posexplode(t).alias("pos", "word"))
    at = lambda k: (F.col("start_ms") + F.floor(F.col("span") * k / F.col("n"))).cast("bigint")
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx", "pos")) - 1
    return rows.select("track_id", idx.alias("word_idx"), "seg_idx", F.col("word").alias("text"), at(F.col("pos")).alias("start_ms"), at(F.col("pos") + 1).alias("end_ms"))


def fixed_word_chunks(words: DataFrame, n: int) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    return words.groupBy("track_id", F.floor(F.col("word_idx") / n).cast("bigint").alias("chunk")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text")
    )


def split_long_rows(rows: DataFrame, max_words: int = 8) -> DataFrame:
    """Pieces of equally many words, times by word share. rows: track_id, seg_idx, text, start_ms, end_ms."""
    t = T.tokens(F.col("text"))
    out = rows.withColumn("_t", t).withColumn("_n", F.size("_t")).filter("_n > 0")
    pieces = F.ceil(F.col("_n") / max_words).cast("int")
    out = out.withColumn("_size", F.ceil(F.col("_n") / pieces).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_size")).cast("int") - 1)))
    a = F.col("piece") * F.col("_size")
    b = F.least(a + F.col("_size"), F.col("_n"))
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda k: (F.col("start_ms") + F.floor(span * k / F.col("_n"))).cast("bigint")
    return out.select("track_id", "seg_idx", "piece", F.array_join(F.slice("_t", a + 1, F.col("_size")), " ").alias("text"), at(a).alias("start_ms"), at(b).alias("end_ms"))
