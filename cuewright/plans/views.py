"""Timed-text tables derived from the stored ones, in Spark; view_sql.py has the same in SQL for the comparison."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import input_bytes

#: Bytes of texts in one partition of tracks. Where all their words are sorted or hashed they take some 500 MB.
TRACK_BYTES = 768 << 10
STEP_OF = {"view": "download", "click": "extract", "signup": "transcribe", "purchase": "translate", "error": "synthesize"}


def capitals(column: str):
    """a-z in capitals; other letters stay, as engines differ over them."""
    return F.translate(column, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def segments(self) -> DataFrame:
        rows = self.table("conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text")
        if input_bytes(rows) // TRACK_BYTES > 8:  # else Spark would deal tracks by the size of their texts, before words are made of them
            size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # stored bytes say little where texts repeat
            rows = rows.repartition(max(9, size // TRACK_BYTES), "track_id")
        rows = rows.withColumn("toks", T.tokens(F.col("text")))
        rows = rows.withColumns({"n": F.size("toks"), "gap_ms": 200 * ((F.col("track_id") + F.col("seg_idx")) % 5)}).withColumn("dur_ms", F.col("n").cast("bigint") * 400)
        before = Window.partitionBy("track_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("start_ms", F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(before), F.lit(0)))
        return rows.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))

    @cached_property
    def words(self) -> DataFrame:
        rows = self.segments.select("track_id", "seg_idx", "speaker", F.col("start_ms").alias("s"), F.posexplode("toks").alias("pos", "text"))
        start = F.col("s") + 400 * F.col("pos")
        idx = F.row_number().over(Window.partitionBy("track_id").orderBy("seg_idx", "pos")) - 1
        return rows.select("track_id", idx.alias("word_idx"), "seg_idx", "pos", "text", start.alias("start_ms"), (start + 350).alias("end_ms"), "speaker")

    @cached_property
    def words_alt(self) -> DataFrame:
        shift = 60 * (F.col("pos") % 4)
        rows = self.words.filter("word_idx % 11 <> 10")
        return rows.withColumns({"start_ms": F.col("start_ms") + shift, "end_ms": F.col("end_ms") + shift})

    @cached_property
    def clips(self) -> DataFrame:
        k = F.col("seg_idx") % 4
        tts = F.floor(F.col("dur_ms") * (70 + (31 * F.col("track_id") + 17 * F.col("seg_idx")) % 80) / 100).cast("bigint")
        return self.segments.select("track_id", "seg_idx", "start_ms", "end_ms", "text", "speaker", F.col("dur_ms").alias("slot_ms"), tts.alias("tts_ms"), k.alias("rerender_count"), (k == 3).alias("manual_review"), (k == 0).alias("qc_ok"))

    @cached_property
    def durations(self) -> DataFrame:
        return self.segments.groupBy("track_id").agg(F.max("end_ms").alias("duration_ms"))

    @cached_property
    def ref_segments(self) -> DataFrame:
        rows = self.segments.filter("seg_idx % 5 <> 4")
        return rows.select("track_id", F.col("seg_idx").alias("ref_idx"), (F.col("start_ms") + 300).alias("start_ms"), (F.col("end_ms") + 300).alias("end_ms"), "text")

    @cached_property
    def speaker_ranges(self) -> DataFrame:
        return self.segments.select("track_id", "speaker", F.greatest(F.col("start_ms") - 500, F.lit(0)).alias("start_ms"), (F.col("end_ms") - 500).alias("end_ms"))

    @cached_property
    def frame_texts(self) -> DataFrame:
        """One row a second: the token spoken then; a token holds until the next one starts."""
        until = F.coalesce(F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("word_idx")), F.col("end_ms"))
        rows = self.words.select("track_id", "text", F.ceil(F.col("start_ms") / 1000).alias("a"), (F.ceil(until / 1000) - 1).alias("b")).filter("a <= b")
        return rows.select("track_id", F.explode(F.sequence("a", "b")).alias("s"), "text").select("track_id", (F.col("s") * 1000).alias("ts_ms"), "text")

    @cached_property
    def silence_events(self) -> DataFrame:
        rows = self.segments.withColumn("next", F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("seg_idx"))).filter(F.col("next") - F.col("end_ms") >= 500)
        two = F.explode(F.array(F.struct((F.col("seg_idx") * 2).alias("ord"), F.lit("start").alias("kind"), F.col("end_ms").alias("t_ms")), F.struct((F.col("seg_idx") * 2 + 1).alias("ord"), F.lit("end").alias("kind"), F.col("next").alias("t_ms"))))
        return rows.select("track_id", two.alias("e")).select("track_id", "e.*")

    @cached_property
    def glossary(self) -> DataFrame:
        """The forty most frequent capitalised words of the benchmark."""
        words = self.table("benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).filter(F.col("w").rlike("^[A-Z][a-z]{2,}$"))
        top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(40)
        rows = top.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), "w")) - 1)  # forty rows
        none = F.array().cast("array<string>")
        return rows.select("ord", F.col("w").alias("canonical"), none.alias("aliases"), F.upper("w").alias("target_spelling"), F.when(F.col("ord") % 2 == 0, "keep").otherwise("fixed_translation").alias("action"), F.when(F.col("ord") % 3 == 0, F.lower("w")).otherwise("").alias("pronunciation"))

    @cached_property
    def translations(self) -> DataFrame:
        s = self.segments
        half = F.array_join(F.slice("toks", 1, F.floor(F.col("n") / 2).cast("int")), " ")
        e3 = F.when(F.col("seg_idx") % 7 == 0, "").otherwise(F.col("text"))
        rows = s.select("track_id", "seg_idx", F.explode(F.array(F.struct(F.lit("e1").alias("engine"), capitals("text").alias("text_translated")), F.struct(F.lit("e2").alias("engine"), half.alias("text_translated")), F.struct(F.lit("e3").alias("engine"), e3.alias("text_translated")))).alias("x"))
        return rows.select("track_id", "seg_idx", "x.*")

    @cached_property
    def cues(self) -> DataFrame:
        """Segments with the first engine's text and their clips' durations."""
        c = self.clips.select("track_id", "seg_idx", "tts_ms")
        return self.segments.drop("toks", "n", "gap_ms", "dur_ms").join(c, ["track_id", "seg_idx"]).withColumn("text_translated", capitals("text")).withColumn("qc_flags", F.array().cast("array<string>"))

    @staticmethod
    def _as_job_events(events: DataFrame) -> DataFrame:
        step = F.create_map(*[F.lit(x) for kv in STEP_OF.items() for x in kv])[F.col("event_type")]
        bad = (F.col("event_type") == "error") & (F.col("event_id") % 10 == 0)
        return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), step.alias("step"), ((F.col("event_id") % 101) / 100.0).alias("progress"), F.when(bad, "error").otherwise("running").alias("state"))

    @cached_property
    def job_events(self) -> DataFrame:
        return self._as_job_events(self.table("events"))

    @cached_property
    def job_event_stream(self) -> DataFrame:
        """The same as a stream of the table's files."""
        path = f"{self.sf_dir}/[e]vents.parquet"  # a pattern may stand for a file as for a folder
        return self._as_job_events(self.spark.readStream.schema(self.table("events").schema).parquet(path))

    @cached_property
    def provider_results(self) -> DataFrame:
        return self.table("events").select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("engine"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))

    @cached_property
    def usage(self) -> DataFrame:
        return self.table("events").select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("credential"), "ts", F.floor(F.col("value") * 1000).cast("bigint").alias("chars"))

    @cached_property
    def jobs(self) -> DataFrame:
        state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        return rows.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://video.example/"), (F.col("o_custkey") % 50).cast("string")).alias("source_url"), state.alias("state"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("target_language"), F.coalesce("c_mktsegment", F.lit("none")).alias("tts_engine"))

    @cached_property
    def job_segments(self) -> DataFrame:
        expected = (F.col("l_quantity") * 1000).cast("bigint")
        status = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "N", "error").otherwise("manual_review")
        return self.table("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("segment_idx"), expected.alias("expected_ms"), F.floor(expected * (1 + F.col("l_discount")) + 0.5).cast("bigint").alias("tts_ms"), status.alias("qc_status"), F.col("l_shipdate").alias("updated_at"), F.col("l_partkey").alias("part"))

    @cached_property
    def links(self) -> DataFrame:
        """Pages as links, each fifth twice, the second time with a preset."""
        p = self.table("pages")
        one = p.select(F.col("page_id").alias("id"), "url", F.col("page_id").alias("added_at"), F.lit(None).cast("string").alias("preset"))
        two = p.filter("page_id % 5 = 0").select((F.col("page_id") + 1_000_000_000).alias("id"), "url", (F.col("page_id") + 1_000_000_000).alias("added_at"), F.lit("again").alias("preset"))
        return one.unionByName(two)

    @cached_property
    def completed(self) -> DataFrame:
        return self.table("pages").filter("page_id % 3 = 0").select("url")

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").alias("samples"))
