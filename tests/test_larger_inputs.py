"""What showed on larger tables only: letters beside patterns, unions of partitioned tables, sizes of tasks."""

from __future__ import annotations

import random
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import aggregates as A
from cuewright.operators import joins as J
from cuewright.operators import segmentation as D
from cuewright.operators import tables as U
from cuewright.operators import udfs
from cuewright.plans import views
from cuewright.sources import subtitles as S
from cuewright.streaming import jobs


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_patterns_end_beside_letters_with_marks(spark):
    texts = ["x", "Etierêaux,", "éRank", "éThe", "Catsé", "etier"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "track_id long, word_idx long, text string")
    assert sorted(map(tuple, A.extract_glossary(rows).collect())) == [(1, "Etier", "rank"), (1, "The Cats", "phrase"), (1, "etier", "rank")]
    rows = spark.createDataFrame([(1, "é12:34é x")], "track_id long, text string")
    assert [r["text"] for r in S.read_plain_transcript(rows).collect()] == ["é é x"]


def test_unions_of_dealt_tables_are_dealt_by_key(spark):
    """Each side is dealt by track and merged by its size; a track's rows meet all the same."""
    rows = spark.range(40_000).select((F.col("id") % 400).alias("track_id"), F.floor(F.col("id") / 400).alias("k"), F.concat(*(F.sha2(F.concat(F.lit(s), F.col("id").cast("string")), 256) for s in "abcd")).alias("pad"))
    w = Window.partitionBy("track_id").orderBy("k")
    place = F.row_number().over(w)
    one = rows.withColumn("n", place).select("track_id", (2 * F.col("k")).alias("seg_idx"), F.concat(F.lit("x"), "n", F.lit("x")).alias("text"), F.col("k").alias("start_ms"), F.col("k").alias("end_ms"))
    two = rows.withColumn("n", place).select("track_id", (2 * F.col("k") + 1).alias("seg_idx"), F.concat(F.lit("x"), "n", F.lit("x"), "pad").alias("text"), F.col("k").alias("start_ms"), F.col("k").alias("end_ms"))
    both = one.unionByName(two)
    with settings(spark, {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        assert D.dedup_rolling_segments(both).count() == 40_000
        parts = U.sort_segments(both).select("track_id", F.spark_partition_id().alias("p")).distinct()
        assert parts.count() == 400


def test_tracks_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(views, "TRACK_BYTES", 2_000)
    v = views.Views(spark, "/root/testdata/sf0.01")
    parts = v.words.select("track_id", F.spark_partition_id().alias("p")).distinct()
    assert parts.select("p").distinct().count() > 30
    assert parts.count() == v.segments.select("track_id").distinct().count()


def test_equal_texts_settle_an_alignment(spark, monkeypatch):
    """Beside an equal text no other is compared, unless it is so long that four digits may not tell them apart."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return (a == b).astype(float)

    monkeypatch.setattr(udfs, "similarity_ratio", counted)
    names = "track_id long, seg_idx long, start_ms long, end_ms long, text string"
    ours = spark.createDataFrame([(1, 0, 0, 1000, "One"), (1, 1, 1000, 2000, "two"), (1, 2, 90_000, 91_000, None)], names)
    ref = spark.createDataFrame([(1, 0, 0, 1000, "six"), (1, 1, 500, 1500, "one"), (1, 2, 1000, 2000, "oner")], names).withColumnRenamed("seg_idx", "ref_idx")
    got = J.align_reference(ours, ref, mode="text").orderBy("seg_idx").collect()
    assert [(r["best_ref"], r["ratio"]) for r in got] == [(1, 1.0), (0, 0.0), (None, None)]
    assert calls.value <= 6  # of nine: one pair of the first row, three of the second; the rest are buckets without a pair
    long = "x" * 30_000
    ours, ref = (spark.createDataFrame(r, names) for r in ([(1, 0, 0, 1000, long)], [(1, 0, 0, 1000, long[1:]), (1, 1, 0, 1000, long)]))
    got = J.align_reference(ours, ref.withColumnRenamed("seg_idx", "ref_idx"), mode="text", fast=True).collect()
    assert [(r["best_ref"], r["ratio"]) for r in got] == [(0, 1.0)]


def test_short_tracks_are_solved_many_at_a_time(monkeypatch):
    """One table of costs for many tracks, and the cues each track has by itself; a track without any falls back alone."""
    calls, costs = [], D.cue_costs
    monkeypatch.setattr(D, "cue_costs", lambda *a: calls.append(len(a[0])) or costs(*a))
    rng, tracks = random.Random(7), {}
    for t in range(60):
        at, rows = 0, []
        for _ in range(rng.choice([1, 2, 15, 16, 17, 60])):
            at += rng.choice([100, 400, 900])
            long = 9000 if t % 7 == 3 else 350  # no cue may hold such a word
            rows.append((t, rng.choice(["a", "b.", "c,", None]), at, at + long, rng.choice(["x", "y", None, ""]) if t % 2 else "x", rng.choice([None, "t"])))
        tracks[t] = rows
    names = ["track_id", "text", "start_ms", "end_ms", "speaker", "term_id"]
    flat = [r for t in tracks.values() for r in t]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in flat[k : k + 100]]) for k in range(0, len(flat), 100)]
    got = [r for b in D._whole_tracks(iter(batches), True) for r in b.to_pylist()]
    assert calls == [len(flat) + len(tracks)]
    want = []
    for t, rows in tracks.items():
        start, end = (np.array([r[k] for r in rows], float) for k in (2, 3))
        text, speaker, term = ([r[k] for r in rows] for k in (1, 4, 5))
        text = [x or "" for x in text]
        cuts = D.cheapest_cuts(costs(start, end, text, speaker, term))
        method, cuts = ("greedy", D.greedy_cuts(start, end, text)) if cuts is None else ("optimal", cuts)
        want += [(t, k, int(start[a]), " ".join(text[a:b]), b - a, method) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(rows)], strict=True))]
    assert [(r["track_id"], r["cue_idx"], r["start_ms"], r["text"], r["n_words"], r["method"]) for r in got] == want
    assert {r["method"] for r in got} == {"greedy", "optimal"}


def test_a_table_of_one_short_track(spark):
    rows = spark.createDataFrame([(1, k, w, 400 * k, 400 * k + 350) for k, w in enumerate(["a", "b", "c."])], "track_id long, word_idx long, text string, start_ms long, end_ms long")
    for build in (D.build_cues_dp, D.build_cues_greedy):
        assert [(r["cue_idx"], r["text"], r["n_words"], r["speaker"]) for r in build(rows).collect()] == [(0, "a b c.", 3, None)]
        assert build(rows.limit(0)).count() == 0


def test_only_rows_of_several_buckets_are_shuffled_again(spark):
    """The best of a bucket is found where the join has put its rows; results are those of all pairs."""
    rng = random.Random(3)

    def words(n, null=False):
        rows = [(t, k, f"w{k}", s := rng.randrange(0, 3000), s + rng.choice([0, 50, 200, 1500]), None) for t in range(3) for k in range(n)]
        return [*rows, (1, n, "none", None, 5, None), (1, n + 1, "far", 90_000, 90_100, None)] if null else rows

    names = "track_id long, word_idx long, text string, start_ms long, end_ms long, speaker string"
    ours, theirs = spark.createDataFrame(words(80, True), names), spark.createDataFrame(words(60), names)
    rank = F.struct("overlap_ms", -F.col("r.word_idx"))
    got = J.best_overlap(ours, theirs, "word_idx", rank, bucket_ms=250)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("_several") > 0
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # each side is shuffled, as larger tables are
        shuffled = sorted(map(str, J.best_overlap(ours, theirs, "word_idx", rank, bucket_ms=250).collect()))
    want = sorted(map(str, J.best_overlap(ours, theirs, "word_idx", rank, bucket_ms=None).collect()))
    assert sorted(map(str, got.collect())) == shuffled == want
    assert len(want) == 3 * 80 + 2


def test_a_text_is_worked_out_once_to_be_shortened(spark):
    """However often the rules look at it, the expression of the text stands in the plan once."""
    rows = spark.createDataFrame([("a  b, c d, e f. g h", 1000), ("x", 5000), (None, 1000), ("p q r s t u v", 900)], "text string, slot long")
    fit = T.compress_if_needed(F.regexp_replace("text", "marker", ""), F.col("slot"), {"x y": "z"}, ["p "])
    out = rows.select(fit.alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("marker") == 1
    assert [r["t"] for r in out.collect()] == ["a b, e f. g h।", "x", None, "q r s t u v"]


class _State:
    """A job's state as a processor sees it; counts how often it is asked."""

    def __init__(self, now):
        self.now, self.value, self.timer, self.asked = now, None, None, 0

    exists = property(lambda self: self.value is not None)

    @property
    def get(self):
        self.asked += 1
        return self.value

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.now

    def update(self, value):
        self.asked += 1
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at >= max(1, self.now)
        self.timer = at


def test_a_jobs_state_is_read_and_written_once_a_call():
    """However many events wait; events come out in order, once the watermark has passed them, and the job is forgotten at last."""
    run, state, frame = jobs._eta_of_job(10_000), _State(0), lambda rows: pd.DataFrame(rows, columns=["us", "seq", "overall"])
    rng = random.Random(5)
    times = [1000 * rng.randrange(0, 9_000) for _ in range(300)]
    rows = [(us, k, rng.choice([None, us / 1e7, us / 2e7])) for k, us in enumerate(times)]
    assert list(run((7,), iter([frame(rows[:100]), frame(rows[100:])]), state)) == []
    assert state.asked == 1 and state.timer == max(1, min(rows)[0] // 1000)
    found = []
    for now in (4_000, 9_000):
        state.now, state.asked = now, 0
        found += [r for f in run((7,), iter([frame([])]), state) for r in f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)]
        assert state.asked == 2 and len(found) == sum(us // 1000 < now for us, _, _ in rows)
    first, largest, want = min(rows)[0], 0.0, []
    for us, seq, p in sorted(rows, key=lambda r: r[:2]):
        left, largest = jobs.next_eta(first, largest, us, p)
        want.append((7, seq, us, p, left))
    assert found == want and sum(w[4] is not None for w in want) > 3
    state.now = state.timer + 1
    assert list(run((7,), iter([frame([])]), state)) == [] and not state.exists


def test_tracks_are_dealt_by_their_texts_however_these_are_stored(spark, tmp_path, monkeypatch):
    """Texts that repeat take little room in a file and much in a task; words are made behind the shuffle."""
    n = 150  # different texts of 1920 letters in each of four files, ten times each
    pieces = [F.sha2(F.concat((F.col("id") % n).cast("string"), F.lit(f" {k} "), F.spark_partition_id().cast("string")), 256) for k in range(30)]
    rows = spark.range(0, 40 * n, numPartitions=4).select(F.floor(F.col("id") / 4).alias("conv_id"), (F.col("id") % 4).alias("turn"), F.lit("user").alias("role"), F.concat(*pieces).alias("text"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(views, "TRACK_BYTES", 100_000)
    v = views.Views(spark, str(tmp_path))
    assert views.input_bytes(v.table("conversations")) < 2_000_000
    assert v.segments.select(F.spark_partition_id()).distinct().count() > 80
    assert v.segments.count() == 40 * n
    plan = v.segments._jdf.queryExecution().optimizedPlan().toString()
    assert "split" in plan.split("RepartitionByExpression")[0] and "split" not in plan.split("RepartitionByExpression")[1]


def test_sentences_are_made_where_their_tracks_lie(spark, monkeypatch):
    """Tracks that have been dealt are not dealt again by the session's number of partitions; rows of other tables are."""
    monkeypatch.setattr(views, "TRACK_BYTES", 2_000)
    got = D.merge_into_sentences(views.Views(spark, "/root/testdata/sf0.01").words)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert got.select(F.spark_partition_id()).distinct().count() > 30
    names = "track_id long, word_idx long, text string, start_ms long, end_ms long, speaker string"
    rows = [(1, 3, "c.", 30, 35, "s"), (1, None, "n", 1, 2, "s"), (1, 1, "b", 10, 15, "s"), (1, 1, None, 10, 15, "s"), (1, 4, "d", 40, None, None), (None, 0, None, 0, 5, None)]
    got = D.merge_into_sentences(spark.createDataFrame(rows, names).repartition(3)).collect()
    want = [(1, "n b c.", 10, 35, 4, "s", 0), (1, "d", 40, None, 1, None, 1), (None, "", 0, 5, 1, None, 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_most_pairs_of_a_track_need_one_comparison(spark):
    """Pairs that overlap, by loops, with times that are null, turned round or without length; the join has plain comparisons."""
    rng = random.Random(9)

    def some(n, name):
        rows = [(rng.choice([1, 2, None]), k, rng.choice([None, s := rng.randrange(0, 900), s]), rng.choice([None, s + rng.choice([-60, 0, 40, 300]), s])) for k in range(n)]
        return rows, spark.createDataFrame(rows, f"track_id long, {name} long, start_ms long, end_ms long")

    (ours, a), (theirs, b) = some(90, "seg_idx"), some(70, "ref_idx")
    for slack in (0, 50):
        hits = {x[1]: [y[1] for y in theirs if None not in (x[0], *x[2:], *y[2:]) and x[0] == y[0] and min(x[3], y[3]) - max(x[2], y[2]) > -slack] for x in ours}
        want = sorted((i, r) for i, found in hits.items() for r in found or [-1])
        got = J.interval_join(a, b, slack_ms=slack, bucket_ms=None)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "least" not in next(line for line in plan.splitlines() if "Join LeftOuter" in line)
        assert sorted((r["seg_idx"], -1 if r["r"] is None else r["r"]["ref_idx"]) for r in got.collect()) == want
