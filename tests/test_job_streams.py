"""Time left and silent jobs on streams of several micro-batches."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from cuewright.streaming import events as R
from cuewright.streaming import jobs
from cuewright.streaming.runs import run_available

SCHEMA = "job_id long, seq long, ts timestamp, step string, progress double, state string"


def _at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


class _Feed:
    """A folder of which each file becomes a micro-batch of its own."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, str(folder), 0
        self.add([])

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.folder)


def _start(stream, name):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").start()


def test_a_silent_job_is_reported_once_and_taken_back(spark, tmp_path):
    feed = _Feed(spark, tmp_path / "events")
    q = _start(jobs.stuck_jobs_stream(feed.stream(), 60, delay="0 seconds"), "stuck")

    def step(*rows):
        feed.add([(j, n, _at(s), "translate", 0.5, state) for j, n, s, state in rows])
        q.processAllAvailable()
        return sorted((r["job_id"], r["state"], r["message"], r["idle_s"]) for r in spark.sql("SELECT * FROM stuck").collect())

    try:
        assert step((1, 0, 0, "running"), (2, 0, 0, "running"), (3, 0, 1, "done")) == []
        assert step((2, 1, 50, "running")) == []
        silent = (1, "error", "restarted", 100.0)
        assert step((2, 2, 100, "running")) == [silent]
        assert step((2, 3, 150, "running")) == [silent]  # once
        assert step((1, 1, 160, "running"), (2, 4, 161, "done")) == [silent, (1, "running", "resumed", None)]
        assert step((4, 0, 400, "running"), (4, 0, 400, "running"), (None, 0, 399, "running")) == [silent, (1, "error", "restarted", 240.0), (1, "running", "resumed", None)]
    finally:
        q.stop()


def test_silence_by_the_clock(spark, tmp_path):
    feed = _Feed(spark, tmp_path / "events")
    feed.add([(1, 0, _at(0), "translate", 0.5, "running"), (2, 0, _at(0), "translate", 1.0, "done")])
    q = _start(jobs.stuck_jobs_stream(feed.stream(), 2, clock="processing"), "stuck_clock")

    def rows(n):  # batches go on by the clock, so processAllAvailable would wait for ever
        until = time.time() + 60
        while time.time() < until and len(found := spark.sql("SELECT * FROM stuck_clock").collect()) < n:
            time.sleep(0.3)
        return [(r["job_id"], r["state"], r["message"]) for r in found], found

    try:
        said, found = rows(1)
        assert said == [(1, "error", "restarted")] and found[0]["idle_s"] >= 2
        feed.add([(1, 1, _at(1), "translate", 0.6, "running")])
        assert rows(2)[0][:2] == [(1, "error", "restarted"), (1, "running", "resumed")]
    finally:
        q.stop()
    with pytest.raises(ValueError, match="clock"):
        jobs.stuck_jobs_stream(feed.stream(), clock="sun")


def test_stream_forms_of_the_plain_functions(spark, tmp_path):
    feed = _Feed(spark, tmp_path / "events")
    assert R.stuck_jobs(feed.stream()).isStreaming and R.eta(feed.stream()).isStreaming
    with pytest.raises(ValueError, match="watermark"):
        R.stuck_jobs(feed.stream(), now=F.current_timestamp())
    assert run_available(R.eta(feed.stream()), "eta-of-nothing").count() == 0


def test_time_left_of_shuffled_batches_equals_the_table(spark, tmp_path):
    rng = random.Random(7)
    rows, at, steps = [], 0, list(R.STEPS)
    for n in range(240):
        at += rng.choice([0, 1, 3])
        j = rng.randrange(6)
        rows.append((j, n, _at(at), rng.choice([steps[n // 48], steps[n // 48], steps[0]]), rng.choice([None, *(k / 10 for k in range(11))]), "running"))
    want = {(r["job_id"], r["seq"]): (r["overall"], r["eta_s"]) for r in R.eta(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(range(len(rows)), key=lambda k: k + rng.uniform(0, 30))  # late by thirty events at most
    feed = _Feed(spark, tmp_path / "events")
    q = _start(R.eta(feed.stream(), delay="100 seconds"), "eta_shuffled")
    try:
        for a in range(0, 240, 60):
            feed.add([rows[k] for k in order[a : a + 60]])
            q.processAllAvailable()
        feed.add([(99, 0, _at(at + 1000), "download", 0.1, "running")])
        q.processAllAvailable()
        found = spark.sql("SELECT * FROM eta_shuffled").collect()
    finally:
        q.stop()
    assert len(found) == len(want) and {(r["job_id"], r["seq"]): (r["overall"], r["eta_s"]) for r in found} == want
    assert sum(e is not None for _, e in want.values()) > 10


def test_a_job_is_forgotten(spark, tmp_path):
    feed = _Feed(spark, tmp_path / "events")
    q = _start(jobs.eta_stream(R.overall_progress(feed.stream()), "0 seconds", forget_s=100), "eta_forgets")
    try:
        for n, s in enumerate((0, 10, 300, 310, 320)):
            feed.add([(1, n, _at(s), "translate", 0.5 + n / 100, "running"), (2, n, _at(s + 5), "translate", 0.5, "running")])
            q.processAllAvailable()
        got = {r["seq"]: r["eta_s"] for r in spark.sql("SELECT * FROM eta_forgets WHERE job_id = 1").collect()}
    finally:
        q.stop()
    assert got[0] is None and got[2] is None and got[1] is not None
    assert got[3] == round((1 - 0.5295) * 10 / 0.5295, 1)  # measured from second 300 on
