"""Job progress events, as tables and as streams.

Functions of plain DataFrame operations take batch and streaming tables alike; those that need order within a job have a
batch form (windows) and a stateful streaming form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Fold, ordered_fold
from .jobs import ENDED, eta_stream, stuck_jobs_stream

# The steps in order and their weights
STEPS = {"download": 0.15, "extract": 0.05, "transcribe": 0.25, "translate": 0.15, "synthesize": 0.30, "assemble": 0.10}


def _us(c: Column | str) -> Column:
    """Microseconds of a time with or without a zone (then of the session's)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def overall_progress(events: DataFrame) -> DataFrame:
    """Adds overall: weights of the steps before, plus the step's weight times its progress, at most 1; an unknown step
    counts as everything done."""
    before, overall = 0.0, F.lit(1.0)
    for step, weight in STEPS.items():
        overall = F.when(F.col("step") == step, F.least(F.lit(1.0), F.lit(before) + F.lit(weight) * F.col("progress"))).otherwise(overall)
        before += weight
    return events.withColumn("overall", F.round(overall, 4))


def step_times(events: DataFrame) -> DataFrame:
    """job_id, step, seconds: time spent in each step, closed by the next step's first event, the last up to its last event."""
    w = Window.partitionBy("job_id").orderBy("seq")
    new = F.coalesce(F.lag("step").over(w) != F.col("step"), F.lit(True))
    runs = events.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("job_id", "_run", "step").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    end = F.coalesce(F.lead("a").over(Window.partitionBy("job_id").orderBy("_run")), F.col("b"))
    spans = spans.withColumn("us", _us(end) - _us("a"))
    return spans.groupBy("job_id", "step").agg(F.round(F.sum("us") / 1e6, 1).alias("seconds"))


class _StepTimes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "step string, since double, last double")
        self.spent = handle.getMapState("spent", "step string", "seconds double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("seq")
        step, since, last = self.current.get() if self.current.exists() else (None, 0.0, 0.0)
        for name, ts in zip(batch["step"], batch["ts"].map(lambda t: t.timestamp()), strict=True):
            if name != step:
                if step is not None:
                    old = self.spent.getValue((step,))[0] if self.spent.containsKey((step,)) else 0.0
                    self.spent.updateValue((step,), (old + ts - since,))
                step, since = name, ts
            last = ts
        self.current.update((step, since, last))
        total = {k[0]: v[0] for k, v in self.spent.iterator()}
        total[step] = total.get(step, 0.0) + last - since
        yield pd.DataFrame({"job_id": [key[0]] * len(total), "step": list(total), "seconds": [round(v, 1) for v in total.values()]})

    def close(self) -> None:
        pass


def step_times_stream(events: DataFrame) -> DataFrame:
    """The same on a stream, in update mode: after each batch the times of its jobs. Needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(_StepTimes(), "job_id long, step string, seconds double", "Update", "None")


def job_state_latest(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """job_id, state, step, ts of each job's last event, and whether that ends it."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("state", "step", "ts", "progress"), F.struct("ts", "seq")).alias("s"))
    out = last.select("job_id", "s.state", "s.step", "s.ts", "s.progress")
    return out.withColumn("terminal", F.col("state").isin(*ENDED))


def eta(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Adds eta_s: the rest of the way at the pace so far, where progress grew, lies within 0.01..1, and 2 s have gone.

    On a stream the rows of jobs.eta_stream, behind the watermark: events are then in the order of their time.
    """
    if events.isStreaming:
        return eta_stream(overall_progress(events), delay)
    w = Window.partitionBy("job_id").orderBy("seq")
    rows = overall_progress(events)
    elapsed = (_us("ts") - _us(F.first("ts").over(w.rowsBetween(Window.unboundedPreceding, 0)))) / 1e6
    before = F.max("overall").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_e": elapsed, "_b": F.coalesce(before, F.lit(0.0))})
    p = F.col("overall")
    good = (p > 0.01) & (p < 1) & (F.col("_e") > 2) & (p > F.col("_b"))
    return rows.withColumn("eta_s", F.when(good, F.round((1 - p) * F.col("_e") / p, 1))).drop("_e", "_b")


def success_rate_window(results: DataFrame, size: str = "10 seconds", least: int = 5, delay: str = "1 minute") -> DataFrame:
    """engine, window_start, success, failure, rate (null below `least` results) of tumbling windows."""
    rows = results.withWatermark("ts", delay) if results.isStreaming else results
    out = rows.groupBy("engine", F.window("ts", size).alias("w")).agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"))
    n = F.col("success") + F.col("failure")
    return out.select("engine", F.col("w.start").alias("window_start"), "success", "failure", F.when(n >= least, F.round(F.col("success") / n, 4)).alias("rate"))


def _next_health(state: tuple, t: float, ok: bool, round_s: float, least: int) -> tuple:
    """(health, results and good ones of the round, its begin or None) after one more result at second t."""
    health, n, good, since = state
    since, n, good = (t if since is None else since), n + 1, good + int(ok)
    ends = t - since >= round_s and n >= least
    if not ok:
        health = "degraded"
    elif ends and good / n > 0.95:
        health = "healthy"
    elif ends and good / n < 0.8:
        health = "struggling"
    return (health, 0, 0, None) if ends else (health, n, good, since)


class _HealthFold(Fold):
    def __init__(self, round_s: float, least: int) -> None:
        self.now, self.round_s, self.least = ("healthy", 0, 0, None), round_s, least

    def take(self, engine: object, us: int, ok: bool) -> list[tuple]:
        self.now = _next_health(self.now, us / 1e6, ok, self.round_s, self.least)
        return [(engine, us, self.now[0])]

    def state(self) -> str:
        return json.dumps(self.now)

    def resume(self, state: str, given: int) -> None:
        self.now = tuple(json.loads(state))


def provider_health(results: DataFrame, round_s: int = 10, least: int = 5, run_rows: int | None = None) -> DataFrame:
    """engine, ts, health after each result: degraded at a failure; when a round of at least round_s and `least` results
    ends, healthy above a rate of 0.95, struggling below 0.8; else unchanged. Starts healthy.

    A round begins where the one before ended, so an engine's results are folded in order, a batch at a time; those of an
    engine with more than run_rows in several tasks. Results without a time or an outcome are passed over.
    """
    rows = results.select("engine", _us("ts").alias("us"), "ok").filter("us is not null and ok is not null")
    rows = ordered_fold(rows, ["us", "ok"], lambda: _HealthFold(round_s, least), "engine string, us long, health string", run_rows)
    return rows.select("engine", F.timestamp_micros("us").alias("ts"), "health")


class _Health(StatefulProcessor):
    def __init__(self, round_s: float, least: int) -> None:
        self.round_s, self.least = round_s, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "health string, n int, good int, since double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else ("healthy", 0, 0, None)
        for ts, ok in pd.concat(list(rows)).sort_values(["ts", "ok"])[["ts", "ok"]].itertuples(index=False):
            state = _next_health(tuple(state), ts.timestamp(), ok, self.round_s, self.least)
        self.state.update(state)
        yield pd.DataFrame({"engine": [key[0]], "health": [state[0]]})

    def close(self) -> None:
        pass


def provider_health_stream(results: DataFrame, round_s: int = 10, least: int = 5) -> DataFrame:
    """The same on a stream: each engine's health after each batch. Needs the RocksDB state store."""
    return results.groupBy("engine").transformWithStateInPandas(_Health(round_s, least), "engine string, health string", "Update", "None")


def stuck_jobs(events: DataFrame, timeout_s: int = 3600, now: Column | None = None) -> DataFrame:
    """Running jobs whose last event is older than the timeout, with the error that replaces their state.

    now: the time to measure from, by default that of the table's last event. On a stream (without now) the rows of
    jobs.stuck_jobs_stream, by event time: reports and what takes them back.
    """
    if events.isStreaming:
        if now is not None:
            raise ValueError("a stream measures from its watermark")
        return stuck_jobs_stream(events, timeout_s)
    last = job_state_latest(events).filter("state = 'running'")
    if now is None:
        at = events.agg(F.max("ts").alias("_now"))
        last = last.crossJoin(F.broadcast(at))  # one row
    else:
        last = last.withColumn("_now", now)
    idle = (_us("_now") - _us("ts")) / 1e6
    return last.filter(idle > timeout_s).select("job_id", F.lit("error").alias("state"), F.lit("restarted").alias("message"), F.round(idle, 1).alias("idle_s"))


def event_windows(events: DataFrame, size: str, slide: str | None = None, gap: str | None = None, delay: str = "1 hour") -> DataFrame:
    """step, state, window_start, window_end, n: tumbling, sliding (slide) or session windows (gap, by job)."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    if gap:
        w, keys = F.session_window("ts", gap), ["job_id"]
    else:
        w, keys = (F.window("ts", size, slide) if slide else F.window("ts", size)), ["step", "state"]
    out = rows.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def dedup_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (job_id, seq) once; on a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])
    return events.dropDuplicates(["job_id", "seq"])
