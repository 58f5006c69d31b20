"""What a stream of job events says about time: the time left, and jobs that have fallen silent.

Both keep a job's state between micro-batches and act on timers. Event-time timers fire when the watermark has passed them,
so they see a job's events in order however these arrive within the watermark's delay; a silent job, of which no event
comes, is found by its timer too. Silent jobs need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

ENDED = ("done", "error", "waiting_for_srt")
_NEVER = (-1, -1)


def next_eta(first_us: int, largest: float, us: int, overall: float | None) -> tuple[float | None, float]:
    """Seconds left at the pace so far, and the largest progress, after one more event: a number where progress grew, lies
    within 0.01..1, and 2 s have gone."""
    if overall is None:
        return None, largest
    elapsed = (us - first_us) / 1e6
    left = None
    if 0.01 < overall < 1 and elapsed > 2 and overall > largest:
        left = (1 - overall) * elapsed / overall
    return left, max(largest, overall)


#: What is kept of a job: its first and last event that were taken, the largest progress, and events that wait.
_ETA_STATE = "first long, last long, largest double, us array<long>, seq array<long>, overall array<double>"


def _eta_of_job(forget_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Holds a job's events until the watermark has passed them, then takes them in order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        first, last, largest, *waiting = state.get if state.exists else (None, None, 0.0, (), (), ())
        held = list(zip(*waiting, strict=True))
        for part in parts:  # a timer comes without rows
            overall = [None if p is None or p != p else p for p in part["overall"].tolist()]
            held += zip(part["us"].tolist(), part["seq"].tolist(), overall, strict=True)
        ready = sorted((r for r in held if r[0] // 1000 < now), key=lambda r: r[:2])
        later = [r for r in held if r[0] // 1000 >= now]
        out = []
        for us, seq, overall in ready:
            if first is None or us - last > 1000 * forget_ms:
                first, largest = us, 0.0
            last = us
            left, largest = next_eta(first, largest, us, overall)
            out.append((key[0], seq, us, overall, left))
        if later or last is not None and now < last // 1000 + forget_ms:
            state.update((first, last, largest, *(map(list, zip(*later, strict=True)) if later else ([], [], []))))
            # a timer fires when the watermark is beyond it
            state.setTimeoutTimestamp(max(1, min(us for us, _, _ in later) // 1000 if later else last // 1000 + forget_ms))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["job_id", "seq", "us", "overall", "eta_s"])

    return run


def eta_stream(progress: DataFrame, delay: str = "10 seconds", forget_s: int = 7 * 86_400) -> DataFrame:
    """job_id, seq, ts, overall, eta_s of each event, in append mode, once the watermark has passed it.

    progress: a stream with job_id, seq, ts, overall; events of a job are taken in the order of their time, then seq. A job
    without events for forget_s begins anew. Later than `delay` an event is dropped, as everywhere behind a watermark.
    """
    rows = progress.filter("ts is not null").select("job_id", F.coalesce("seq", F.lit(-1)).alias("seq"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "overall")
    rows = rows.withWatermark("ts", delay).groupBy("job_id")
    out = rows.applyInPandasWithState(_eta_of_job(1000 * forget_s), "job_id long, seq long, us long, overall double, eta_s double", _ETA_STATE, "append", "EventTimeTimeout")
    return out.select("job_id", "seq", F.timestamp_micros("us").alias("ts"), "overall", F.round("eta_s", 1).alias("eta_s"))


class _Stuck(StatefulProcessor):
    def __init__(self, timeout_ms: int, forget_ms: int, by_event: bool) -> None:
        self.timeout_ms, self.forget_ms, self.by_event = timeout_ms, forget_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, seq long, state string, seen long, reported boolean")

    def _now(self, timers: object) -> int:
        return timers.getCurrentWatermarkInMs() if self.by_event else timers.getCurrentProcessingTimeInMs()

    def _wake(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, seq, state, _, reported = self.last.get() if self.last.exists() else (*_NEVER, None, 0, False)
        for part in rows:
            for u, s, name in part[["us", "seq", "state"]].itertuples(index=False):
                if (u, s) > (us, seq):
                    us, seq, state = int(u), int(s), name
        before = self.last.get()[:2] if self.last.exists() else _NEVER
        if (us, seq) == tuple(before):
            return  # nothing newer than what is known
        seen = us // 1000 + 1 if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        self.last.update((us, seq, state, seen, False))
        self._wake(seen + self.timeout_ms)
        if reported:
            yield pd.DataFrame({"job_id": [key[0]], "state": [state], "message": ["resumed"], "idle_s": pd.array([None], dtype="Float64")})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.last.exists():
            return
        us, seq, state, seen, reported = self.last.get()
        now = self._now(timerValues)
        if state in ENDED or now >= seen + self.timeout_ms + self.forget_ms:
            self.last.clear()  # later events of an ended job are behind the watermark, or begin a new one
        else:
            self.last.update((us, seq, state, seen, reported or state == "running"))
            self._wake(seen + self.timeout_ms + self.forget_ms)
        if state == "running" and not reported:
            idle = (now * 1000 - us) / 1e6 if self.by_event else (now - seen) / 1e3
            yield pd.DataFrame({"job_id": [key[0]], "state": ["error"], "message": ["restarted"], "idle_s": pd.array([idle], dtype="Float64")})

    def close(self) -> None:
        pass


def stuck_jobs_stream(events: DataFrame, timeout_s: int = 3600, *, clock: str = "event", delay: str = "10 minutes", forget_s: int = 7 * 86_400) -> DataFrame:
    """job_id, state, message, idle_s, in append mode: a row when a running job has been silent for longer than the timeout
    (error, restarted), and another when it speaks again (its state, resumed, null).

    events: a stream with job_id, seq, ts, state. clock: `event` measures silence by the watermark, so by other jobs' events;
    `processing` by the machine's clock from the event's arrival on, which also finds the last job of a stream that has
    stopped. A silent job is forgotten forget_s after its report, an ended one after the timeout. Events without a time are
    passed over; of two with the same time the larger seq is later.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock must be event or processing")
    rows = events.filter("ts is not null").select("job_id", F.coalesce("seq", F.lit(-1)).alias("seq"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "state")
    if clock == "event":
        rows = rows.withWatermark("ts", delay)
    processor = _Stuck(1000 * timeout_s, 1000 * forget_s, clock == "event")
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    out = rows.groupBy("job_id").transformWithStateInPandas(processor, "job_id long, state string, message string, idle_s double", "Append", mode)
    return out.withColumn("idle_s", F.round("idle_s", 1))
