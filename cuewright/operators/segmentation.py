"""Segmentation, deduplication and islands of timed text.

What only depends on neighbours is a window; what resets a counter inside a run folds over the run's array, what depends
on the last kept row over rows in order (folds.py); the globally optimal cue segmentation runs in numpy over a track or,
in long tracks, over runs of words whose tables of entries and exits are folded by track.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import dealt_anew, stored
from .folds import Fold, ordered_fold, row_batch, row_kinds
from .scans import Scan, in_order
from .timeline import track

# Limits of a cue, in ms and words
WORDS_MAX, WORDS_LOW, WORDS_HIGH = 16, 8, 14
DUR_MIN, DUR_MAX, DUR_LOW, DUR_HIGH = 800, 5500, 1200, 4500
WPS_MAX, WPS_HIGH = 5.2, 4.5
CPL_MAX = 42
PAUSE_SOFT, PAUSE_STRONG = 300, 500


def _before(order: str):
    return track(order).rowsBetween(Window.unboundedPreceding, -1)


def _ends(c: Column, marks: str) -> Column:
    return F.coalesce(F.rtrim(c).rlike(f"[{marks}]$"), F.lit(False))


def _is_end(c: Column) -> Column:
    """A word that ends a sentence: . ! ? at its end, unless it is an abbreviation."""
    return _ends(c, ".!?") & ~F.lower(F.trim(c)).isin(T.ABBREVIATIONS)


def _grouped(words: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each group of consecutive words: text, times, number of words, first speaker; numbered by track."""
    items = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    out = words.groupBy("track_id", *keys).agg(
        F.min("word_idx").alias("first_word"),
        F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"),
        F.min_by("start_ms", "word_idx").alias("start_ms"),
        F.max_by("end_ms", "word_idx").alias("end_ms"),
        F.count("*").cast("int").alias("n_words"),
        F.min_by("speaker", "word_idx").alias("speaker"),
    )
    return out.withColumn(name, (F.row_number().over(track("first_word")) - 1).cast("int")).drop("first_word", *keys)


class _Sentences(Fold):
    """Holds the words of the sentence at hand, at most `hard` of them; their number is all that later cuts depend on."""

    def __init__(self, soft: int, hard: int) -> None:
        self.soft, self.hard, self.track_id, self.words, self.n = soft, hard, None, [], 0

    def take(self, track_id: object, word_idx: int, cut: bool, comma: bool, *rest: object) -> Iterable[tuple]:
        out = self._closed(track_id) if cut and self.words else []
        self.words.append((word_idx, *rest))
        self.track_id = track_id
        if len(self.words) >= self.hard or comma and len(self.words) >= self.soft:
            out += self._closed(track_id)
        return out

    def _closed(self, track_id: object) -> list[tuple]:
        placed = [w for w in self.words if w[0] is not None]
        start, end, speaker = (placed[0][2], placed[-1][3], placed[0][4]) if placed else (None, None, None)
        out = [(track_id, " ".join(w[1] for w in self.words if w[1] is not None), start, end, len(self.words), speaker, self.n)]
        self.words, self.n = [], self.n + 1
        return out

    def end(self) -> Iterable[tuple]:
        return self._closed(self.track_id) if self.words else ()

    def state(self) -> str:
        return json.dumps((self.track_id, self.words))

    def resume(self, state: str, given: int) -> None:
        (self.track_id, self.words), self.n = json.loads(state), given


def merge_into_sentences(words: DataFrame, soft: int = 15, hard: int = 25, run_rows: int | None = None) -> DataFrame:
    """Sentences: cut after . ! ?, at a change between two known speakers, after , ; : from `soft` words, at `hard` words.
    A track of more than run_rows words is spread over tasks."""
    w = Window.partitionBy("track_id").orderBy("word_idx", "text")
    words = words.select("track_id", *(F.col(c).cast("long").alias(c) for c in ("word_idx", "start_ms", "end_ms")), "text", "speaker")
    cut = F.coalesce(_ends(F.lag("text").over(w), ".!?"), F.lit(False)) | F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(False))
    rows = words.select("track_id", "word_idx", cut.alias("_cut"), _ends(F.col("text"), ",;:").alias("_comma"), "text", "start_ms", "end_ms", "speaker")
    schema = "track_id long, text string, start_ms long, end_ms long, n_words int, speaker string, sent_idx int"
    return ordered_fold(rows, ["word_idx", "text"], lambda: _Sentences(soft, hard), schema, run_rows)


def split_terminator_sentences(words: DataFrame, cap: int = 40, cap_no_term: int = 12, hot_rows: int | None = None) -> DataFrame:
    """Sentences up to . ! ? (not behind abbreviations), cut every `cap` words, or every `cap_no_term` in tracks whose
    first hundred words end none. Tracks of more than hot_rows words are spread over tasks."""
    at = in_order(words.withColumn("_e", _is_end(F.col("text"))), "word_idx", hot_rows=hot_rows)
    at = at.scan(_place=Scan("sum_through", F.lit(1)), _run=Scan("sum_before", F.col("_e").cast("int")), _after=Scan("lag", F.col("_e")))
    begins = F.when(F.coalesce("_after", F.lit(True)), F.col("_place"))
    at = at.scan(_begin=Scan("max_through", begins), _early=Scan("max_all", F.when(F.col("_place") <= 100, F.col("_e"))))
    size = F.when(F.col("_early"), cap).otherwise(cap_no_term)
    rows = at.done().withColumn("_piece", F.floor((F.col("_place") - F.col("_begin")) / size))
    return _grouped(rows, ["_run", "_piece"], "sent_idx")


def dedup_rolling_words(raw_words: DataFrame) -> DataFrame:
    """Words of rolling captions once for each (text, time to 10 ms); words of cues without inline times (plain) stay
    only if they start after every timed word of earlier rows. word_idx is renumbered."""
    w = Window.partitionBy("track_id", "text", F.round(F.col("start_ms") / 10)).orderBy("word_idx")
    last = F.max(F.when(~F.col("plain"), F.col("start_ms"))).over(_before("word_idx"))
    rows = raw_words.withColumn("_last", last).withColumn("_k", F.row_number().over(w))
    rows = rows.filter(~F.col("plain") | F.col("_last").isNull() | (F.col("start_ms") > F.col("_last") + 1)).filter("_k = 1")
    return rows.withColumn("word_idx", F.row_number().over(track("word_idx")) - 1).drop("_last", "_k")


class _Rolling(Fold):
    """Holds the last row that was kept."""

    def __init__(self) -> None:
        self.kept, self.n = None, 0

    def take(self, *row: object) -> Iterable[tuple]:
        if self.kept is None:
            self.kept = row
            return ()
        last, now = self.kept[2], row[2]
        if last is not None and now is not None and last in now:
            self.kept = row
            return ()
        if last is not None and now is not None and now in last:
            return ()
        out, self.kept = self.end(), row
        return out

    def end(self) -> Iterable[tuple]:
        track_id, _, text, start, end = self.kept
        self.n += 1
        return [(track_id, self.n - 1, text, start, end)]

    def state(self) -> str:
        return json.dumps(self.kept)

    def resume(self, state: str, given: int) -> None:
        self.kept, self.n = json.loads(state), given


def dedup_rolling_segments(segments: DataFrame, run_rows: int | None = None) -> DataFrame:
    """Rolling captions: a row that contains the last kept one replaces it, a row contained in it is dropped; rows
    without a text stay. A track of more than run_rows rows is spread over tasks."""
    rows = segments.select("track_id", "seg_idx", "text", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))
    return ordered_fold(rows, ["seg_idx"], _Rolling, "track_id long, seg_idx long, text string, start_ms long, end_ms long", run_rows)


def runs_of_equal_text(frames: DataFrame, step_ms: int = 1000, least: int = 3, hot_rows: int | None = None) -> DataFrame:
    """Segments of consecutive equal texts of more than `least` characters; each ends where the next starts. Tracks of more than
    hot_rows frames are spread over tasks."""
    at = in_order(frames.filter(F.length(F.trim("text")) > least), "ts_ms", hot_rows=hot_rows).scan(_last=Scan("lag", F.col("text")))
    new = F.coalesce(F.col("_last") != F.col("text"), F.lit(True))
    rows = at.scan(_run=Scan("sum_through", new.cast("int"))).done()
    runs = rows.groupBy("track_id", "_run").agg(F.first("text").alias("text"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"))
    runs = in_order(runs, "_run", hot_rows=hot_rows).scan(_next=Scan("lead", F.col("start_ms"))).done()
    return runs.select("track_id", (F.col("_run") - 1).cast("int").alias("seg_idx"), "text", "start_ms", F.coalesce("_next", F.col("last_ms") + step_ms).alias("end_ms"))


# Cues ----------------------------------------------------------------------------------------------------------------


def cue_costs(start: np.ndarray, end: np.ndarray, text: list[str], speaker: list, term: list) -> np.ndarray:
    """cost[i, n-1] of the cue of n words from word i; infinite where a hard rule forbids it or the track ends.

    start, end in ms; term: the id of a protected term's word, else None.
    """
    size = len(start)
    cost = np.full((size, WORDS_MAX), np.inf)
    chars = np.concatenate(([0], np.cumsum([len(t) for t in text])))
    stop = np.array([(-3.0 if t.rstrip()[-1:] in tuple(".!?") else -1.0 if t.rstrip()[-1:] in tuple(",;:") else 0.0) for t in text])
    known = np.array([0 if s is None or s == "" else 1 for s in speaker])
    change = np.zeros(size + 1, dtype=int)
    for k in range(1, size):
        change[k] = int(known[k] and known[k - 1] and speaker[k] != speaker[k - 1])
    changes = np.cumsum(change[:size])
    joins = np.array([k > 0 and term[k] is not None and term[k] == term[k - 1] for k in range(size)] + [False])
    gap = np.append(start[1:] - end[:-1], 0.0)
    pause = np.where(gap > PAUSE_STRONG, -4.0, np.where(gap > PAUSE_SOFT, -1.5, 0.0))
    pause[-1:] = 0
    for n in range(1, WORDS_MAX + 1):
        i = np.arange(size - n + 1)
        if not len(i):
            break
        j = i + n - 1
        d = (end[j] - start[i]) / 1000.0
        length = chars[j + 1] - chars[i] + n - 1
        bad = (d <= 0) | (d > DUR_MAX / 1000) | (changes[j] != changes[i]) | joins[i] | joins[j + 1]
        if n > 1:
            bad |= d < DUR_MIN / 1000
        wps = np.where(d > 0.3, n / np.where(d > 0, d, 1), 0)
        line = length / 2 if n > 6 else length
        c = np.where(d < DUR_LOW / 1000, (DUR_LOW / 1000 - d) * 2, np.where(d > DUR_HIGH / 1000, (d - DUR_HIGH / 1000) * 3, 0.0))
        c += max(0, WORDS_LOW - n) * 0.5 + max(0, n - WORDS_HIGH) * 1.5 + max(0, n - 12) * 0.8
        c += np.where(wps > WPS_MAX, (wps - WPS_MAX) * 5, np.where(wps > WPS_HIGH, wps - WPS_HIGH, 0.0))
        c += stop[j] + pause[j] + np.maximum(line - CPL_MAX, 0) * 0.3
        cost[i, n - 1] = np.where(bad, np.inf, c)
    return cost


#: Costs are summed in whole millionths, so that sums do not depend on how a track is cut and equal costs are equal.
_UNIT = 1e-6
_NEVER = 1 << 60
_POSSIBLE = 1 << 59  # whatever costs less


def _units(cost: np.ndarray) -> np.ndarray:
    known = np.isfinite(cost)
    return np.where(known, np.rint(np.where(known, cost, 0) / _UNIT), _NEVER).astype(np.int64)


def _cheapest(cost: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs of all that ends before each word, and where the last cue of it begins (of equal ones the longest).

    best: (entries, words + 1), set to what each entry costs where it may begin, else _NEVER. cost: (words, 16), in units.
    """
    size, back, rows = best.shape[1], np.full(best.shape, -1), np.arange(len(best))
    ending = np.full((size, WORDS_MAX), _NEVER)  # by the word they end before, the longest cue first
    for n in range(1, min(WORDS_MAX, size - 1) + 1):
        ending[n:, WORDS_MAX - n] = cost[: size - n, n - 1]
    held = np.full((len(best), size + WORDS_MAX), _NEVER)
    held[:, WORDS_MAX:] = best
    if len(best) == 1:  # the same for a single row, in plain numbers
        row, one = held[0].tolist(), [-1] * size
        for j in np.flatnonzero((ending < _NEVER).any(axis=1)).tolist():
            least, at = row[j + WORDS_MAX], -1
            for i, c in enumerate(ending[j].tolist(), j):
                if c < _POSSIBLE and row[i] + c < least and row[i] < _POSSIBLE:
                    least, at = row[i] + c, i
            if at >= 0:
                row[j + WORDS_MAX], one[j] = least, at - WORDS_MAX
        return np.array([row[WORDS_MAX:]]), np.array([one])
    for j in range(1, size):
        total = held[:, j : j + WORDS_MAX] + ending[j]
        k = total.argmin(axis=1)
        found = total[rows, k]
        better = (found < held[:, j + WORDS_MAX]) & (found < _POSSIBLE)
        held[better, j + WORDS_MAX] = found[better]
        back[better, j] = (j - WORDS_MAX + k)[better]
    return held[:, WORDS_MAX:], back


def _walk(back: np.ndarray, at: int) -> list[int]:
    """Where the cues that end before word `at` begin."""
    cuts = []
    while back[at] >= 0:
        at = int(back[at])
        cuts.append(at)
    return cuts[::-1]


def cheapest_cuts(cost: np.ndarray) -> list[int] | None:
    """Where the cues of least total cost begin; of equal ones the longest last cue; None if no segmentation exists."""
    first = np.full((1, len(cost) + 1), _NEVER)
    first[0, 0] = 0
    best, back = _cheapest(_units(cost), first)
    return _walk(back[0], len(cost)) if best[0, -1] < _POSSIBLE else None


def _greedy_end(start: np.ndarray, end: np.ndarray, text: list[str], first: int) -> int:
    """The word before which the greedy cue from word `first` ends."""
    for k in range(first, min(first + WORDS_HIGH, len(text))):
        if text[k].rstrip()[-1:] in tuple(".!?") or end[k] - start[first] >= DUR_HIGH:
            return k + 1
    return min(first + WORDS_HIGH, len(text))


def greedy_cuts(start: np.ndarray, end: np.ndarray, text: list[str], first: int = 0, stop: int | None = None) -> list[int]:
    """Where greedy cues begin from word `first` on, before word `stop`."""
    cuts = []
    while first < (len(text) if stop is None else stop):
        cuts.append(first)
        first = _greedy_end(start, end, text, first)
    return cuts


CUES = "track_id long, cue_idx int, start_ms long, end_ms long, text string, n_words int, speaker string, method string"
_RUN = 4096


class _Words:
    """The words of a track, or of one of its runs with the 17 words that follow, as arrays."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("_k", kind="stable")
        self.start, self.end = pdf["start_ms"].to_numpy(float), pdf["end_ms"].to_numpy(float)
        known = lambda c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist()
        self.text, self.speaker, self.term = pdf["text"].fillna("").tolist(), known("speaker"), known("term_id")
        self.joined = bool(pdf["_joined"].iloc[0])  # with the word before, which may lie in another run

    def costs(self) -> np.ndarray:
        cost = _units(cue_costs(self.start, self.end, self.text, self.speaker, self.term))
        if self.joined:
            cost[0] = _NEVER
        return cost

    def cues(self, track_id: object, cuts: list[int], stop: int, method: str, base: int = 0) -> pd.DataFrame:
        ends = [*cuts[1:], stop] if cuts else []
        return pd.DataFrame(
            dtype=None if cuts else object,
            data={
                "track_id": [track_id] * len(cuts),
                "cue_idx": [base + a for a in cuts],
                "start_ms": [int(self.start[a]) for a in cuts],
                "end_ms": [int(self.end[b - 1]) for b in ends],
                "text": [" ".join(self.text[a:b]) for a, b in zip(cuts, ends, strict=True)],
                "n_words": [b - a for a, b in zip(cuts, ends, strict=True)],
                "speaker": [self.speaker[a] for a in cuts],
                "method": [method] * len(cuts),
            }
        )


def _transfer(pdf: pd.DataFrame, optimal: bool) -> pd.DataFrame:
    """One run's table: what it costs to enter it k words late (as the cue before reaches so far) and to leave it with a cue
    that reaches l words beyond it, for all k and l; the l of the greedy rule for each k.

    ranks tell, for each l, which of the entries' cheapest ways has the longer cue where they first differ from the end on: the
    one an undivided track takes of equally cheap ones. A way that has come to its entry goes on with a cue from
    before the run, which is longer than any that begins in it.
    """
    own = int((pdf["_run"] == pdf["_of"]).sum())
    w = _Words(pdf)
    costs, ranks = np.full((WORDS_MAX, WORDS_MAX), _NEVER), np.zeros((WORDS_MAX, WORDS_MAX), dtype=np.int64)
    if optimal:
        cost = w.costs()
        cost[own:] = _NEVER  # those cues begin in the next run
        entry = np.full((WORDS_MAX, len(cost) + 1), _NEVER)
        for k in range(min(WORDS_MAX, own + 1)):
            entry[k, k] = 0
        best, back = _cheapest(cost, entry)
        reach = min(WORDS_MAX, len(cost) + 1 - own)
        costs[:, :reach] = best[:, own : own + reach]
        for over in range(reach):
            ways = sorted((k for k in range(WORDS_MAX) if costs[k, over] < _POSSIBLE), key=lambda k: [*_walk(back[k], own + over)[::-1], -1])
            ranks[ways, over] = np.arange(len(ways))
    ends, greedy = {}, []
    for k in range(WORDS_MAX):
        at = min(k, own)
        while at < own:
            if at not in ends:
                ends[at] = _greedy_end(w.start, w.end, w.text, at)
            at = ends[at]
        greedy.append(at - own)
    return pd.DataFrame({"_track": [pdf["track_id"].iloc[0]], "_run": [int(pdf["_of"].iloc[0])], "costs": [costs.ravel().tolist()], "ranks": [ranks.ravel().tolist()], "greedy": [greedy]})


def _entries(pdf: pd.DataFrame, optimal: bool) -> pd.DataFrame:
    """For each run of a track how many words late it is entered and how many words beyond it its last cue reaches."""
    pdf = pdf.sort_values("_run", kind="stable")
    tables, ranks = ([np.array(c).reshape(WORDS_MAX, WORDS_MAX) for c in pdf[name]] for name in ("costs", "ranks"))
    best, backs = np.full(WORDS_MAX, _NEVER), []
    best[0] = 0
    for t, r in zip(tables, ranks, strict=True):
        total = np.minimum(np.minimum(best, _NEVER)[:, None] + t, _NEVER)
        least = total.min(axis=0)
        backs.append(np.where(total == least, r, WORDS_MAX).argmin(axis=0))
        best = np.where(least < _POSSIBLE, least, _NEVER)
    ends = [0]
    if optimal and best[0] < _POSSIBLE:
        for back in reversed(backs):
            ends.append(int(back[ends[-1]]))
        ends = ends[::-1]
        method = "optimal"
    else:
        for greedy in pdf["greedy"]:
            ends.append(int(greedy[ends[-1]]))
        ends[-1], method = 0, "greedy"
    runs = len(tables)
    return pd.DataFrame({"_track": pdf["_track"].tolist(), "_entered": pdf["_run"].tolist(), "late": ends[:-1], "over": ends[1:], "method": [method] * runs})


def _solved(pdf: pd.DataFrame, optimal: bool) -> pd.DataFrame:
    """The cues that begin in a run, numbered by their first words."""
    w, own, base = _Words(pdf), int((pdf["_run"] == pdf["_of"]).sum()), int(pdf["_k"].min())
    late, over, method = int(pdf["late"].iloc[0]), int(pdf["over"].iloc[0]), pdf["method"].iloc[0]
    if method == "optimal":
        cost = w.costs()
        cost[own:] = _NEVER
        entry = np.full((1, len(cost) + 1), _NEVER)
        entry[0, late] = 0
        cuts = _walk(_cheapest(cost, entry)[1][0], own + over)
    else:
        cuts = greedy_cuts(w.start, w.end, w.text, late, own)
    return w.cues(pdf["track_id"].iloc[0], cuts, own + over, method, base)


#: Words of whole tracks that are solved at a time.
_TOGETHER = 32_768


def _cheapest_each(cost: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_cheapest for many tracks at a time, each entered at its first word: word by word, all tracks that are so long.

    Track t has the rows of cost from starts[t] on, sizes[t] of them and one that no cue may have; results have a place for
    each row.
    """
    ending = np.full((len(cost), WORDS_MAX), _NEVER)  # by the word they end before, the longest cue first
    for n in range(1, min(WORDS_MAX, len(cost) - 1) + 1):
        ending[n:, WORDS_MAX - n] = cost[: len(cost) - n, n - 1]
    held, back = np.full(len(cost) + WORDS_MAX, _NEVER), np.full(len(cost), -1)
    held[starts + WORDS_MAX] = 0
    by_size = np.argsort(-sizes, kind="stable")
    starts, longer = starts[by_size], np.searchsorted(-sizes[by_size], -np.arange(sizes.max(initial=0) + 1), side="right")
    window = np.arange(WORDS_MAX)
    for j in range(1, len(longer)):
        at = starts[: longer[j]] + j
        total = held[at[:, None] + window] + ending[at]
        k = total.argmin(axis=1)
        found = total[np.arange(len(at)), k]
        possible = found < _POSSIBLE
        held[at[possible] + WORDS_MAX] = found[possible]
        back[at[possible]] = (at - WORDS_MAX + k)[possible]
    return held[WORDS_MAX:], back


def _together(tracks: list[list[tuple]], optimal: bool) -> list[tuple]:
    """The cues of whole tracks, each a list of (track_id, text, start_ms, end_ms, speaker, term_id) in order."""
    sizes = np.array([len(t) for t in tracks])
    starts = np.cumsum(sizes + 1) - sizes - 1
    # behind each track a word that belongs to no cue and begins where the track ends, so that there is no pause
    rows = [r for t in tracks for r in (*t, (None, "", t[-1][3], t[-1][3], None, None))]
    _, text, start, end, speaker, term = map(list, zip(*rows, strict=True))
    text, start, end = ["" if t is None else t for t in text], np.array(start, dtype=float), np.array(end, dtype=float)
    if optimal:
        cost = _units(cue_costs(start, end, text, speaker, term))
        beyond = np.repeat(starts + sizes, sizes + 1) - np.arange(len(rows))  # words up to the track's end
        cost[beyond[:, None] < np.arange(1, WORDS_MAX + 1)] = _NEVER
        best, back = _cheapest_each(cost, starts, sizes)
    out = []
    for t, (first, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        stop = first + size
        if optimal and best[stop] < _POSSIBLE:
            cuts, method = _walk(back, stop), "optimal"
        else:
            cuts, method = [first + c for c in greedy_cuts(start[first:stop], end[first:stop], text[first:stop])], "greedy"
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], stop], strict=True)):
            out.append((tracks[t][0][0], k, int(start[a]), int(end[b - 1]), " ".join(text[a:b]), b - a, speaker[a], method))
    return out


def _whole_tracks(batches: Iterator[pa.RecordBatch], optimal: bool) -> Iterator[pa.RecordBatch]:
    """The cues of the tracks of a partition, whose rows come in order; many tracks at a time, as most are short."""
    kinds, tracks, words = row_kinds(CUES), [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not tracks or row[0] != tracks[-1][0][0]:
                if words >= _TOGETHER:
                    yield row_batch(_together(tracks, optimal), kinds)
                    tracks, words = [], 0
                tracks.append([])
            tracks[-1].append(row)
            words += 1
    if tracks:
        yield row_batch(_together(tracks, optimal), kinds)


def _cues(words: DataFrame, optimal: bool, run: int = _RUN) -> DataFrame:
    """Tracks of up to `run` words are solved whole, many at a time. Longer ones are dealt by runs of that many words: each
    run's table of entries and exits, a fold of these small tables by track, then each run's cues."""
    have = lambda c: F.col(c) if c in words.columns else F.lit(None).cast("string")
    rows = words.select("track_id", "word_idx", "text", "start_ms", "end_ms", have("speaker").alias("speaker"), have("term_id").alias("term_id"))
    before = F.lag("term_id").over(track("word_idx"))
    rows = rows.withColumns({"_k": F.row_number().over(track("word_idx")) - 1, "_joined": F.coalesce(before == F.col("term_id"), F.lit(False)), "_n": F.count("*").over(Window.partitionBy("track_id"))})
    rows = stored(rows.drop("word_idx"), "words-of-tracks")  # read up to three times below
    short = dealt_anew(rows.filter(F.col("_n") <= run), "track_id").sortWithinPartitions("track_id", "_k")
    cues = short.select("track_id", "text", "start_ms", "end_ms", "speaker", "term_id").mapInArrow(lambda batches: _whole_tracks(batches, optimal), CUES)
    long = rows.filter(F.col("_n") > run).withColumn("_run", F.floor(F.col("_k") / run).cast("long"))
    if not long.isEmpty():
        numbered = _long_cues(long, optimal, run).withColumn("cue_idx", (F.row_number().over(track("cue_idx")) - 1).cast("int"))
        cues = cues.unionByName(numbered)
    return cues


def _long_cues(rows: DataFrame, optimal: bool, run: int) -> DataFrame:
    # a run sees the 17 words behind it: 16 that its last cue may reach, and one that tells the pause and the terms there
    both = F.when((F.col("_k") % run < WORDS_MAX + 1) & (F.col("_run") > 0), F.array(F.col("_run"), F.col("_run") - 1)).otherwise(F.array("_run"))
    dealt = rows.withColumn("_of", F.explode(both))
    tables = dealt.groupBy("track_id", "_of").applyInPandas(lambda pdf: _transfer(pdf, optimal), "_track long, _run long, costs array<long>, ranks array<long>, greedy array<long>")
    entries = tables.groupBy("_track").applyInPandas(lambda pdf: _entries(pdf, optimal), "_track long, _entered long, late long, over long, method string")
    # null-safe, so that no filter is inferred below and both uses of the words share one shuffle
    same = F.col("track_id").eqNullSafe(F.col("_track")) & F.col("_of").eqNullSafe(F.col("_entered"))
    return dealt.join(entries, same).groupBy("track_id", "_of").applyInPandas(lambda pdf: _solved(pdf, optimal), CUES)


def build_cues_dp(words: DataFrame, lookahead: int | None = None) -> DataFrame:
    """Cues of globally least cost in each track; tracks without a feasible segmentation fall back to the greedy rule.

    lookahead is accepted for callers that bound the search; cues never exceed 16 words, which bounds it already. A long
    track is spread over tasks by runs of words; its cues are those of the undivided track. Costs are compared in
    millionths; of equal ones the track's last cue is the longest possible, then the one before it, and so on.
    """
    return _cues(words, optimal=True)


def build_cues_greedy(words: DataFrame) -> DataFrame:
    """A cue ends at . ! ?, once it lasts 4.5 s, or at 14 words; long tracks are spread over tasks likewise."""
    return _cues(words, optimal=False)


class _Packer(Fold):
    """Holds the cue that may still take another sentence."""

    def __init__(self, budget: int, most: int, respect: bool) -> None:
        self.budget, self.most, self.respect, self.held, self.n = budget, most, respect, None, 0

    def take(self, track_id: object, _idx: object, _piece: object, text: str, a: int, b: int, n: int, speaker: str | None, big: bool) -> Iterable[tuple]:
        h = self.held
        if h is not None:
            same = not self.respect or speaker in (None, "", h["speaker"]) or h["speaker"] in (None, "")
            if not h["big"] and not big and h["sents"] < self.most and h["n"] + n <= self.budget and b - h["a"] <= DUR_MAX and same:
                h.update(text=h["text"] + " " + text, b=b, n=h["n"] + n, sents=h["sents"] + 1, speaker=speaker)
                return ()
        out = self.end()
        self.held = {"track": track_id, "text": text, "a": a, "b": b, "n": n, "sents": 1, "speaker": speaker, "first": speaker, "big": big}
        return out

    def end(self) -> Iterable[tuple]:
        h, self.held = self.held, None
        if h is None:
            return ()
        self.n += 1
        return [(h["track"], self.n - 1, h["a"], h["b"], h["text"], h["n"], h["sents"], h["first"])]

    def state(self) -> str:
        return json.dumps(self.held)

    def resume(self, state: str, given: int) -> None:
        self.held, self.n = json.loads(state), given


def pack_sentences(sentences: DataFrame, buffer: float = 0.2, max_sent: int = 2, respect_speakers: bool = True, run_rows: int | None = None) -> DataFrame:
    """Cues of up to max_sent sentences within int(16 / (1 + buffer)) words, 5.5 s and one speaker.

    sentences: track_id, sent_idx, text, start_ms, end_ms, n_words, speaker. A sentence over the budget is cut into
    pieces of budget size, their times by word share, and stands alone. A track of more than run_rows pieces is spread over
    tasks.
    """
    budget = int(16 / (1 + max(0.0, buffer)))
    words = T.tokens(F.col("text"))
    n = F.size(words)
    over = sentences.withColumn("_w", words).withColumn("_n", n).filter("_n > 0")
    over = over.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / budget).cast("int") - 1))).withColumn("_big", F.col("_n") > budget)
    a, b = F.col("_piece") * budget, F.least((F.col("_piece") + 1) * budget, F.col("_n"))
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda k: (F.col("start_ms") + F.floor(span * k / F.col("_n"))).cast("bigint")
    piece = F.array_join(F.slice("_w", a + 1, b - a), " ")
    rows = over.select("track_id", "sent_idx", "_piece", piece.alias("text"), at(a).alias("a"), at(b).alias("b"), (b - a).cast("int").alias("n"), "speaker", F.col("_big").alias("big"))
    schema = "track_id long, cue_idx int, start_ms long, end_ms long, text string, n_words int, n_sentences int, speaker string"
    return ordered_fold(rows, ["sent_idx", "_piece"], lambda: _Packer(budget, max_sent, respect_speakers), schema, run_rows)


def plain_fallback_chunks(df: DataFrame, n: int = 20, least: int = 40) -> DataFrame:
    """Texts of more than `least` words without . ! ?, in chunks of n words; other texts in one. df: track_id, text."""
    t = T.tokens(F.col("text"))
    rows = df.select("track_id", t.alias("_t")).withColumn("_cut", (F.size("_t") > least) & ~F.exists("_t", _is_end)).filter(F.size("_t") > 0)
    rows = rows.withColumn("_size", F.when(F.col("_cut"), n).otherwise(F.size("_t")))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.size("_t") / F.col("_size")).cast("int") - 1)))
    return rows.select("track_id", "chunk", F.array_join(F.slice("_t", F.col("chunk") * F.col("_size") + 1, F.col("_size")), " ").alias("text"))
