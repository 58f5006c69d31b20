"""Periodic runs of words, found over a grammar of the text.

A run is a stretch of words with smallest period q and at least 2q words that cannot be extended. Re-Pair replaces pairs of
symbols that occur again and again by new symbols; what is left is joined two by two, so that each text becomes one
symbol of a binary grammar. Every run lies in the text of a smallest symbol and crosses the border of its two halves,
so it suffices to look at each symbol once, whatever the number of its occurrences: runs across its border are found
there, carried to all places that derive from it, and kept where they are maximal.

The first count of pairs also tells where no run can be. Inside a run of 2q words or more each pair of neighbours occurs a
second time, q words away, but for the middle pair of a run of exactly 2q words; so only stretches of recurring pairs, or
two of them around one pair that does not recur, go into the grammar. Everything works on arrays of a batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_batches, mix64

#: Candidates (a border and a period each) that are looked at together.
_TOGETHER = 1 << 20


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key its number among the different ones, how often each occurs, and where it does first."""
    _, first, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return number, count, first


def recurring_stretches(words: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """(begin, end) of the stretches of `words` that may hold runs of at least `least` words; text: each word's text, rising."""
    if len(words) < 2:
        return np.zeros((0, 2), dtype=np.int64)
    distinct = int(words.max()) + 1
    keys = (text[:-1].astype(np.int64) * distinct + words[:-1]) * distinct + words[1:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again &= text[1:] == text[:-1]
    begins = np.concatenate(([0], np.flatnonzero(~again) + 1))  # stretches of pairs that recur
    ends = np.append(begins[1:], len(words))
    half = (least + 1) // 2
    keep = ends - begins >= half
    begins, ends = begins[keep], ends[keep]
    if not len(begins):
        return np.zeros((0, 2), dtype=np.int64)
    apart = np.append(True, (begins[1:] != ends[:-1]) | (text[begins[1:]] != text[ends[:-1] - 1]))
    begins, ends = begins[apart], ends[np.append(apart[1:], True)]
    return np.stack((begins, ends), axis=1)[ends - begins >= least]


class Grammar:
    """A binary grammar of some stretches: symbols below `base` are words, the others have two halves and a length."""

    def __init__(self, words: np.ndarray, stretch: np.ndarray) -> None:
        """words: those of all stretches in a row; stretch: each word's, rising from 0 without gaps."""
        self.base = int(words.max()) + 1 if len(words) else 0
        self.left, self.right = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.length = np.ones(self.base, dtype=np.int64)
        self.place = np.full(self.base, -1, dtype=np.int64)  # of one occurrence of each symbol
        symbols, of, at = words.astype(np.int64), stretch, np.arange(len(words))
        symbols, of, at = self._repair(symbols, of, at)
        self.roots = self._halve(symbols, of, at)

    def _join(self, symbols: np.ndarray, of: np.ndarray, at: np.ndarray, chosen: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Replace the pairs that begin at the chosen places by new symbols, the same for the same number."""
        new, _, first = _numbered(number)
        pairs, size = chosen[first], len(self.length)
        a, b = symbols[pairs], symbols[pairs + 1]
        self.left, self.right = np.concatenate((self.left, a)), np.concatenate((self.right, b))
        self.length = np.concatenate((self.length, self.length[a] + self.length[b]))
        self.place = np.concatenate((self.place, at[pairs]))
        symbols = symbols.copy()
        symbols[chosen] = size + new
        keep = np.ones(len(symbols), dtype=bool)
        keep[chosen + 1] = False
        return symbols[keep], of[keep], at[keep]

    def _repair(self, symbols: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Re-Pair in rounds: pairs that occur most often go first, where they do not overlap with others at once.

        Frequencies count by powers of two, within which a hash decides, so that neighbouring pairs do not wait for each
        other in a long line and the rounds stay few.
        """
        while len(symbols) > 1:
            inside = np.flatnonzero(of[1:] == of[:-1])
            keys = symbols[inside] * len(self.length) + symbols[inside + 1]
            number, count, _ = _numbered(keys)
            if not len(count) or count.max() < 2:
                break
            again = count[number] > 1
            inside, number = inside[again], number[again]
            level = np.frexp(count.astype(np.float64))[1].astype(np.uint64) << np.uint64(56)
            rank = np.argsort(level | mix64(np.arange(1, len(count) + 1)) >> np.uint64(8))
            height = np.empty(len(count), dtype=np.int64)
            height[rank] = np.arange(1, len(count) + 1)
            high = height[number]
            # blocks of equal pairs in touching places, as in a a a a: every other one of a highest block is replaced
            touch = inside[1:] == inside[:-1] + 1
            starts = np.append(True, ~touch | (number[1:] != number[:-1]))
            block = np.cumsum(starts) - 1
            head = np.flatnonzero(starts)
            before = np.where(np.append(False, touch)[head], high[head - 1], 0)
            tail = np.append(head[1:], len(inside)) - 1
            after = np.where(np.append(touch, False)[tail], high[np.minimum(tail + 1, len(inside) - 1)], 0)
            top = (high[head] > before) & (high[head] > after)
            chosen = top[block] & ((np.arange(len(inside)) - head[block]) % 2 == 0)
            symbols, of, at = self._join(symbols, of, at, inside[chosen], number[chosen])
        return symbols, of, at

    def _halve(self, symbols: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Join neighbours two by two until one symbol is left of each stretch; these, in order."""
        while len(symbols) and (of[1:] == of[:-1]).any():
            head = np.append(True, of[1:] != of[:-1])
            within = np.arange(len(symbols)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            chosen = np.flatnonzero((within[:-1] % 2 == 0) & (of[1:] == of[:-1]))
            number, _, _ = _numbered(symbols[chosen] * len(self.length) + symbols[chosen + 1])
            symbols, of, at = self._join(symbols, of, at, chosen, number)
        return symbols


class _Extents:
    """How far two places of the stretches go on alike, by names of all stretches of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.names = [words]
        while 2 << (len(self.names) - 1) <= longest:
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= step:
                break
            keys = last[:-step] * (int(last.max()) + 1) + last[step:]
            self.names.append(np.unique(keys, return_inverse=True)[1].astype(np.int64))

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from places a and b on, at most `most`."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            got += self._step(k, a + got, b + got, most - got)
        return got

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before places a and b, at most `most`."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            size = 1 << k
            got += self._step(k, a - got - size, b - got - size, most - got)
        return got

    def _step(self, k: int, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """2^k where that many words agree from a and b on and there is room for them."""
        names, ok = self.names[k], room >= 1 << k
        last = len(names) - 1
        return np.where(ok & (names[np.clip(a, 0, last)] == names[np.clip(b, 0, last)]), 1 << k, 0)


def _crossing(words: np.ndarray, low: np.ndarray, cut: np.ndarray, high: np.ndarray, ext: _Extents, least: int) -> tuple[np.ndarray, ...]:
    """Runs inside low..high across each cut, with at least `least` words: index of the cut, begin, end, smallest period.

    Such a run holds q words before the cut or q behind it. In the first case the word behind the cut stands q words
    earlier too, in the second the word before it q words later, which names the periods to try.
    """
    found: list[tuple[np.ndarray, ...]] = []
    sizes = high - low
    at = 0
    total = np.cumsum(sizes)
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _TOGETHER, "right")))
        for side in (0, 1):
            some = np.arange(at, to)
            n = (cut - low if side == 0 else high - cut)[some]
            which = np.repeat(some, n)
            period = _ranges(n) + 1
            anchor = cut[which] - side  # the word behind or before the cut
            other = anchor - period if side == 0 else anchor + period
            ok = words[anchor] == words[other]
            which, period = which[ok], period[ok]
            here = cut[which]
            early, late = (here - period, here) if side == 0 else (here, here + period)
            # words i and i + period agree from early - back to early + forth
            back = ext.behind(early, late, early - low[which])
            forth = ext.ahead(early, late, high[which] - late)
            length = back + forth + period
            begin = early - back
            ok = (length >= np.maximum(least, 2 * period)) & (begin < here) & (late + forth > here)
            found.append((which[ok], begin[ok], (late + forth)[ok], period[ok]))
        at = to
    which, begin, end, period = (np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 4
    order = np.lexsort((period, end, begin, which))  # of multiples of a period, which have the same ends, the smallest
    which, begin, end, period = which[order], begin[order], end[order], period[order]
    first = np.append(True, (which[1:] != which[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))[: len(which)]
    return which[first], begin[first], end[first], period[first]


def find_runs(words: np.ndarray, text: np.ndarray, least: int = 12) -> np.ndarray:
    """(begin, end, smallest period) of all runs with at least max(least, 2 * period) words, by begin, then period.

    words: numbers of the words of several texts in a row; text: the number of each word's text, rising. No run crosses
    a text's end.
    """
    none = np.zeros((0, 3), dtype=np.int64)
    stretches = recurring_stretches(words, text, least)
    if not len(stretches):
        return none
    sizes = stretches[:, 1] - stretches[:, 0]
    of = np.repeat(np.arange(len(sizes)), sizes)
    origin = np.repeat(stretches[:, 0], sizes) + _ranges(sizes)
    _, held = np.unique(words[origin], return_inverse=True)
    grammar = Grammar(held, of)
    first = grammar.length[: grammar.base].size
    symbols = np.arange(first, len(grammar.length))
    symbols = symbols[grammar.length[symbols] >= least]
    if not len(symbols):
        return none
    low = grammar.place[symbols]
    cut = low + grammar.length[grammar.left[symbols - first]]
    ext = _Extents(held.astype(np.int64), int(sizes.max()))
    which, begin, end, period = _crossing(held, low, cut, low + grammar.length[symbols], ext, least)
    if not len(which):
        return none
    # runs by symbol, relative to its begin; symbols under which some run lies
    owner = symbols[which]
    begin, end = begin - low[which], end - low[which]
    order = np.argsort(owner, kind="stable")
    owner, begin, end, period = owner[order], begin[order], end[order], period[order]
    holds = np.zeros(len(grammar.length), dtype=bool)
    holds[owner] = True
    live = holds.copy()
    for s in symbols[np.argsort(grammar.length[symbols], kind="stable")].tolist():
        live[s] |= live[grammar.left[s - first]] or live[grammar.right[s - first]]
    # all derivation places of these symbols, from the texts' own symbols downwards
    ends = np.cumsum(sizes)
    node, at, runs = grammar.roots, ends - sizes, []
    limits = np.stack((ends - sizes, ends), axis=1)
    while len(node):
        keep = live[node]
        node, at = node[keep], at[keep]
        has = holds[node]
        a, b = np.searchsorted(owner, node[has]), np.searchsorted(owner, node[has], "right")
        k = np.repeat(a, b - a) + _ranges(b - a)
        base = np.repeat(at[has], b - a)
        runs.append(np.stack((base + begin[k], base + end[k], period[k]), axis=1))
        inner = node >= first
        node, at = node[inner], at[inner]
        left, right = grammar.left[node - first], grammar.right[node - first]
        node, at = np.concatenate((left, right)), np.concatenate((at, at + grammar.length[left]))
    found = np.concatenate(runs)
    # maximal intervals: a part of a longer run was found in a symbol that the longer one goes beyond
    inside, last = of[found[:, 0]], len(held) - 1
    go_back = (found[:, 0] > limits[inside, 0]) & (held[np.maximum(found[:, 0] - 1, 0)] == held[np.minimum(found[:, 0] - 1 + found[:, 2], last)])
    go_on = (found[:, 1] < limits[inside, 1]) & (held[np.minimum(found[:, 1], last)] == held[found[:, 1] - found[:, 2]])
    found = found[~go_back & ~go_on]
    found = np.stack((origin[found[:, 0]], origin[found[:, 1] - 1] + 1, found[:, 2]), axis=1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the number of each word of all texts, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = parts.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = np.ones(len(number), dtype=bool)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # before the first or behind the last word
        real = number != empty
    kept = np.concatenate(([0], np.cumsum(real)))
    return coded.dictionary, number[real], np.diff(kept[bounds])


def _run_batches(docs: DataFrame, least: int, schema: str, tell: Callable[[pa.Array, np.ndarray, list[np.ndarray], pa.Array], list[pa.Array]]) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            dictionary, number, sizes = _split(batch.column(1))
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            runs = find_runs(number, np.repeat(np.arange(len(sizes)), sizes), least)
            kept = np.zeros(len(number) + 1, dtype=np.int64)  # words within a run, behind its first period
            np.add.at(kept, runs[:, 0] + runs[:, 2], 1)
            np.add.at(kept, runs[:, 1], -1)
            stay = np.cumsum(kept[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(stay)))[bounds]
            lists = pa.LargeListArray.from_arrays(pa.array(left), dictionary.take(pa.array(number[stay])))
            texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            cuts = np.searchsorted(runs[:, 0], bounds)
            by_text = [runs[a:b] - [p, p, 0] for a, b, p in zip(cuts, cuts[1:], bounds, strict=False)]
            names = [c.split()[0] for c in schema.split("|")]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *tell(batch.column(1), sizes, by_text, texts)], names=names)

        return each

    return map_batches(docs.select("doc_id", "text"), make, schema.replace("|", ","))


def periodic_runs(docs: DataFrame, *, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period), text without the runs' repetitions.

    docs: doc_id, text; other columns are ignored, repeated rows give a row each. Words are what white space (blank and
    U+0009 to U+000D) divides, compared as they are. A run is a stretch of words with smallest period q and at least
    max(least, 2q) words that no neighbouring word extends. The text keeps, of each run, its first q words, and is joined
    by one blank; it is empty for a null or blank text, which has no runs. One pass, no shuffle.
    """

    def tell(_: pa.Array, sizes: np.ndarray, by_text: list[np.ndarray], texts: pa.Array) -> list[pa.Array]:
        every = np.concatenate(by_text) if by_text else np.zeros((0, 3), dtype=np.int64)
        parts = [pa.array(every[:, 0]), pa.array(every[:, 1] - every[:, 0]), pa.array(every[:, 2])]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in by_text]))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
        return [pa.array(sizes), runs, texts.cast(pa.string())]

    return _run_batches(docs, least, "doc_id long|n_words long|runs array<struct<start:long,length:long,period:long>>|text string", tell)


def run_digests(docs: DataFrame, *, least: int = 12) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (1000 * length / period, floored) of the longest run (ties: the
    smallest start, then period; nulls without a run), runs_sha256 (of `start,length,period` and a line feed for each run) and
    collapsed_sha256 (of the text that periodic_runs leaves); lower-case hex, never null."""

    def tell(_: pa.Array, sizes: np.ndarray, by_text: list[np.ndarray], texts: pa.Array) -> list[pa.Array]:
        longest, lines = [], []
        for runs in by_text:
            rows = [(a, b - a, q) for a, b, q in runs.tolist()]
            a, n, q = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else (None, None, None)
            longest.append((len(rows), a, n, q, 1000 * n // q if rows else None))
            lines.append(hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in rows).encode()).hexdigest())
        columns = [pa.array(c, pa.int64()) for c in zip(*longest, strict=True)] if longest else [pa.array([], pa.int64())] * 5
        left = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
        return [*columns, pa.array(lines, pa.string()), pa.array(left, pa.string())]

    schema = "doc_id long|n_runs long|start long|length long|period long|exponent_milli long|runs_sha256 string|collapsed_sha256 string"
    return _run_batches(docs, least, schema, tell)
