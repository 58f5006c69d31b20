"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

The automaton of all items accepts every run of words that occurs in one of them. A document's words stream through it;
after each word the automaton holds the longest run ending there that some item contains. Where that run reaches the
window length, the last `window` words are a window of the items that the state stands for. Items shorter than the
window count as one window of their own length.

Items with the same text are one, with several ids. The automaton is built from blocks of about `block_words` words of them
and broadcast; more items mean more blocks, each streamed over all documents in turn; findings of the blocks are united by row before anything is decided. Before the
automaton a vectorised test of neighbouring word pairs picks the runs of words that could hold a window at all; it never
rejects a run that does.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, map_batches, staged, words

_PAIR_BITS = 22
#: Words of items in one automaton, which the driver builds and each Python worker holds; README has its size.
BLOCK_WORDS = 1_000_000


class SuffixAutomaton:
    """Of several sequences of word numbers; state 0 is the empty run.

    Most states have one transition, which lies in two arrays (word, to); those of a state with several lie in a dictionary.
    """

    def __init__(self) -> None:
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.several: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def after(self, state: int, word: int) -> int:
        """The state one word further, or -1."""
        if self.word[state] == word:
            return self.to[state]
        return self.several[state].get(word, -1) if state in self.several else -1

    def add(self, sequence: list[int]) -> list[int]:
        """Take in a sequence; returns the state after each of its words."""
        last, states = 0, []
        for word in sequence:
            last = self._extend(last, word)
            states.append(last)
        return states

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.several.setdefault(state, {})[word] = to

    def _state(self, length: int, link: int, like: int | None = None) -> int:
        self.word.append(-1 if like is None else self.word[like])
        self.to.append(-1 if like is None else self.to[like])
        self.length.append(length)
        self.link.append(link)
        new = len(self.length) - 1
        if like in self.several:
            self.several[new] = dict(self.several[like])
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = copy
        while p >= 0 and self.after(p, word) == q:
            self._set(p, word, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.after(last, word)
        if q >= 0:  # another sequence has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and self.after(p, word) < 0:
            self._set(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self.after(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new


class ItemsOfStates:
    """Which items' windows end in a state: an item's place where there is one, a set where there are several."""

    def __init__(self, states: int) -> None:
        self.one, self.several = array("i", [-1]) * states, {}

    def put(self, state: int, items: Iterable[int]) -> None:
        for item in items:
            now = self.one[state]
            if now == -1:
                self.one[state] = item
            elif now == -2:
                self.several[state].add(item)
            elif now != item:
                self.one[state], self.several[state] = -2, {now, item}

    def get(self, state: int) -> Iterable[int]:
        now = self.one[state]
        return (now,) if now >= 0 else self.several[state] if now == -2 else ()


class ItemMatcher:
    """The automaton of some items, and which items' windows end in each state."""

    def __init__(self, items: list[tuple[tuple[str, ...], bytes | None]], window: int) -> None:
        """items: ids and text of each."""
        self.window, self.vocabulary = window, {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)  # noqa: E731  0: no item's word
        self.automaton, self.names = SuffixAutomaton(), [item for item, _ in items]
        ends, whole, sizes = (array("i"), array("i")), [], set()
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        for k, (_, text) in enumerate(items):
            s = [number(w) for w in words(text)]
            if not s:
                continue
            sizes.add(min(len(s), window))
            states = self.automaton.add(s)
            if len(s) < window:
                whole.append((k, s))
            else:
                ends[0].extend(states[window - 1 :])
                ends[1].extend([k] * (len(s) - window + 1))
            a = np.array(s, dtype=np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
        link, length = self.automaton.link, self.automaton.length
        rising = np.argsort(np.frombuffer(length, dtype=np.int32), kind="stable").tolist()
        self.items = ItemsOfStates(len(length))
        for state, k in zip(*ends, strict=True):  # a state's runs end wherever those of the states that link to it do
            self.items.put(state, (k,))
        for state in reversed(rising):
            if (up := link[state]) > 0 and length[up] >= window:
                self.items.put(up, self.items.get(state))
        #: Items shorter than the window, by the state in which their text ends: its length, and which items have it.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, s in whole:
            state = 0
            for w in s:
                state = self.automaton.after(state, w)
            self.short.setdefault(state, {}).setdefault(len(s), []).append(k)
        #: For each state, on its chain of links: the last one that holds a whole window, and the first in which a short
        #: item ends (0: none), so that no chain is walked while texts stream by.
        self.windowed, self.shorter = array("i", [0]) * len(length), array("i", [0]) * len(length)
        for state in rising[1:]:
            up = link[state]
            self.windowed[state] = self.windowed[up] if length[up] >= window else state
            self.shorter[state] = state if state in self.short else self.shorter[up]
        #: Words in a row that the shortest window of two words or more has.
        self.least = min((n for n in sizes if n > 1), default=window)
        self.single: dict[int, list[int]] = {}
        for k, s in whole:
            if len(s) == 1:
                self.single.setdefault(s[0], []).append(k)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 8_191) & ((1 << _PAIR_BITS) - 1)

    def _candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words [from, to) in which all neighbours may be an item's neighbours, long enough for a window."""
        if len(ids) < self.least:
            return []
        a, b = ids[:-1], ids[1:]
        good = (a > 0) & (b > 0)
        if np.count_nonzero(good) < self.least - 1:
            return []
        good &= self.pairs[self._pair(a, b)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.least - 1
        return [(int(s), int(e) + 1) for s, e in zip(starts[keep], ends[keep], strict=True)]

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged [from, to) of hit words, the items whose windows occur, and the longest run that an item contains."""
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), dtype=np.int64, count=len(tokens))
        spans, found, longest, told = [], set(), 0, set()
        if self.single:  # items of one word need no automaton
            for w in set(ids.tolist()) & self.single.keys():
                spans += [(k, k + 1) for k in np.flatnonzero(ids == w).tolist()]
                found.update(self.single[w])
                longest = 1
        a_, window = self.automaton, self.window
        word, to, several, link, length = a_.word, a_.to, a_.several, a_.link, a_.length
        windowed, shorter = self.windowed, self.shorter
        for a, b in self._candidates(ids):
            state = run = 0
            for k, w in enumerate(ids[a:b].tolist(), a + 1):  # k: words up to and with this one
                while True:
                    further = to[state] if word[state] == w else several[state].get(w, -1) if state in several else -1
                    if further >= 0 or not state:
                        break
                    state = link[state]
                    run = length[state]
                if further >= 0:
                    state = further
                    run += 1
                if run > longest:
                    longest = run
                if run >= window:
                    at = windowed[state]
                    if at in told:
                        spans.append((k - window, k))
                    elif hit := self.items.get(at):
                        told.add(at)
                        found.update(hit)
                        spans.append((k - window, k))
                at = shorter[state]
                while at:
                    for n, some in self.short[at].items():
                        if n <= run:
                            if (at, n) not in told:
                                told.add((at, n))
                                found.update(some)
                            spans.append((k - n, k))
                    at = shorter[link[at]]
        return merged(spans), {self.names[k] for k in found}, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; one blank takes a span's place."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]].rstrip(b" "))
        at = places[b - 1][1]
    return b" ".join([*out, text[at:].lstrip(b" ")])


def _distinct_items(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """text, ids, n_words: each different text with words once, with the ids of all rows that have it.

    A text of more than `block_words` words comes in pieces that share window - 1 words, so that no window is lost.
    """
    texts = items.filter("text is not null").groupBy("text").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[bytes, list[str], int]] = []
            for text, ids in zip(binary_column(batch, "text"), batch.column(1).to_pylist(), strict=True):
                found, most = words(text), max(block_words, 2 * window)
                if len(found) <= most:
                    out += [(text, ids, len(found))] if found else []
                    continue
                for at in range(0, len(found) - window + 1, most - window + 1):
                    piece = found[at : at + most]
                    out.append((b" ".join(piece), ids, len(piece)))
            texts, ids, n = ([r[k] for r in out] for k in range(3))
            return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()).cast(pa.string()), "ids": pa.array(ids, pa.list_(pa.string())), "n_words": pa.array(n, pa.int64())})

        return each

    return map_batches(texts, make, "text string, ids array<string>, n_words long")


def _block_count(items: DataFrame, block_words: int) -> int:
    """How many blocks of about `block_words` words the distinct items make."""
    size = items.agg(F.sum("n_words")).first()[0] or 0
    return max(1, -(-size // block_words))


def _block(items: DataFrame, n: int, k: int) -> list[tuple[tuple[str, ...], bytes]]:
    """Ids and text of the distinct items of block k of n; only one block at a time is on the driver as it is built."""
    rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select("ids", "text").collect()
    return [(tuple(r[0]), r[1].encode()) for r in rows]


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (ids with occurring windows), spans (hit words, merged), longest.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts have no words and no
    hits. Repeated rows are answered each. Without items nothing is hit. An item without an id hits words, but is not among
    the items. `longest` counts at most the words of a block.
    """
    if window < 1:
        raise ValueError("window must be positive")
    items = staged(_distinct_items(items, window, block_words), "contamination-items")
    n = _block_count(items, block_words)
    source = docs.select("doc_id", "text")
    if n == 1:
        return _one_block(source, docs.sparkSession.sparkContext.broadcast(ItemMatcher(_block(items, 1, 0), window)))
    rows = staged(source.withColumn("key", F.monotonically_increasing_id()), "contamination-rows")  # stored, so that the keys stay
    found = _all_blocks(rows.select("key", "text"), items, n, window)
    return rows.select("key", "doc_id").join(found, "key").select("doc_id", "n_words", "n_hit", "items", "spans", "longest")


def _all_blocks(rows: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """key and the findings of all blocks together, for each row of (key, text)."""
    found = None
    for k in range(n):
        shared = rows.sparkSession.sparkContext.broadcast(ItemMatcher(_block(items, n, k), window))
        one = staged(_one_block(rows.withColumnRenamed("key", "doc_id"), shared), "contamination-block")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy(F.col("doc_id").alias("key")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.max("longest").alias("longest"),
    )
    found = found.withColumn("spans", _merge("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select("key", "n_words", hit.alias("n_hit"), "items", "spans", "longest")


def _merge(column: str) -> Column:
    """Sorted spans without overlaps."""
    empty = F.array().cast("array<struct<from:long,to:long>>")
    return F.aggregate(
        column,
        empty,
        lambda out, s: F.when((F.size(out) == 0) | (F.try_element_at(out, F.lit(-1))["to"] < s["from"]), F.concat(out, F.array(s))).otherwise(
            F.concat(
                F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(out, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(out, F.lit(-1))["to"], s["to"]).alias("to"))),
            )
        ),
    )


def _one_block(source: DataFrame, shared) -> DataFrame:
    def make():
        matcher = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: [] for k in ("n_words", "n_hit", "items", "spans", "longest")}
            for text in binary_column(batch, "text"):
                tokens = words(text)
                spans, items, longest = matcher.match(tokens)
                out["n_words"].append(len(tokens))
                out["n_hit"].append(sum(b - a for a, b in spans))
                out["items"].append(sorted({i for ids in items for i in ids}))
                out["spans"].append([{"from": a, "to": b} for a, b in spans])
                out["longest"].append(longest)
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": span, "longest": pa.int64()}
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

        return each

    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<from:long,to:long>>, longest long"
    return map_batches(source, make, schema)


def contamination_digest(docs: DataFrame, items: DataFrame, *, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = find_contamination(docs, items, window=window)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_span: int = 9, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without benchmark passages; columns and untouched rows stay as they are.

    Hit spans of more than `max_span` words are cut out of the text (n_chars, where present, follows); a document of
    whose words more than `max_coverage` are hit is dropped. Null and empty texts stay. Both are decided on the hits of
    all items together, however many blocks these make.
    """
    items = staged(_distinct_items(items, window, block_words), "contamination-items")
    n, names = _block_count(items, block_words), docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(ItemMatcher(_block(items, 1, 0), window))
        return _cut(docs, shared, None, schema, names, max_span, max_coverage)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    rows = staged(rows, "decontamination")  # stored, so that the keys stay
    found = _all_blocks(rows.select("key", F.col("row.text").alias("text")), items, n, window).filter("n_hit > 0").select("key", "spans")
    hits = "spans"
    while hits in {c.lower() for c in names}:
        hits += "_"
    rows = rows.join(found, "key", "left").select("row.*", F.col("spans").alias(hits))
    return _cut(rows, None, hits, schema, names, max_span, max_coverage)


def _cut(docs: DataFrame, shared, hits: str | None, schema: str, names: list[str], max_span: int, max_coverage: float) -> DataFrame:
    """Drop and cut by the spans that the shared matcher finds, or by those in the column `hits`."""

    def make():
        matcher = shared.value if shared is not None else None

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, keep = binary_column(batch, "text"), []
            given = None if hits is None else batch.column(batch.schema.get_field_index(hits)).to_pylist()
            for k, text in enumerate(texts):
                tokens = words(text)
                spans = matcher.match(tokens)[0] if given is None else [(s["from"], s["to"]) for s in given[k] or ()]
                stays = sum(b - a for a, b in spans) <= max_coverage * len(tokens)
                keep.append(stays)
                spans = [(a, b) for a, b in spans if b - a > max_span]
                if stays and spans:
                    texts[k] = without_spans(text, spans)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            new = pa.array(texts, pa.binary()).cast(columns["text"].type)
            if "n_chars" in columns:
                import pyarrow.compute as pc

                changed = pc.fill_null(pc.not_equal(new, columns["text"]), False)
                columns["n_chars"] = pc.if_else(changed, pc.utf8_length(new).cast(columns["n_chars"].type), columns["n_chars"])
            columns["text"] = new
            return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(pa.array(keep))

        return each

    return map_batches(docs, make, schema)
