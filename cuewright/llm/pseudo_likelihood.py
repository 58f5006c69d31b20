"""Masked pseudo-likelihood scores by a bidirectional window network trained in numpy.

Every word is predicted from the two words on either side of it: each neighbour has an embedding for its distance and
their sum goes through tanh. The output is factored in three. The corpus's most frequent words are classes of their own,
all others fall into some classes by checksum; classes of like frequency form groups. A softmax over the groups is
followed by one over the classes of a group, and a word's share of its class comes from the counts of the whole corpus.
So every word has a probability of its own, and those of all words add up to one.

1. The words of all rows are counted.
2. Each text is numbered once: two bytes for each word, stored. Words up to a bounded number carry their shares along; the
   occurrences of the others are joined with the stored counts.
3. Training reads the numbers of all rows, each in one of the rounds. A round deals its rows to replicas by a hash, as
   many as its words call for; each trains a copy in the order of the hash, and the copies' mean, weighted by their
   words, begins the next round. Neither depends on how the input is partitioned.
4. Scoring reads the numbers once more. A score is the sum of a document's conditional log-probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, map_batches, one_thread, staged, word_runs, words
from .tokens import text_slices

SIDE = 2
#: Parameters in one row of what a replica hands on.
_PART = 4096


def count_words(docs: DataFrame, keep: int = 400_000) -> DataFrame:
    """word, n over all rows; a task hands on its counts whenever it holds `keep` different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        counts: Counter = Counter()
        for batch in batches:
            for text in binary_column(batch, "text"):
                for run_ in word_runs(text):
                    counts.update(words(run_))
                if len(counts) > keep:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    one_thread(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class_of_other(classes: int) -> Column:
    """The class of a word that is none of the frequent ones, counted from the first such class."""
    return F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(classes))


def most_common(counted: DataFrame, most: int) -> list[tuple[str, int]]:
    """Words with their counts: all those above a count that no more than `most` words reach."""
    level = F.floor(F.log2("n") * 32)
    sizes = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 32 rows a doubling
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return [] if least is None else [(r["word"], r["n"]) for r in counted.filter(level >= least).collect()]


def class_totals(counted: DataFrame, frequent: list[str], classes: int) -> np.ndarray:
    """How often words of each class, other than the frequent ones, stand in the corpus."""
    own = counted.sparkSession.createDataFrame([(w,) for w in frequent], "word string")
    found = counted.join(F.broadcast(own), "word", "left_anti").groupBy(_class_of_other(classes).alias("class")).agg(F.sum("n").alias("total"))
    total = np.zeros(classes)
    for r in found.collect():  # a row for each class
        total[r["class"]] = r["total"]
    return total


class Vocabulary:
    """Numbers of words: 0 .. len(frequent)-1, then `classes` numbers for all other words; the last stands for no word.

    `common` has some of the other words with the logarithms of their shares.
    """

    def __init__(self, frequent: list[str], classes: int, common: list[tuple[str, float]] = ()) -> None:
        self.first, self.classes = len(frequent), classes
        self.none = self.first + classes
        known = [*(w.encode() for w in frequent), *(w.encode() for w, _ in common)]
        self.places = {w: k for k, w in enumerate(known)}
        others = [self.first + zlib.crc32(w) % classes for w in known[self.first :]]
        self.ids = np.array([*range(self.first), *others, self.none], dtype=np.uint16)
        self.shares = np.array([*[0.0] * self.first, *(share for _, share in common), 0.0])

    def numbered(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """All texts' numbers in one array, the number of words of each text, the sum of each one's known shares, the words
        without known shares, and how many of these each text has."""
        runs = [list(word_runs(t)) for t in texts]
        lists = [words(r) for rs in runs for r in rs]
        tokens = list(chain.from_iterable(lists))
        ends = np.cumsum([sum(len(words_) for words_ in lists[a:b]) for a, b in _bounds(runs)], dtype=np.int64)
        sizes = np.diff(ends, prepend=0)
        places = np.fromiter(map(self.places.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        ids = self.ids[places]
        other = np.flatnonzero(places < 0)
        rare = [tokens[k] for k in other.tolist()]
        ids[other] = [self.first + zlib.crc32(w) % self.classes for w in rare]
        known, full = np.zeros(len(texts)), np.flatnonzero(sizes)
        if len(full):
            known[full] = np.add.reduceat(self.shares[places], (ends - sizes)[full])
        return ids, sizes, known, rare, np.diff(np.searchsorted(other, ends), prepend=0)


def _bounds(runs: list[list]) -> Iterator[tuple[int, int]]:
    at = 0
    for rs in runs:
        yield at, at + len(rs)
        at += len(rs)


def windows(ids: np.ndarray, sizes: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words and, by rows, their 2 * SIDE neighbours in the text; `none` where there is no word."""
    row = np.full(len(ids) + SIDE * (len(sizes) + 1), none, dtype=np.uint16)
    at = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    row[at] = ids
    return ids, np.stack([row[at + k] for k in range(-SIDE, SIDE + 1) if k]).T


class WindowNetwork:
    """Embeddings E (position, number, width); softmax over groups (U, b) and over the classes of each (V, c); one flat array."""

    def __init__(self, size: int, width: int, flat: np.ndarray | None = None, seed: int = 11) -> None:
        self.size, self.width = size, width
        self.inner = inner = ceil(size**0.5)
        self.groups = groups = -(-size // inner)
        shapes = [(2 * SIDE, size + 1, width), (width, groups), (groups,), (groups, width, inner), (groups, inner)]
        cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.1, b - a) if len(s) > 1 + (k == 4) else np.zeros(b - a) for k, (s, a, b) in enumerate(zip(shapes, cuts[:-1], cuts[1:], strict=True))])
        self.flat = flat.astype(np.float32)
        self.shapes, self.cuts = shapes, cuts
        self.E, self.U, self.b, self.V, self.c = self._views(self.flat)
        self.square = np.full_like(self.flat, 1e-4)
        self.limit = np.float32(80 / (width + 1))  # hidden values are within 1, so logits are within 80

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[a:b].reshape(s) for s, a, b in zip(self.shapes, self.cuts[:-1], self.cuts[1:], strict=True)]

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.E[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            h += self.E[k].take(around[:, k], axis=0)
        return np.tanh(h, out=h)

    def _by_group(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of the targets by group; then each one's group, place within it, and (group, classes, from, to)."""
        group, inside = np.divmod(targets, targets.dtype.type(self.inner))
        order = np.argsort(group, kind="stable")
        group, inside = group[order], inside[order]
        first = np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1))
        spans = zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=True)
        return order, group, inside, [(g := int(group[a]), min(self.inner, self.size - g * self.inner), a, b) for a, b in spans]

    def log_probabilities(self, targets: np.ndarray, around: np.ndarray, batch: int = 8192) -> np.ndarray:
        out = np.empty(len(targets))
        for at in range(0, len(targets), batch):
            order, group, inside, spans = self._by_group(targets[at : at + batch])
            h = self._hidden(around[at : at + batch][order])
            found = self._log_share(h @ self.U + self.b, group)
            for g, m, a, b in spans:
                found[a:b] += self._log_share(h[a:b] @ self.V[g, :, :m] + self.c[g, :m], inside[a:b])
            out[at + order] = found
        return out

    @staticmethod
    def _log_share(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The logarithm of the softmax of z at what was chosen."""
        found = z[np.arange(len(z)), chosen]
        return found - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], dtype=z.dtype))

    def train(self, targets: np.ndarray, around: np.ndarray, rate: float, batch: int = 4096) -> None:
        """One pass of adaptive gradient steps over the words in their order."""
        grad = np.empty_like(self.flat)
        dE, dU, db, dV, dc = self._views(grad)
        for at in range(0, len(targets), batch):
            order, group, inside, spans = self._by_group(targets[at : at + batch])
            around_ = around[at : at + batch][order]
            n = len(order)
            grad[:] = 0
            h = self._hidden(around_)
            p = self._error(h @ self.U + self.b, group, n)
            dU[:], db[:] = h.T @ p, p.sum(axis=0)
            dh = p @ self.U.T
            for g, m, a, b in spans:
                p = self._error(h[a:b] @ self.V[g, :, :m] + self.c[g, :m], inside[a:b], n)
                dV[g, :, :m], dc[g, :m] = h[a:b].T @ p, p.sum(axis=0)
                dh[a:b] += p @ self.V[g, :, :m].T
            dh *= 1 - h * h
            for k in range(2 * SIDE):
                sort = np.argsort(around_[:, k], kind="stable")
                w = around_[sort, k]
                first = np.flatnonzero(np.diff(w.astype(np.int64), prepend=-1))
                dE[k][w[first]] = np.add.reduceat(dh[sort], first, axis=0)
            self.square += grad * grad
            self.flat -= rate * grad / np.sqrt(self.square)
            np.clip(self.flat, -self.limit, self.limit, out=self.flat)

    @staticmethod
    def _error(z: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
        """Softmax of z less one at what was chosen, divided by n; the bounds on parameters keep exp(z) finite."""
        np.exp(z, out=z)
        z *= (1 / (n * (z @ np.ones(z.shape[1], dtype=z.dtype))))[:, None]
        z[np.arange(len(z)), chosen] -= np.float32(1 / n)
        return z


def _column_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a batch's column ids, and how many each row has."""
    column = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    ids = np.frombuffer(data, dtype=np.uint8, count=ends[-1])[ends[0] :].view("<u2") if data is not None and ends[-1] > ends[0] else np.zeros(0, dtype=np.uint16)
    return ids, np.diff(ends) // 2


def train_network(rows: DataFrame, total: int, size: int, *, width: int, rounds: int, rate: float, replica_words: int = 1_000_000, most_replicas: int = 4_096) -> np.ndarray:
    """The network's parameters, trained on the numbers (doc_id, ids) of all rows, which hold `total` words.

    A replica has about `replica_words` words of a round, or more where `most_replicas` would not do. Rows that repeat
    under one doc_id are dealt to one replica.
    """
    spark, flat = rows.sparkSession, WindowNetwork(size, width).flat
    one_thread(spark)
    replicas = max(1, min(most_replicas, ceil(total / rounds / replica_words)))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            net, seen = WindowNetwork(size, width, shared.value.copy()), 0
            for batch in batches:
                for part in text_slices(batch, "ids", 2 << 20):
                    targets, around = windows(*_column_ids(part), size)
                    net.train(targets, around, rate)
                    seen += len(targets)
            if seen:
                raws = [net.flat[a : a + _PART].tobytes() for a in range(0, len(net.flat), _PART)]
                yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(raws)), pa.int32()), "seen": pa.array([seen] * len(raws), pa.int64()), "raw": pa.array(raws, pa.binary())})

        def mean(table: pa.Table) -> pa.Table:
            pairs = sorted(zip(table.column("raw").to_pylist(), table.column("seen").to_pylist(), strict=True))  # the order of sums is fixed
            sums = sum(np.frombuffer(raw, dtype=np.float32).astype(np.float64) * n for raw, n in pairs) / sum(n for _, n in pairs)
            return pa.table({"part": table.column("part").slice(0, 1), "raw": pa.array([sums.astype(np.float32).tobytes()], pa.binary())})

        deal = F.xxhash64("doc_id", "ids")
        dealt = rows.filter(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == k).select(deal.alias("deal"), "ids").repartition(replicas, "deal").sortWithinPartitions("deal")
        copies = dealt.select("ids").mapInArrow(run, "part int, seen long, raw binary")
        parts = copies.groupBy("part").applyInArrow(mean, "part int, raw binary").collect()  # as large as the network
        if parts:
            flat = np.frombuffer(b"".join(r["raw"] for r in sorted(parts, key=lambda r: r["part"])), dtype=np.float32)
        shared.unpersist()
    return flat


def _numbered(docs: DataFrame, shared) -> DataFrame:
    """key, doc_id, n_words, ids, known, rare of each row; stored, so that the keys stay."""

    def make():
        vocabulary = Vocabulary(*shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes, known, rare, rares = vocabulary.numbered(binary_column(batch, "text"))
            raw = pa.py_buffer(ids.astype("<u2").tobytes())
            ends = pa.py_buffer(np.concatenate(([0], 2 * np.cumsum(sizes))).astype(np.int32).tobytes())
            left = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rares))), pa.int32()), pa.array([w.decode("utf-8", "replace") for w in rare], pa.string()))
            return pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_words": pa.array(sizes, pa.int64()), "ids": pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, raw]), "known": pa.array(known), "rare": left}
            )

        return each

    rows = map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_words long, ids binary, known double, rare array<string>")
    return staged(rows.withColumn("key", F.monotonically_increasing_id()), "numbered-words")


def pseudo_likelihood(docs: DataFrame, *, frequent: int = 768, classes: int = 256, width: int = 24, rounds: int = 2, rate: float = 0.05, common: int = 200_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, log_likelihood (the sum), mean_log_likelihood, perplexity.

    Null and empty texts have no words, a sum of 0 and null means; a null doc_id is scored like any other; repeated rows
    are scored each; other columns are ignored; very long texts are numbered run by run; an empty table gives no rows.
    How many `common` words are broadcast changes the work but not the scores. frequent + classes must stay below 65 536.
    """
    if frequent + classes >= 1 << 16:
        raise ValueError("frequent + classes must stay below 65 536")
    spark, size = docs.sparkSession, frequent + classes
    counted = staged(count_words(docs), "word-counts")
    own = [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(frequent).collect()]
    totals = class_totals(counted, own, classes)
    own += [f"\x00{k}" for k in range(frequent - len(own))]  # so few words: numbers that no word takes
    taken = set(own)
    known = [(w, float(np.log(n / totals[zlib.crc32(w.encode()) % classes]))) for w, n in most_common(counted, common) if w not in taken]
    shared = spark.sparkContext.broadcast((own, classes, known))
    rows = _numbered(docs, shared)
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    flat = train_network(rows.select("doc_id", "ids"), total, size, width=width, rounds=rounds, rate=rate)
    net_of = spark.sparkContext.broadcast(flat)

    def make():
        net = WindowNetwork(size, width, net_of.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes = _column_ids(batch)
            found, sums, full = net.log_probabilities(*windows(ids, sizes, size)), np.zeros(len(sizes)), np.flatnonzero(sizes)
            if len(full):
                sums[full] = np.add.reduceat(found, (np.cumsum(sizes) - sizes)[full])
            return pa.RecordBatch.from_pydict({n: batch.column(k) for k, n in enumerate(("key", "doc_id", "n_words", "known"))} | {"classes": pa.array(sums)})

        return each

    scored = map_batches(rows.select("key", "doc_id", "n_words", "known", "ids"), make, "key long, doc_id long, n_words long, known double, classes double", lambda b: text_slices(b, "ids", 2 << 20))
    of_class = spark.createDataFrame([(k, float(np.log(t))) for k, t in enumerate(totals) if t], "class long, log_total double")
    rest = rows.select("key", F.explode("rare").alias("word")).join(counted, "word").withColumn("class", _class_of_other(classes)).join(F.broadcast(of_class), "class")
    rest = rest.groupBy("key").agg(F.sum(F.log("n") - F.col("log_total")).alias("rest"))
    rows = scored.join(rest, "key", "left")
    rows = rows.select("doc_id", "n_words", (F.col("classes") + F.col("known") + F.coalesce("rest", F.lit(0.0))).alias("log_likelihood"))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return rows.withColumn("mean_log_likelihood", mean).withColumn("perplexity", F.exp(-F.col("mean_log_likelihood")))
