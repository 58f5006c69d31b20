"""Near-duplicate documents by MinHash bands, sequential Bayesian verification and exact confirmation.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets form one class. The
classes' MinHash signatures are cut into bands; classes that share a band are candidates (linkage.py): first with a bucket's ends,
then, where its members are still in several components, with its medoids, and at last with one another. A candidate's
signatures are compared batch by batch: after n positions with m matches the similarity has the posterior Beta(m+1,
n-m+1), and the pair is pruned once the chance of its reaching the threshold falls below `miss`. Survivors are confirmed
on their full sets. With the defaults a pair at the threshold shares no band with probability 3e-6.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, map_batches, mix64, small_batches, staged
from .linkage import by_blocks, connected_components, moved_nodes, own_nodes, small_side, star_pairs, unsettled

BANDS, BAND_ROWS, BATCH = 32, 5, 32
_RNG = np.random.default_rng(20_111)
_POSITIONS = 64
_BYTES = _RNG.integers(0, 2**64, size=_POSITIONS * 256, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**64, size=BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_TERMS = _RNG.integers(0, 2**64, size=BANDS * BAND_ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[ \t-\r]")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


#: Longer texts are cut into shingles run by run.
_LONG = 1 << 20


def _runs(text: bytes, size: int) -> list[bytes]:
    """A text's runs of about _LONG bytes, each behind the last size - 1 words of the one before: all its shingles, none new."""
    out, at, head = [], 0, b""
    while at < len(text):
        end = _SPACE.search(text, at + _LONG)
        end = end.start() if end else len(text)
        run = head + b" " + text[at:end]
        if end < len(text) and len(run.split(None, size)) <= size:  # too few words for a shingle: go on with the next run
            head, at = run, end
            continue
        out.append(run)
        head = b" ".join(run.rsplit(None, size - 1)[1:]) if size > 1 else b""
        at = end
    if len(out) > 1 and len(out[-1].split(None, size - 1)) < size:  # nothing but blanks behind the head
        out.pop()
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return small_batches(batch, limit=_LONG)


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `size` white-space separated words, A-Z lower-cased.

    A text of fewer words, but not none, is one shingle; no words or null: an empty set.
    """
    long = {k: _runs(t, size) for k, t in enumerate(texts) if t is not None and len(t) > _LONG}
    if not long:
        return _shingle_sets(texts, size)
    found = _shingle_sets([None if k in long else t for k, t in enumerate(texts)], size)
    for k, runs in long.items():
        whole = np.zeros(0, dtype=np.uint64)
        for run in runs:
            whole = np.union1d(whole, _shingle_sets([run], size)[0])
        found[k] = whole
    return found


def _shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    raw = [(t or b"").lower() for t in texts]
    buffer = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    empty = np.zeros(0, dtype=np.uint64)
    if not len(buffer):
        return [empty for _ in raw]
    solid = ~_BLANK[buffer]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return [empty for _ in raw]
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    values = _BYTES[(place % _POSITIONS) * 256 + buffer[solid]]
    if lengths.max() > _POSITIONS:
        values = values * (2 * (place // _POSITIONS) + 1).astype(np.uint64)
    word = mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP)
    chain = word[: len(word) - size + 1].copy() if len(word) >= size else empty
    for k in range(1, size):
        if len(chain):
            chain = mix64(chain * _STEP + word[k : k + len(chain)])
    sizes = np.array([len(r) + 1 for r in raw])
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(chain[a : b - size + 1]))
        elif b > a:
            h = word[a : a + 1]
            for k in range(a + 1, b):
                h = mix64(h * _STEP + word[k : k + 1])
            out.append(mix64(h + np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values (the upper 32 bits) of a set."""
    out = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _FACTORS + _TERMS
        out = np.minimum(out, (x.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return out


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def node_of(key: bytes, bits: int = 64, moved: dict[bytes, int] | None = None) -> int:
    """The first bits of a set's key; or the node it was moved to, as another set has these bits."""
    if moved and key in moved:
        return moved[key]
    node = int.from_bytes(key[:8], "little", signed=True)
    return node if bits == 64 else node % (1 << bits)


def _signatures(docs: DataFrame, size: int, bits: int) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(binary_column(batch, "text"), size)
            keys = [set_key(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "text_hash": batch.column(2),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([None if k is None else node_of(k, bits) for k in keys], pa.int64()),
                    "key": pa.array(keys, pa.binary()),
                    "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

        return each

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_batches(rows, make, "doc_id long, text_hash long, n_shingles long, node long, key binary, sig binary", _slices)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    parts = sig.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(BAND_ROWS):
        h = mix64(h * _STEP + parts[:, :, k])
    return h.view(np.int64)


def _bands(classes: DataFrame) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
            return pa.RecordBatch.from_pydict({"bucket": pa.array(band_keys(_matrix(batch.column(1))).ravel()), "node": pa.array(nodes)})

        return each

    return map_batches(classes.select("node", "sig"), make, "bucket long, node long")


def fewest_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * BAND_ROWS) -> list[tuple[int, int]]:
    """(n, m): after n positions, fewer than m matches make a similarity of the threshold or more unlikelier than miss.

    The chance that Beta(m+1, n-m+1) exceeds t is that of at most m successes in n+1 trials of chance t.
    """
    out = []
    for n in range(batch, total + 1, batch):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survives(x: np.ndarray, y: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Row numbers of the signature pairs that no batch prunes."""
    left, matches, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
    for n, m in least:
        matches += np.count_nonzero(x[left, at:n] == y[left, at:n], axis=1)
        keep = matches >= m
        left, matches, at = left[keep], matches[keep], n
    return left


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, BANDS * BAND_ROWS)


def _pruned(pairs: DataFrame, classes: DataFrame, least: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b) that sequential comparison of their signatures does not prune."""
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-ends")
    sigs = staged(classes.select("node", "sig").join(small_side(ends), "node", "left_semi"), "pair-signatures")
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = survives(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
            return batch.select(["a", "b"]).take(pa.array(keep))

        return each

    return map_batches(both.select("a", "b", "x", "y"), make, "a long, b long")


class _Corpus:
    """The documents, the classes of equal sets, and what tells a set's node."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, bits: int, moved: dict[bytes, int]) -> None:
        self.docs, self.classes, self.size, self.bits, self.moved = docs, classes, size, bits, moved

    def sets(self, ends: DataFrame) -> DataFrame:
        """node, hashes: the full sets of the given nodes, from the texts of their classes' first documents."""
        reps = staged(self.classes.join(small_side(ends), "node", "left_semi").select(F.col("rep").alias("id")).distinct(), "documents-of-nodes")
        size, bits, moved = self.size, self.bits, self.moved

        def make():
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                sets = [s for s in shingle_sets(binary_column(batch, "text"), size) if len(s)]
                nodes = [node_of(set_key(s), bits, moved) for s in sets]
                return pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})

            return each

        texts = self.docs.select("doc_id", "text").join(small_side(reps), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        return map_batches(texts.select("text"), make, "node long, hashes binary", _slices).dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, corpus: _Corpus, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "survivor-ends")
    sets = corpus.sets(ends)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")

    def make_check():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return each

    return staged(map_batches(both.select("a", "b", "x", "y"), make_check, "a long, b long"), "confirmed-links")


def _first_shared_band(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).reshape(-1, BANDS, BAND_ROWS).all(axis=2).argmax(axis=1)


def _medoids(sig: np.ndarray, count: int) -> np.ndarray:
    """The rows that agree most with the most frequent value at each position: what mutated copies have in common."""
    score = np.zeros(len(sig), dtype=np.int64)
    for column in sig.T:
        values, at, times = np.unique(column, return_inverse=True, return_counts=True)
        score += at == times.argmax()
    return np.argsort(-score, kind="stable")[:count]


def _with_medoids(open_: DataFrame, classes: DataFrame, least: list[tuple[int, int]], centres: int, block: int, fewest: int = 16) -> DataFrame:
    """Surviving pairs across components of larger open buckets' medoids with the rest: linear in a bucket's size."""
    open_ = open_.filter(F.col("n") >= fewest)
    ends = staged(open_.select("node").distinct(), "unsettled-nodes")
    rows = open_.join(classes.select("node", "sig").join(small_side(ends), "node", "left_semi"), "node")

    def compare(table: pa.Table) -> pa.Table:
        nodes, comps = table.column("node").to_numpy(), table.column("component").to_numpy()
        a, b = [], []
        if table.column("_i")[0].as_py() == table.column("_j")[0].as_py():
            sig = _matrix(table.column("sig"))
            for k in _medoids(sig, centres):
                other = np.flatnonzero(comps != comps[k])
                other = other[survives(np.broadcast_to(sig[k], (len(other), sig.shape[1])), sig[other], least)]
                a += np.minimum(nodes[k], nodes[other]).tolist()
                b += np.maximum(nodes[k], nodes[other]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return staged(by_blocks(rows, "bucket", F.ceil(F.col("n") / block), compare, "a long, b long").distinct(), "medoid-pairs")


def _across(open_: DataFrame, corpus: _Corpus, least: list[tuple[int, int]], percent: int, block: int, limit: int = 16 << 20) -> DataFrame:
    """Links across components within open buckets: every pair is compared in its first shared bucket, by signature and
    then on full sets, unless links found in the same task already join its components. Pairs with a bucket's ends have
    been verified before. A block has about `block` members, and about `limit` bytes of their sets at most."""
    ends = staged(open_.select("node").distinct(), "unsettled-nodes")
    held = staged(corpus.classes.select("node", "sig", "n_shingles").join(small_side(ends), "node", "left_semi"), "unsettled-signatures")
    weights = open_.select("bucket", "node").join(held.select("node", "n_shingles"), "node").groupBy("bucket").agg(F.sum(F.col("n_shingles") * 8).alias("bytes"))
    weights = staged(weights, "bucket-weights")
    rows = open_.join(held.drop("n_shingles").join(corpus.sets(ends), "node"), "node").join(small_side(weights), "bucket")

    def compare(table: pa.Table) -> pa.Table:
        nodes, comps = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
        own, sig = table.column("_block").to_numpy(), _matrix(table.column("sig"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        tested = (nodes == table.column("lo").to_numpy()) | (nodes == table.column("hi").to_numpy())
        band = int(np.flatnonzero(band_keys(sig[:1])[0] == table.column("bucket")[0].as_py())[0])
        same = table.column("_i")[0].as_py() == table.column("_j")[0].as_py()
        place, a, b = np.arange(len(nodes)), [], []
        for k in np.flatnonzero(~tested):
            near = 100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k])
            other = np.flatnonzero((comps != comps[k]) & ~tested & near & (place > k if same else own > own[k]))
            if not len(other):
                continue
            other = other[survives(np.broadcast_to(sig[k], (len(other), sig.shape[1])), sig[other], least)]
            other = other[_first_shared_band(sig[k][None], sig[other]) == band]
            if not len(other):
                continue
            every = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[k], every), len(sets[k]) - 1)
            common = np.add.reduceat((sets[k][at] == every).astype(np.int64), np.cumsum(sizes[other]) - sizes[other])
            for j in other[100 * common >= percent * (sizes[other] + sizes[k] - common)]:
                if comps[j] != comps[k]:
                    a.append(min(nodes[k], nodes[j]))
                    b.append(max(nodes[k], nodes[j]))
                    comps[comps == comps[j]] = comps[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / limit))
    return staged(by_blocks(rows, "bucket", blocks, compare, "a long, b long").distinct(), "links-across")


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, miss: float = 1e-7, block: int = 2048, bits: int = 64) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    docs: doc_id, text; other columns are ignored. Rows with equal sets are linked; null, empty and blank texts have
    empty sets, link with nothing and are kept. A row with a null doc_id takes part; its component_id is null only if no
    row of its component has an id, and only then it is kept. Repeated rows are answered each. An empty table gives no
    rows. percent: links need 100 * intersection >= percent * union. Sets are told apart by keys of 128 bits; `bits` of
    them number the sets, and sets that share a number are given numbers of their own.
    """
    rows = _by_row(docs, shingle_words, percent, miss, block, bits).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _by_row(docs: DataFrame, shingle_words: int, percent: int, miss: float = 1e-7, block: int = 2048, bits: int = 64) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (of the row's set, null for an empty one), component (of nodes), component_id."""
    if not 80 <= percent <= 100:
        raise ValueError("the bands are laid out for thresholds from 80 to 100 percent")
    least = fewest_matches(percent / 100, miss)
    sigs = staged(_signatures(docs, shingle_words, bits), "signatures")
    found = F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")
    classes = staged(sigs.filter("node is not null").groupBy("node", "key").agg(*found), "classes")
    moved = moved_nodes(classes)
    sigs, classes = own_nodes(sigs, moved), own_nodes(classes, moved)
    corpus = _Corpus(docs, classes, shingle_words, bits, moved)
    shared, pairs = star_pairs(_bands(classes))
    links = _confirmed(staged(_pruned(pairs, classes, least), "surviving-pairs"), corpus, percent)
    components = staged(connected_components(links), "components-of-stars")
    for last in (False, True):
        open_ = unsettled(shared, components)
        if open_.isEmpty():
            break
        if last:
            more = _across(open_, corpus, least, percent, block)
        else:
            more = _confirmed(_with_medoids(open_, classes, least, 4, 8 * block), corpus, percent)
        if not more.isEmpty():
            links = staged(links.unionByName(more), "links")
            components = staged(connected_components(links), "components")
    ids = classes.select("node", "rep").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = ids.join(smallest, "component").select("node", "component", "component_id")
    solid, blank = sigs.filter("node is not null").drop("sig", "key"), sigs.filter("node is null").drop("sig", "key")
    columns = "doc_id", "text_hash", "n_shingles", "node", "component", "component_id"
    blank = blank.withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return solid.join(ids, "node").select(*columns).unionByName(blank.select(*columns))


def keep_one_of_each(docs: DataFrame, *, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates; columns and the rows that stay are unchanged.

    Of a group the row with the smallest doc_id stays (a null one only if the group has no other; of rows with that id
    the one with the smallest hash of its set, then of its text). Rows are told apart by id and text, so texts that are
    unlike each other all stay, though they share an id. Rows without words stay, each different (id, text) once. Rows with
    equal id and text count as one; of these stays the one with the smallest hash of all its columns.
    """
    found = _by_row(docs, shingle_words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "text_hash")).alias("first")
    solid = found.filter("node is not null").groupBy("component").agg(first).select("first.doc_id", "first.text_hash")
    kept = solid.unionByName(found.filter("node is null").select("doc_id", "text_hash")).distinct()
    kept = staged(kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")), "kept-documents")
    text_hash = F.xxhash64(docs["text"])
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & text_hash.eqNullSafe(kept["_kept_hash"])
    rows = docs.join(kept, same, "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = rows.groupBy("doc_id", F.xxhash64("text").alias("_text_hash")).agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return one.select("_row.*")
