"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and the fast Hadamard transform; its hash is the axis, with sign, that
it then lies closest to. A bucket joins several such hashes of one table; a vector enters its own bucket and, as probes,
those in which its least certain hash takes the next best axes. Candidates of shared buckets are verified by cosine in
double precision (linkage.py), links join vectors into components, and within each component every pair is compared
block by block, so that link counts are complete there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix64, staged
from .linkage import by_blocks, connected_components, moved_nodes, own_nodes, small_side, star_pairs, unsettled

_STEP = np.uint64(0x9E3779B97F4A7C15)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The (unscaled) Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def cross_polytope(x: np.ndarray, signs: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The `probes` + 1 nearest signed axes of each row after rotation, nearest first, and how far each falls short."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    axes = np.argsort(-size, axis=1, kind="stable")[:, : probes + 1]
    at = np.take_along_axis(size, axes, 1)
    sign = np.take_along_axis(x, axes, 1) < 0
    return (2 * axes + sign).astype(np.uint64), (at[:, :1] - at) / np.maximum(at[:, :1], 1e-300)


def buckets(x: np.ndarray, labels: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Rows by tables * (probes + 1) bucket numbers."""
    n, d = x.shape
    width = 1 << max(4, (d - 1).bit_length(), probes.bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng, out = np.random.default_rng(seed), []
    lead = mix64(labels.astype(np.int64).view(np.uint64) * _STEP + np.uint64(d))
    for t in range(tables):
        parts = [cross_polytope(padded, rng.choice((-1.0, 1.0), size=(3, width)), probes) for _ in range(hashes)]
        rows = []
        cost = np.concatenate([short[:, 1:] for _, short in parts], axis=1)  # of moving one hash to a further axis
        cheap = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        choice = np.zeros((probes + 1, n, hashes), dtype=int)
        for p in range(probes):
            which, step = cheap[:, p] // probes, cheap[:, p] % probes + 1
            choice[p + 1, np.arange(n), which] = step
        for p in range(probes + 1):
            h = lead + np.uint64(t + 1)
            for k, (axes, _) in enumerate(parts):
                h = mix64(h * _STEP + axes[np.arange(n), choice[p, :, k]])
            rows.append(h)
        out += rows
    return np.stack(out, axis=1).view(np.int64)


def _parsed(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Vectors in double precision; None for those that link with nothing."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    flat = column.flatten().cast(pa.float64())  # of the rows that are not null
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, out = np.cumsum(size), []
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        v = values[a:b]
        norm = float(np.sqrt(v @ v)) if b > a and np.isfinite(v).all() else 0.0
        out.append(v if 0 < norm < np.inf else None)
    return out


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, node (null: links with nothing), key (of 128 bits, the node's are the first), v (the vector in double precision)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels, keys, raws = batch.column(1).to_pylist(), [], []
            for v, label in zip(_parsed(batch), labels, strict=True):
                if v is None or label is None:
                    keys.append(None)
                    raws.append(None)
                else:
                    raws.append((v + 0.0).tobytes())  # one zero, not two
                    keys.append(hashlib.blake2b(raws[-1] + str(label).encode(), digest_size=16).digest())
            nodes = [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys]
            return pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(1).cast(pa.int64()), "node": pa.array(nodes, pa.int64()), "key": pa.array(keys, pa.binary()), "v": pa.array(raws, pa.binary())})

        return each

    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return map_batches(rows, make, "vec_id long, label long, node long, key binary, v binary")


def _bucketed(classes: DataFrame, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = batch.column(2).to_pylist()
            nodes, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size = np.array([len(r) for r in raws])
            found, of = [], []
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = np.frombuffer(b"".join(raws[k] for k in at), dtype=np.float64).reshape(len(at), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                b = buckets(x, labels[at], tables, hashes, probes, seed)
                found.append(b.ravel())
                of.append(np.repeat(nodes[at], b.shape[1]))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(np.concatenate(found)), "node": pa.array(np.concatenate(of))})

        return each

    return map_batches(classes.select("node", "label", "v"), make, "bucket long, node long")


def _stack(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raws), dtype=np.float64).reshape(len(raws), -1)


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-ends")
    some = staged(classes.select("node", "v").join(small_side(ends), "node", "left_semi"), "pair-vectors")
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(xs), dtype=bool)
            same = np.array([len(x) == len(y) for x, y in zip(xs, ys, strict=True)])
            size = np.array([len(x) for x in xs])
            for n in np.unique(size[same]):
                at = np.flatnonzero(same & (size == n))
                keep[at] = _cosine(_stack([xs[k] for k in at]), _stack([ys[k] for k in at])) >= cosine
            return batch.select(["a", "b"]).filter(pa.array(keep))

        return each

    return staged(map_batches(both.select("a", "b", "x", "y"), make, "a long, b long"), "cosine-links")


def _blocks_of(table: pa.Table, cosine: float):
    """For each size of vectors: row numbers and, for slices of them, the matrix of links to all of these rows."""
    raws = table.column("v").to_pylist()
    size = np.array([len(r) for r in raws])
    own = table.column("_block").to_numpy()
    same = table.column("_i")[0].as_py() == table.column("_j")[0].as_py()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = _stack([raws[k] for k in at])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        for k in range(0, len(at), 512):
            part = slice(k, k + 512)
            dots = x[part] @ x.T
            linked = dots >= cosine
            for r, c in zip(*np.nonzero(np.abs(dots - cosine) < 1e-12), strict=True):  # where rounding may decide: as in _verified
                linked[r, c] = _cosine(x[part][r : r + 1], x[c : c + 1])[0] >= cosine
            linked[np.arange(linked.shape[0]), np.arange(k, k + linked.shape[0])] = False
            if not same:
                linked &= own[at][part, None] != own[at][None, :]
            yield at, part, linked


def _settled(open_: DataFrame, classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """Links across components within open buckets: for each member one link to each other component at most."""
    ends = staged(open_.select("node").distinct(), "unsettled-nodes")
    rows = open_.drop("lo", "hi").join(classes.select("node", "v").join(small_side(ends), "node", "left_semi"), "node")

    def compare(table: pa.Table) -> pa.Table:
        comps, out = table.column("component").to_numpy(), set()
        for at, part, linked in _blocks_of(table, cosine):
            linked &= comps[at][part, None] != comps[at][None, :]
            for r, c in zip(*np.nonzero(linked), strict=True):
                x, y = comps[at[part][r]], comps[at[c]]
                out.add((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([int(a) for a, _ in out], pa.int64()), "b": pa.array([int(b) for _, b in out], pa.int64())})

    return staged(by_blocks(rows, "bucket", F.ceil(F.col("n") / block), compare, "a long, b long").distinct(), "settled-links")


def _link_counts(classes: DataFrame, components: DataFrame, cosine: float, block: int) -> DataFrame:
    """node, links: the number of vectors of other nodes in its component that it is linked with."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    rows = components.join(sizes, "component")
    rows = staged(rows, "component-sizes")
    rows = classes.select("node", "v", "copies").join(small_side(rows), "node")

    def compare(table: pa.Table) -> pa.Table:
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        total = np.zeros(len(nodes), dtype=np.int64)
        for at, part, linked in _blocks_of(table, cosine):
            total[at[part]] += linked @ copies[at]
        return pa.table({"node": pa.array(nodes), "links": pa.array(total)})

    return by_blocks(rows, "component", F.ceil(F.col("n") / block), compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def embedding_duplicates(vectors: DataFrame, *, cosine: float = 0.98, tables: int = 12, hashes: int = 3, probes: int = 2, block: int = 2048, seed: int = 7) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored. Vectors are compared within one
    label and length. Those with a null label, null, empty, zero, or with null or non-finite components link with
    nothing. Equal vectors are linked and are hashed and compared once, whatever their number; repeated rows count as
    vectors of their own. A null vec_id takes part, its component_id is null only if no row of its component has an id.
    """
    keyed = staged(_keyed(vectors), "keyed-vectors")
    classes = staged(
        keyed.filter("node is not null").groupBy("node", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")),
        "vector-classes",
    )
    moved = moved_nodes(classes)
    keyed, classes = own_nodes(keyed, moved), own_nodes(classes, moved)
    shared, pairs = star_pairs(_bucketed(classes, tables, hashes, probes, seed))
    links = _verified(pairs, classes, cosine)
    components = staged(connected_components(links), "components-of-stars")
    open_ = unsettled(shared, components)
    if not open_.isEmpty():
        more = _settled(open_, classes, cosine, block)
        if not more.isEmpty():
            components = staged(connected_components(links.unionByName(more)), "components-of-all")
    counts = _link_counts(classes, components, cosine, block)
    nodes = classes.select("node", "rep", "copies").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    nodes = nodes.join(smallest, "component").join(counts, "node", "left")
    nodes = nodes.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = keyed.filter("node is not null").select("vec_id", "node").join(nodes, "node").select("vec_id", "n_links", "component_id")
    alone = keyed.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
