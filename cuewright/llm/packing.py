"""Best-two-fit packing of token sequences into fixed-length training sequences.

Lengths are whole numbers up to the capacity, so the plan is made on the histogram of lengths: a bin is filled greedily
with the longest piece that fits, then its smallest piece gives way to the two unpacked pieces that fill the widened gap
best, if they fill it more tightly; the finished pattern is laid as often as the histogram allows. The plan has a few
thousand lines at any corpus size. Pieces then take their places by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, staged
from .tokens import KEEP_CHUNKS, encoder, text_slices


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how often, [(length, how many in each bin), ...]), ...] that together hold every piece once."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    lengths, plan = sorted(left), []
    while lengths:
        pieces = Counter({lengths[-1]: 1})
        gap = capacity - lengths[-1]
        k = len(lengths) - 1
        while gap and k >= 0:
            k = min(k, bisect_right(lengths, gap) - 1)
            if k < 0:
                break
            n = lengths[k]
            take = min(left[n] - pieces[n], gap // n)
            pieces[n] += take
            gap -= take * n
            k -= 1
        pieces = +pieces
        if gap and sum(pieces.values()) > 1:
            small = min(pieces)
            pair = _tightest_pair(lengths, left, pieces, gap + small)
            if pair and sum(pair) > small:
                pieces[small] -= 1
                pieces.update(pair)
                pieces = +pieces
        often = min(left[n] // m for n, m in pieces.items())
        plan.append((often, sorted(pieces.items(), reverse=True)))
        for n, m in pieces.items():
            left[n] -= often * m
            if not left[n]:
                del left[n]
                del lengths[bisect_right(lengths, n) - 1]
    return plan


def _tightest_pair(lengths: list[int], left: dict[int, int], used: Counter, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum of at most room."""
    free = [n for n in lengths[: bisect_right(lengths, room)] if left[n] > used[n]]
    best, i, j = None, 0, len(free) - 1
    while i <= j:
        a, b = free[i], free[j]
        if a + b > room or (i == j and left[a] - used[a] < 2):
            j -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
            if a + b == room:
                break
        i += 1
    return best


def _lines(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, in each bin, first sequence, offset in it), ascending by rank."""
    rank, lines, sequence = Counter(), {}, 0
    for often, pieces in plan:
        offset = 0
        for n, m in pieces:
            lines.setdefault(n, []).append((rank[n], m, sequence, offset))
            rank[n] += often * m
            offset += n * m
        sequence += often
    return {n: np.array(x, dtype=np.int64) for n, x in lines.items()}


def token_pieces(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, checksums: bool = False, keep_chunks: int = KEEP_CHUNKS) -> DataFrame:
    """Every document's ids (plus end_id) as pieces: doc_id, piece, start, length, ids (little-endian 32-bit).

    With checksums, ids_crc32 (their unsigned CRC-32) takes the place of the ids themselves.

    Only documents longer than the capacity are cut; the first piece takes the rest that does not fill a sequence. A
    null text is empty, and so is one piece with the end id alone. Repeated rows give their pieces once for each row.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    last = "ids_crc32" if checksums else "ids"

    def make():
        enc = encoder(tokenizer, keep_chunks)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", last)}
            every, bounds = enc.encode_column(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = np.append(every[bounds[k] : bounds[k + 1]].astype("<u4"), np.uint32(end_id))
                at, piece, first = 0, 0, len(ids) % capacity or capacity
                while at < len(ids):
                    to = first if not at else at + capacity
                    for k, v in zip(out, (doc_id, piece, at, to - at, zlib.crc32(ids[at:to]) if checksums else ids[at:to].tobytes()), strict=True):
                        out[k].append(v)
                    at, piece = to, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if checksums else pa.binary())
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

        return each

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id long, piece int, start long, length long, {last} {'long' if checksums else 'binary'}", text_slices)


def place(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length and any others).

    pieces should be stored, since it is read twice. Ranks within one length are dealt over many buckets, so a length
    that a third of all pieces share is ranked by many tasks. An empty table stays empty.
    """
    spark = pieces.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    sizes = staged(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "packing-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    lines = spark.sparkContext.broadcast(_lines(best_two_fit(counts, capacity)))
    base = sizes.select(
        "length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_base")
    )
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = (
        keyed.withColumn("_rank", F.row_number().over(order) - 1)
        .join(base, ["length", "_bucket"])
        .select(*pieces.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))
    )
    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)

    def make():
        table = lines.value

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            lengths = b.column(b.schema.get_field_index("length")).to_numpy()
            ranks = b.column(b.schema.get_field_index("_rank")).to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                at = lengths == n
                t = table[int(n)]
                line = t[np.searchsorted(t[:, 0], ranks[at], "right") - 1]
                k = ranks[at] - line[:, 0]
                sequence[at] = line[:, 2] + k // line[:, 1]
                offset[at] = line[:, 3] + k % line[:, 1] * n
            keep = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "_rank"]
            return pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*(n for n in b.schema.names if n != "_rank"), "sequence_id", "offset"])

        return each

    return map_batches(ranked, make, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, keep_chunks: int = KEEP_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where every piece of every document lies."""
    pieces = staged(token_pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer, checksums=True, keep_chunks=keep_chunks), "packing-pieces")
    return place(pieces, capacity=capacity)


def packed_sequences(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """sequence_id and its ids (array of int, at most `capacity`), in the order of their offsets."""
    pieces = staged(token_pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer), "packing-token-pieces")
    places = place(pieces.drop("ids"), capacity=capacity)
    joined = places.join(pieces.select("doc_id", "piece", "start", "ids").dropDuplicates(["doc_id", "piece", "start"]), ["doc_id", "piece", "start"])
    grouped = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def make():
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int32) for parts in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

        return each

    return map_batches(grouped, make, "sequence_id long, ids array<int>")
