"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record file holds, for each sequence, a frame of
    length of the data, 8 bytes | masked CRC-32C of these 8 bytes, 4 bytes | data | masked CRC-32C of the data, 4 bytes
(all little-endian; masked: the checksum turned right by 15 bits plus 0xA282EAD8). The data are an 8-byte doc_id, one
byte that says whether doc_id is null, one byte with the width of an id (2 or 4), and the ids. The index file beside it
holds the 8-byte offset of each frame and the file's length, so that any record can be read by its number.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, work_dir
from .tokens import encoder, text_slices

# --- checksums ------------------------------------------------------------------------------------------------------

_POLYNOMIAL = 0x82F63B78
_BLOCK = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def _zeros_operator(n: int) -> np.ndarray:
    """Four tables of 256: what n zero bytes do to a register, by its bytes."""
    column = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        column = _TABLE[column & 0xFF] ^ (column >> 8)
    bits = np.arange(256)
    tables = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for b in range(8):
            tables[k] ^= np.where(bits >> b & 1, column[8 * k + b], 0).astype(np.uint32)
    return tables


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    return op[0][x & 0xFF] ^ op[1][x >> 8 & 0xFF] ^ op[2][x >> 16 & 0xFF] ^ op[3][x >> 24]


_SHIFT = [_zeros_operator(_BLOCK)]


def _shift(k: int) -> np.ndarray:
    """The operator of 2**k blocks of zeros, by squaring the one before it."""
    while len(_SHIFT) <= k:
        op, unit = _SHIFT[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)
        column, bits, tables = _apply(op, _apply(op, unit)), np.arange(256), np.zeros((4, 256), dtype=np.uint32)
        for q in range(4):
            for b in range(8):
                tables[q] ^= np.where(bits >> b & 1, column[8 * q + b], 0).astype(np.uint32)
        _SHIFT.append(tables)
    return _SHIFT[k]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part. All parts' blocks of 64 bytes are summed side by side, then joined pairwise.

    Zeros in front change nothing while the register is 0, so every part is padded in front to whole blocks; the
    register's usual start of all ones equals inverting the first four bytes (parts of fewer go byte by byte).
    """
    out = np.zeros(len(parts), dtype=np.uint32)
    long = [k for k, p in enumerate(parts) if len(p) >= 4]
    for k, p in enumerate(parts):
        if len(p) < 4:
            r = 0xFFFFFFFF
            for b in p:
                r = int(_TABLE[(r ^ b) & 0xFF]) ^ (r >> 8)
            out[k] = r ^ 0xFFFFFFFF
    if not long:
        return out
    sizes = np.array([len(parts[k]) for k in long])
    blocks = -(-sizes // _BLOCK)
    data = np.zeros(int(blocks.sum()) * _BLOCK, dtype=np.uint8)
    ends = np.cumsum(blocks) * _BLOCK
    for k, end, n in zip(long, ends.tolist(), sizes.tolist(), strict=True):
        data[end - n : end] = np.frombuffer(parts[k], dtype=np.uint8)
        data[end - n : end - n + 4] ^= 0xFF
    rows = data.reshape(-1, _BLOCK).T
    state = np.zeros(rows.shape[1], dtype=np.uint32)
    for byte in rows:
        state = _TABLE[(state ^ byte) & 0xFF] ^ (state >> 8)
    first, count, level = np.cumsum(blocks) - blocks, blocks, 0
    while count.max(initial=1) > 1:  # pairs from each part's end, so that the odd block in front stays whole
        half = -(-count // 2)
        at = np.repeat(first + count, half) - 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
        right = state[at - 1]
        has_left = at - 2 >= np.repeat(first, half)
        left = np.where(has_left, state[np.maximum(at - 2, 0)], 0).astype(np.uint32)
        joined = _apply(_shift(level), left) ^ right
        starts = np.cumsum(half) - half
        order = np.repeat(starts + half - 1, half) - (np.arange(half.sum()) - np.repeat(starts, half))
        state = np.empty_like(joined)
        state[order] = joined
        first, count, level = starts, half, level + 1
    out[long] = state[first] ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# --- files ----------------------------------------------------------------------------------------------------------


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str | None, end_id: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    fs, root = open_fs(folder)
    # the name is this attempt's own: the manifest, which Spark commits, has that of one attempt
    name = posixpath.join(root, f"part-{part:06d}-{uuid.uuid4().hex[:12]}")
    enc, offsets, at, n_tokens = encoder(tokenizer), [], 0, 0
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(name + ".records") as out:
        for batch in batches:
            for piece in text_slices(batch):
                every, bounds = enc.encode_column(piece.column(1))
                end, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
                data = [
                    (0 if i is None else i).to_bytes(8, "little", signed=True) + bytes((i is None, width)) + every[a:b].tobytes() + end
                    for i, a, b in zip(piece.column(0).to_pylist(), bounds, bounds[1:], strict=False)
                ]
                heads = [len(d).to_bytes(8, "little") for d in data]
                sums = masked(crc32c(heads + data)).astype("<u4").tobytes()
                for j, (h, d) in enumerate(zip(heads, data, strict=True)):
                    m = 4 * (j + len(data))
                    out.write(h + sums[4 * j : 4 * j + 4] + d + sums[m : m + 4])
                    offsets.append(at)
                    at += len(d) + 16
                    n_tokens += (len(d) - 10) // width
    with fs.open_output_stream(name + ".index") as out:
        out.write(np.array([*offsets, at], dtype="<u8").tobytes())
    yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "records": [len(offsets)], "tokens": [n_tokens]})


def write_token_records(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Write every row's ids plus end_id in ascending doc_id order; returns the manifest, a row for each file.

    docs: doc_id, text; other columns are ignored. A null text is empty; a null doc_id comes first; rows with the same
    doc_id follow one another in the order of their texts' hashes. The files' order is the order of their names. The
    rows are range-partitioned on (doc_id, hash), so neither a hot id nor sorting gathers rows beyond one partition;
    `files` sets how many there are, else the session's shuffle partitions do.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ranges = ("doc_id", "h") if files is None else (files, "doc_id", "h")
    rows = rows.repartitionByRange(*ranges).sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = rows.mapInArrow(
        lambda batches: _write_part(batches, folder, tokenizer, end_id), "part long, name string, records long, tokens long"
    )
    manifest = staged(manifest, "token-records-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_records(fs: pafs.FileSystem, name: str, numbers: list[int] | None = None, ahead: int = 1 << 21) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's records: all in order, or those with the given numbers, each by its offset."""
    with fs.open_input_stream(name + ".index") as f:
        offsets = np.frombuffer(f.read(), dtype="<u8").astype(np.int64)
    spans = [(k, k + 1) for k in numbers] if numbers is not None else []
    k = 0
    while numbers is None and k < len(offsets) - 1:  # whole file: some megabytes at a time
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + ahead, "right")) - 1)
        spans.append((k, to))
        k = to
    with fs.open_input_file(name + ".records") as f:
        for a, b in spans:
            raw = f.read_at(int(offsets[b] - offsets[a]), int(offsets[a]))
            cuts = (offsets[a : b + 1] - offsets[a]).tolist()
            frames = [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            heads, data = [x[:8] for x in frames], [x[12:-4] for x in frames]
            sums = np.frombuffer(b"".join([x[8:12] for x in frames] + [x[-4:] for x in frames]), dtype="<u4")
            if any(int.from_bytes(h, "little") != len(d) for h, d in zip(heads, data, strict=True)):
                raise ValueError(f"{name}: a record's length does not match the index")
            if not np.array_equal(masked(crc32c(heads + data)), sums):
                raise ValueError(f"{name}: a checksum does not match")
            for d in data:
                yield None if d[8] else int.from_bytes(d[:8], "little", signed=True), np.frombuffer(d, dtype=f"<u{d[9]}", offset=10)


def read_token_records(manifest: DataFrame, store: str, *, checksums: bool = False) -> DataFrame:
    """Rows of doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit), from the
    files; with checksums, ids_crc32 (their unsigned CRC-32) takes the place of the ids themselves. store: a URI in the
    files' file system, such as the folder they were written to."""
    last, kind = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(store)
        for batch in batches:
            for file in batch.to_pylist():
                rows, start, size = [], file["first_token"], 0
                for doc_id, tokens in read_records(fs, file["name"]):
                    raw = tokens.astype("<u4").tobytes()
                    rows.append((doc_id, start, len(tokens), zlib.crc32(raw) if checksums else raw))
                    start += len(tokens)
                    size += 64 if checksums else len(raw)
                    if size > 1 << 22:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), kind)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", last])

    files = manifest.count()
    schema = f"doc_id long, start long, n_tokens long, {last} {'long' if checksums else 'binary'}"
    return manifest.repartitionByRange(max(1, files), "part").mapInArrow(read, schema)


def token_record_digests(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the records, read them back, and give doc_id, start, n_tokens, ids_crc32 of each."""
    folder = work_dir(docs.sparkSession, "token-records")
    manifest = staged(write_token_records(docs, folder, tokenizer=tokenizer, end_id=end_id), "token-records-starts")
    return read_token_records(manifest, folder, checksums=True)
