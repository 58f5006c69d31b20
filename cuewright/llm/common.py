"""Helpers shared by the corpus operators: shared scratch tables, words, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import tokens

#: Words are runs of 0-9, a-z (A-Z lower-cased) and every character above 0x7F. In UTF-8 all bytes of such a
#: character are above 0x7F, so the rule can be applied to bytes: everything else becomes a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Alphanumeric words of a UTF-8 text, A-Z lower-cased; none for null."""
    return text.translate(_WORD_BYTES).split() if text else []


_NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def word_runs(text: bytes | None, limit: int = 4 << 20) -> Iterator[bytes]:
    """A text in runs of about `limit` bytes that cut no word, so that the words of a very long one never lie in memory together."""
    at = 0
    while text and len(text) - at > limit:
        cut = _NO_WORD.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if text:
        yield text[at:] if at else text


def blank_words(text: bytes | None) -> list[bytes]:
    """White-space separated words of a UTF-8 text, A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent and everything runs in one process, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=None)
def _local_folder(_application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="cuewright-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(batch: pa.RecordBatch, rows: int = 512, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` rows with about `limit` bytes of text and binary values, one row at least."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def one_thread(spark: SparkSession) -> None:
    """Numpy in Python workers keeps to one thread from now on, unless the session's owner has said otherwise: Spark
    gives a task one core, and further threads would mostly wait for each other."""
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
    slices: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] = small_batches,
) -> DataFrame:
    """mapInArrow with state built once per task; rows pass in slices (by default of up to 512 rows and 4 MB of text, or
    of one row), so memory is bounded by the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if slices is not tokens.text_slices:  # the worker has turned to other work
            tokens.forget_encoders()
        each = make()
        for batch in batches:
            for part in slices(batch):
                out = each(part)
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # the worker may wait long for its next task

    one_thread(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def size_bound(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most so many rows; its files' footers tell."""
    return df.count() <= rows
