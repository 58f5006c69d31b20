"""Folds over rows in order: what depends on its own earlier results and cannot be said as a window.

The rows of a key go to one task in order and pass by in batches, so that a key of any length takes the memory of one batch
and of the fold's own state. A key with very many rows is cut into runs instead, which are folded at the same time: each
from the states it may be entered with, first a fresh one, then those its predecessors have been left with. A small fold of
entries and exits by key tells the true ones; where a true entry has not been tried, that run is folded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import in_key_order, input_bytes, stored

_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
#: Rows of a key from which on it is cut into runs of about so many.
RUN_ROWS = 1_000_000
#: Inputs of up to so many bytes are not searched for such keys: one task is done with all of them soon enough.
SMALL_INPUT = 64 << 20
#: Rounds in which all exits are tried as entries; after them only those that are truly met.
FREE_ROUNDS = 6


class Fold:
    """What a key's rows are folded with; a new one begins each key."""

    def take(self, *row: object) -> Iterable[tuple]:
        """The rows that are complete once this one has come."""
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        """The rows still held when the key ends."""
        return ()

    def state(self) -> str:
        """All that later rows depend on, but for how many rows have been given out; equal states as equal texts."""
        raise NotImplementedError

    def resume(self, state: str, given: int) -> None:
        """Go on from a state after so many rows have been given out."""
        raise NotImplementedError


def row_kinds(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def row_batch(out: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)


def hot_keys(rows: DataFrame, key: str, run_rows: int | None) -> tuple[DataFrame, int] | None:
    """The keys (_hot) with more than run_rows rows, stored, and how many rows they have; None without such keys.

    Without run_rows it is RUN_ROWS, and rows that are made from a small input are not counted.
    """
    if run_rows is None and input_bytes(rows) <= SMALL_INPUT:
        return None
    sizes = rows.groupBy(F.col(key).alias("_hot")).count().filter(F.col("count") > (RUN_ROWS if run_rows is None else run_rows))
    sizes = stored(sizes, "hot-keys")
    n = sizes.agg(F.sum("count")).first()[0]
    return (sizes, n) if n else None


def ordered_fold(rows: DataFrame, order: list[str], make: Callable[[], Fold], schema: str, run_rows: int | None = None) -> DataFrame:
    """Fold the rows of each value of the first column, in the order given; schema: name and kind of each result column.

    Keys with more than run_rows rows (see hot_keys) are cut into runs; results are the same. Rows that are equal in key
    and order are of one run.
    """
    key = rows.columns[0]
    if (found := hot_keys(rows, key, run_rows)) is None:
        return _by_key(rows, order, make, schema)
    (hot, n), same = found, F.col(key).eqNullSafe(F.col("_hot"))
    cold = _by_key(rows.join(hot, same, "left_anti"), order, make, schema)
    return cold.unionByName(_in_runs(rows.join(hot, same, "left_semi"), order, make, schema, -(-n // (run_rows or RUN_ROWS)) + 1))


def _by_key(rows: DataFrame, order: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    kinds, key = row_kinds(schema), rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fold, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or row[0] != last:
                    if fold is not None:
                        out += fold.end()
                    last, fold = row[0], make()
                out += fold.take(*row)
            if out:
                yield row_batch(out, kinds)
                out = []
        if fold is not None and (out := list(fold.end())):
            yield row_batch(out, kinds)

    return in_key_order(rows, key, order).mapInArrow(run, schema)


_HEAD = ["_part", "_try", "_flag", "_entry", "_given", "_more"]
_TRIED = "_try long, exit string, emitted long"


def _in_runs(rows: DataFrame, order: list[str], make: Callable[[], Fold], schema: str, runs: int) -> DataFrame:
    """The fold of rows whose keys are all cut into runs."""
    key, names = rows.columns[0], rows.columns
    # a run is what a range of (key, order) has of a key; stored, so that its bounds stay as they are
    dealt = rows.repartitionByRange(runs, key, *order).withColumn("_part", F.spark_partition_id().cast("long"))
    dealt = stored(dealt, "runs")
    following = F.lead("part").over(Window.partitionBy("key").orderBy("part"))
    spans = dealt.select(F.col(key).alias("key"), F.col("_part").alias("part")).distinct()
    spans = stored(spans.withColumn("following", following), "spans-of-runs")
    ahead = spans.filter("following is not null")  # how a key's last run is left matters to none

    def folded(heads: DataFrame, all_rows: bool) -> DataFrame:
        """heads: part, key, try, entry, given, more. Result rows, or how each try is left and how many rows it gives out."""
        tries = heads.select(F.col("key").alias("_key"), F.col("part").alias("_p"), "try")
        if heads.count() <= 100_000:  # three numbers each
            tries = F.broadcast(tries)
        mine = dealt.join(tries, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
        data = mine.select("_part", F.col("try").alias("_try"), F.lit(1).alias("_flag"), _null("string", "_entry"), _null("long", "_given"), _null("boolean", "_more"), *names)
        begins = [F.col("key").alias(key), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names[1:])]
        begin = heads.select(F.col("part").alias("_part"), F.col("try").alias("_try"), F.lit(0).alias("_flag"), F.col("entry").alias("_entry"), F.col("given").alias("_given"), F.col("more").alias("_more"), *begins)
        every = data.unionByName(begin)
        every = every.repartition(runs, "_part", "_try") if all_rows else every.repartition("_part", "_try")  # tries may be few
        every = every.sortWithinPartitions("_part", "_try", key, "_flag", *order)
        return every.mapInArrow(lambda batches: _resumed(batches, make, row_kinds(schema if all_rows else _TRIED), all_rows), schema if all_rows else _TRIED)

    def tried(new: DataFrame, kind: str) -> DataFrame:
        """new: part, key, entry. The same with exit and emitted."""
        new = stored(new.withColumns({"try": F.monotonically_increasing_id(), "given": F.lit(0).cast("long"), "more": F.lit(True)}), f"tries-{kind}")
        return stored(new.join(folded(new, False), F.col("try") == F.col("_try")).select("part", "key", "entry", "exit", "emitted"), f"tried-{kind}")

    known = tried(ahead.select("part", "key", _null("string", "entry")), "fresh")
    done = 0
    while True:
        table = spans.alias("s").join(known.alias("k"), F.col("s.part").eqNullSafe(F.col("k.part")) & F.col("s.key").eqNullSafe(F.col("k.key")), "left")
        table = table.select("s.key", "s.part", "s.following", "k.entry", "k.exit", F.coalesce("k.emitted", F.lit(0)).alias("emitted"), F.col("k.part").isNotNull().alias("tried"))
        kind = dealt.schema[key].dataType.simpleString()
        chain = stored(table.groupBy("key").applyInPandas(_chain, f"key {kind}, part long, entry string, given long, more boolean, missing boolean"), "chain-of-runs")
        missing = chain.filter("missing").select("part", "key", "entry")
        if missing.isEmpty():
            break
        if done < FREE_ROUNDS:  # every exit may be an entry of the run that follows
            exits = known.alias("k").join(ahead.alias("s"), (F.col("k.part") == F.col("s.part")) & F.col("k.key").eqNullSafe(F.col("s.key")))
            exits = exits.select(F.col("s.following").alias("part"), "s.key", F.col("k.exit").alias("entry"))
            missing = missing.unionByName(_of_runs(exits, ahead)).distinct().exceptAll(known.select("part", "key", "entry"))
        known = stored(known.unionByName(tried(missing.distinct(), "again")), "known-runs")
        done += 1
    return folded(chain.withColumn("try", F.lit(0).cast("long")), True)


def _of_runs(tries: DataFrame, runs: DataFrame) -> DataFrame:
    """Those of (part, key, entry) whose run is among `runs`."""
    r = runs.select(F.col("part").alias("_p"), F.col("key").alias("_k"))
    return tries.join(r, (F.col("part") == F.col("_p")) & F.col("key").eqNullSafe(F.col("_k")), "left_semi")


def _null(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def _resumed(batches: Iterator[pa.RecordBatch], make: Callable[[], Fold], kinds: pa.Schema, all_rows: bool) -> Iterator[pa.RecordBatch]:
    """Fold runs, each behind its head; all_rows: give out what they give, else how they are left."""
    fold, more, number, given, out = None, True, 0, 0, []

    def close() -> Iterable[tuple]:
        if fold is None:
            return ()
        return (() if more else fold.end()) if all_rows else [(number, fold.state(), given)]

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not row[2]:
                out += close()
                fold, number, more, given = make(), row[1], row[5], 0
                if row[3] is not None:
                    fold.resume(row[3], row[4])
                continue
            found = fold.take(*row[len(_HEAD) :])
            if all_rows:
                out += found
            else:
                given += len(found)
        if out:
            yield row_batch(out, kinds)
            out = []
    if out := list(close()):
        yield row_batch(out, kinds)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The true entries of a key's runs in order, up to one that has not been tried."""
    left = {(r.part, None if pd.isna(r.entry) else r.entry): (r.exit, int(r.emitted)) for r in pdf.itertuples() if r.tried}
    following = {r.part: None if pd.isna(r.following) else int(r.following) for r in pdf.itertuples()}
    part, entry, given, out = min(following), None, 0, []
    while True:
        after = following[part]
        missing = after is not None and (part, entry) not in left
        out.append((part, entry, given, after is not None, missing))
        if after is None or missing:
            break
        entry, more = left[part, entry]
        part, given = after, given + more
    frame = pd.DataFrame(out, columns=["part", "entry", "given", "more", "missing"])
    frame.insert(0, "key", pdf["key"].iloc[0])
    return frame
