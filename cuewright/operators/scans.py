"""Running sums and neighbours of rows in order, also of keys too large for one task.

A window by key sorts and sums a key in one task. Keys with very many rows are cut into parts by a range of the order instead:
each part is scanned for itself, a small table of the parts is scanned by key, and what it carries over is added to each
part's rows. Results are those of the windows; sums of doubles may differ in their last bits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .folds import RUN_ROWS, hot_keys

#: Rows of the table of parts that may be broadcast.
_FEW_PARTS = 100_000


@dataclass(frozen=True)
class Scan:
    """What a column is of another one: kind is one of sum_before (0 for the first), sum_through, max_through, lag, lead,
    first, sum_all, max_all."""

    kind: str
    of: Column


@dataclass(frozen=True)
class Ordered:
    """Rows with keys in order; `cut` where some keys are in several parts (column _part)."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]
    cut: bool

    def scan(self, **scans: Scan) -> Ordered:
        """With a column for each scan."""
        keys = [self.key, "_part"] if self.cut else [self.key]
        whole = Window.partitionBy(*keys)
        w = whole.orderBy(*self.order)
        before, through = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
        local = {
            "sum_before": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
            "sum_through": lambda c: F.sum(c).over(through),
            "max_through": lambda c: F.max(c).over(through),
            "lag": lambda c: F.lag(c).over(w),
            "lead": lambda c: F.lead(c).over(w),
            "first": lambda c: F.first(c).over(through),
            "sum_all": lambda c: F.sum(c).over(whole),
            "max_all": lambda c: F.max(c).over(whole),
        }
        out = self.rows.withColumns({n: local[s.kind](s.of) for n, s in scans.items()})
        if not self.cut:
            return replace(self, rows=out)
        place, end = F.row_number().over(w), F.lead(F.lit(1)).over(w)
        out = out.withColumns({"_head": place == 1, "_end": end.isNull()})
        at = F.struct(*self.order)
        of_part = {"sum_before": F.sum, "sum_through": F.sum, "sum_all": F.sum, "max_through": F.max, "max_all": F.max, "lag": lambda c: F.max_by(c, at), "lead": lambda c: F.min_by(c, at), "first": lambda c: F.min_by(c, at)}
        parts = self.rows.groupBy(F.col(self.key).alias("_key"), F.col("_part").alias("_at")).agg(*(of_part[s.kind](s.of).alias(f"_c_{n}") for n, s in scans.items()))
        all_parts = Window.partitionBy("_key")
        p = all_parts.orderBy("_at")
        earlier = p.rowsBetween(Window.unboundedPreceding, -1)
        carry = {
            "sum_before": lambda c: F.sum(c).over(earlier),
            "sum_through": lambda c: F.sum(c).over(earlier),
            "max_through": lambda c: F.max(c).over(earlier),
            "lag": lambda c: F.lag(c).over(p),
            "lead": lambda c: F.lead(c).over(p),
            "first": lambda c: F.first(c).over(p.rowsBetween(Window.unboundedPreceding, 0)),
            "sum_all": lambda c: F.sum(c).over(all_parts),
            "max_all": lambda c: F.max(c).over(all_parts),
        }
        parts = stored(parts.withColumns({f"_c_{n}": carry[s.kind](F.col(f"_c_{n}")) for n, s in scans.items()}), "parts-of-keys")
        if parts.count() <= _FEW_PARTS:
            parts = F.broadcast(parts)
        out = out.join(parts, F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
        joined = {
            "sum_before": lambda a, c: a + F.coalesce(c, F.lit(0)),
            "sum_through": lambda a, c: F.coalesce(a + c, a, c),
            "max_through": lambda a, c: F.greatest(a, c),
            "lag": lambda a, c: F.when(F.col("_head"), c).otherwise(a),
            "lead": lambda a, c: F.when(F.col("_end"), c).otherwise(a),
        }
        last = lambda a, c: c
        out = out.withColumns({n: joined.get(s.kind, last)(F.col(n), F.col(f"_c_{n}")) for n, s in scans.items()})
        out = out.drop("_key", "_at", "_head", "_end", *(f"_c_{n}" for n in scans))
        return replace(self, rows=stored(out, "scanned-parts"))

    def with_columns(self, **columns: Column) -> Ordered:
        return replace(self, rows=self.rows.withColumns(columns))

    def done(self) -> DataFrame:
        return self.rows.drop("_part")


def in_order(rows: DataFrame, *order: str, key: str = "track_id", hot_rows: int | None = None) -> Ordered:
    """rows for scans by key in order; keys of more than hot_rows rows (see hot_keys) are cut into parts of about as many. Rows
    that are equal in key and order are of one part."""
    if (found := hot_keys(rows, key, hot_rows)) is None:
        return Ordered(rows, key, order, False)
    (sizes, n), same = found, F.col(key).eqNullSafe(F.col("_hot"))
    parts = -(-n // (hot_rows or RUN_ROWS)) + 1
    hot = rows.join(sizes, same, "left_semi").repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id())
    cold = rows.join(sizes, same, "left_anti").withColumn("_part", F.lit(0))
    return Ordered(stored(hot.unionByName(cold), "rows-in-parts"), key, order, True)
