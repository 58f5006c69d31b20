"""Linking rows that share buckets, without ever listing all pairs of a bucket.

1. Each bucket's smallest and largest member are paired with every other member (linear in its size; a large bucket's
   members meet them in several tasks).
2. The caller verifies these pairs; links join nodes into components.
3. Buckets whose members still lie in several components are settled block by block: a task compares the members of two
   blocks, passes over pairs within one component, and gives out only what survives its own comparison.
All candidates are thus within a component already, compared, or verified: none is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_thread, size_bound, staged

#: Rows of two or three numbers that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; pass stored tables, since they are counted."""
    return F.broadcast(df) if size_bound(df, rows) else df


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, component: the smallest node it reaches, for each node of an edge between two nodes.

    Alternates the large-star and small-star steps until nothing changes; each round is a stored table. Nulls and loops
    are ignored, repeated edges count once; no edges give no rows.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, before = staged(now, "components"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.countDistinct("hi")).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        now = staged(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "components")
    below = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return below.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def spread_join(members: DataFrame, buckets: DataFrame, most: int = 4_096) -> DataFrame:
    """members (bucket, node) with the columns of their buckets (stored: bucket, n, its members, and more).

    The members of a bucket of more than `most` are dealt to several tasks, and the bucket's row goes to each of these.
    """
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = staged(buckets.filter(F.col("n") > most).select("bucket", parts.alias("_parts")), "hot-buckets")
    if hot.isEmpty():
        return members.join(buckets, "bucket")
    part = F.pmod(F.xxhash64("node"), F.coalesce("_parts", F.lit(1))).cast("int")
    left = members.join(small_side(hot), "bucket", "left").withColumn("_part", part).drop("_parts")
    right = buckets.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, ["bucket", "_part"]).drop("_part")


def star_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members: bucket, node. Stored (bucket, node, lo, hi) of buckets with several nodes, and pairs a < b with their ends."""
    ends = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    shared = staged(spread_join(members, staged(ends, "bucket-ends")).select("bucket", "node", "lo", "hi").distinct(), "bucket-members")
    ends = F.explode(F.array("lo", "hi"))
    pairs = shared.select("node", ends.alias("end")).filter("node <> end")
    return shared, staged(pairs.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct(), "bucket-pairs")


def unsettled(shared: DataFrame, components: DataFrame) -> DataFrame:
    """Stored (bucket, node, lo, hi, component, n) of buckets with three members or more in several components."""
    at = shared.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = at.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x < y and n > 2")
    return staged(spread_join(at, staged(open_.select("bucket", "n"), "open-buckets")), "unsettled-buckets")


def by_blocks(rows: DataFrame, group: str, blocks: Column, compare: Callable[[pa.Table], pa.Table], schema: str, node: str = "node") -> DataFrame:
    """Compare the members of each group, two blocks of them at a time.

    rows: the group, node, and whatever compare reads; blocks: in how many a group is dealt, the same for all its rows.
    compare gets the rows of blocks i and j (columns _i, _j, and _block, the row's own); where i = j all are of one block.
    """
    dealt = rows.withColumn("_blocks", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("_block", F.pmod(F.xxhash64(F.col(node)), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other", "_blocks")
    one_thread(rows.sparkSession)
    return dealt.groupBy(group, "_i", "_j").applyInArrow(lambda table: compare(table), schema)


def moved_nodes(classes: DataFrame) -> dict[bytes, int]:
    """Keys whose node another key has too, with nodes of their own; the smallest key of a node keeps it.

    classes: a row for each node and key (binary, 16 bytes, of which the first half gave the node). A node is a hash of
    64 bits, so that these are a handful among ten thousand million keys.
    """
    twice = [r["node"] for r in classes.groupBy("node").count().filter("count > 1").select("node").collect()]
    if not twice:
        return {}
    keys: dict[int, list[bytes]] = {}
    for r in classes.filter(F.col("node").isin(twice)).select("node", "key").collect():
        keys.setdefault(r["node"], []).append(bytes(r["key"]))
    return {k: int.from_bytes(k[8:], "little", signed=True) for same in keys.values() for k in sorted(same)[1:]}


def own_nodes(rows: DataFrame, moved: dict[bytes, int]) -> DataFrame:
    """rows with the nodes of moved_nodes for their keys."""
    node = F.col("node")
    for key, own in moved.items():
        node = F.when(F.col("key") == F.lit(key), F.lit(own)).otherwise(node)
    return rows.withColumn("node", node) if moved else rows


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
