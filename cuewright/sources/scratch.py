"""Tables in the folder that driver and executors share, for what is read twice or would be lost with an executor."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one in spark.checkpoint.dir. Only where that is unset and everything runs in one process, as in
    tests, a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=None)
def _local_folder(_application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="cuewright-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and no row is computed twice."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """About how many bytes df reads, by the plan's own statistics; no job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def reads_unions(df: DataFrame) -> bool:
    """Whether df's plan has a union."""
    return "Union" in df._jdf.queryExecution().optimizedPlan().toString()


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """The rows of each key in one partition, whatever df's plan says about itself.

    Spark 4.1 takes a union of tables that are all dealt by the key for dealt by it, and leaves out the shuffle; where
    adaptive execution then merges the partitions of the parts differently, a key's rows lie in several. A key that the
    planner can't see through brings the shuffle back. Rows without a union keep the shuffle they have.
    """
    return df.repartition(F.greatest(key, key) if reads_unions(df) else F.col(key))


def in_key_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of each key in one partition, sorted by key and order. Rows that lie so by key stay where they are, in however
    many partitions: a shuffle by the session's number would make the partitions of a large input as many as those of a small one.
    """
    if reads_unions(df):
        return dealt_anew(df, key).sortWithinPartitions(key, *order)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))  # a window's rows come by key and in order
    return df.withColumn("_place", place).filter("_place > 0").drop("_place").sortWithinPartitions(key, *order)
