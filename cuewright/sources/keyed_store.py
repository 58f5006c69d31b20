"""A table with one row for each key that is brought up to date in parts.

Rows lie in buckets by a hash of their keys. An upsert reads and writes only the buckets that the new rows fall into, each
into a new folder; then one file is added to the manifest, which names the folder of every bucket. Until that file is there the
table is as it was, whatever became of the write; buckets that are not touched keep their files. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import upsert_latest

_MANIFEST = "seq long, buckets int, bucket int, folder string"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, root: str, keys: list[str], buckets: int) -> tuple[str, list[int]]:
    """Write rows into a new folder with one below it for each bucket; its name, and the buckets that have rows."""
    folder = f"rows-{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    found = rows.sparkSession.read.parquet(f"{root}/{folder}") if not _empty(rows.sparkSession, f"{root}/{folder}") else None
    return folder, [] if found is None else [r[0] for r in found.select("_bucket").distinct().collect()]  # at most `buckets`


def _empty(spark: SparkSession, path: str) -> bool:
    return spark.read.schema("_bucket int").parquet(path).isEmpty()


def _commit(spark: SparkSession, root: str, seq: int, buckets: int, places: dict[int, str]) -> None:
    """Add one file to the manifest; Spark gives it its name only when it is whole."""
    rows = [(seq, buckets, b, f) for b, f in sorted(places.items())] or [(seq, buckets, -1, "")]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _manifest(spark: SparkSession, root: str) -> tuple[int, int, dict[int, str]]:
    """The last commit's number, how many buckets there are, and each one's folder."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").groupBy("bucket").agg(F.max("seq").alias("seq"), F.max("buckets").alias("n"), F.max_by("folder", "seq").alias("folder")).collect()
    return max(r["seq"] for r in rows), rows[0]["n"], {r["bucket"]: r["folder"] for r in rows if r["bucket"] >= 0}


def create_store(rows: DataFrame, root: str, keys: list[str], buckets: int = 64) -> None:
    """A new store of rows, which have one for each key (see upsert_latest); buckets: how many parts it has from now on."""
    folder, used = _written(rows, root, keys, buckets)
    _commit(rows.sparkSession, root, 0, buckets, {b: folder for b in used})
    rows.sparkSession.createDataFrame([(c, t) for c, t in rows.dtypes], "name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{root}/columns")


def _read(spark: SparkSession, root: str, places: dict[int, str]) -> DataFrame:
    if not places:
        kinds = spark.read.schema("name string, kind string").parquet(f"{root}/columns").collect()
        return spark.createDataFrame([], ", ".join(f"`{r['name']}` {r['kind']}" for r in kinds))
    return spark.read.option("mergeSchema", "true").parquet(*(f"{root}/{f}/_bucket={b}" for b, f in sorted(places.items())))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The rows as of the last commit."""
    return _read(spark, root, _manifest(spark, root)[2])


def upsert_store(delta: DataFrame, root: str, keys: list[str], ts: str, created: str | None = None) -> int:
    """Bring the store up to date with delta: of each key the latest row by ts stays (delta's at equal times), created keeps
    its earliest value. Returns how many buckets were written anew. Columns that only one side has are null for the other."""
    spark = delta.sparkSession
    seq, buckets, places = _manifest(spark, root)
    touched = [r[0] for r in delta.select(_bucket(keys, buckets).alias("b")).distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    base = _read(spark, root, {b: places[b] for b in touched if b in places})
    folder, used = _written(upsert_latest(base, delta, keys, ts, created), root, keys, buckets)
    _commit(spark, root, seq + 1, buckets, {b: folder for b in used})
    return len(used)


def replace_in_store(rows: DataFrame, root: str, keys: list[str], buckets: int = 64) -> int:
    """Put rows in the place of all that the store has for their keys (any number for each); other keys' rows stay. A store that
    is not there is begun. Returns how many buckets were written."""
    spark = rows.sparkSession
    try:
        seq, buckets, places = _manifest(spark, root)
    except AnalysisException:  # no such folder
        seq, places = -1, {}
    mine = rows.select(*keys).distinct()
    touched = [r[0] for r in mine.select(_bucket(keys, buckets).alias("b")).distinct().collect()]  # at most `buckets`
    there, every = {b: places[b] for b in touched if b in places}, rows
    if there:
        old, new = _read(spark, root, there), mine.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        every = rows.unionByName(old.join(new, same, "left_anti"), allowMissingColumns=True)
    if seq < 0 and not touched:
        create_store(rows, root, keys, buckets)
        return 0
    folder, used = _written(every, root, keys, buckets)
    _commit(spark, root, seq + 1, buckets, {b: folder for b in used})
    return len(used)
