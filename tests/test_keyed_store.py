"""A store that is brought up to date by touched buckets."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuewright.sources import keyed_store as K
from cuewright.sources import subtitles as S

SCHEMA = "id long, kind string, value long, at timestamp, since timestamp"


def _t(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def _files(root):
    return {p.relative_to(root).as_posix(): p.stat().st_mtime_ns for p in Path(root).rglob("part-*.parquet") if "rows-" in str(p)}


def _referred(spark, root):
    return set(K._manifest(spark, root)[2].items())


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [(k, "x", k, _t(0), _t(0)) for k in range(200)] + [(None, "x", 7, _t(0), _t(0))]
    K.create_store(spark.createDataFrame(rows, SCHEMA), root, ["id", "kind"], buckets=8)
    before, places = _files(root), _referred(spark, root)
    delta = spark.createDataFrame([(3, "x", 33, _t(1), _t(5)), (3, "x", 30, _t(-1), _t(-2)), (999, "new", 1, _t(1), _t(1)), (None, "x", 8, _t(0), _t(0))], SCHEMA)
    written = K.upsert_store(delta, root, ["id", "kind"], "at", "since")
    after = _files(root)
    assert 1 <= written <= 3 and before.items() <= after.items()  # no file of before has gone or changed
    assert len(_referred(spark, root) & places) == 8 - written
    got = {(r["id"], r["kind"]): (r["value"], r["at"], r["since"]) for r in K.read_store(spark, root).collect()}
    want = {(k, kind): (v, at, since) for k, kind, v, at, since in rows}
    want |= {(3, "x"): (33, _t(1), _t(-2)), (999, "new"): (1, _t(1), _t(1)), (None, "x"): (8, _t(0), _t(0))}
    assert got == want
    assert K.upsert_store(delta.limit(0), root, ["id", "kind"], "at") == 0 and _files(root) == after


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(k, "x", k, _t(0), _t(0)) for k in range(50)], SCHEMA)
    K.create_store(rows, root, ["id"], buckets=4)
    broken = rows.withColumns({"at": F.lit(_t(9)), "value": F.when(F.col("id") == 49, F.raise_error(F.lit("lost")).cast("long")).otherwise(-1)})
    with pytest.raises(Exception, match="lost"):
        K.upsert_store(broken, root, ["id"], "at")
    assert sorted(tuple(r) for r in K.read_store(spark, root).collect()) == sorted(tuple(r) for r in rows.collect())
    K.upsert_store(rows.withColumn("at", F.lit(_t(1))).withColumn("value", F.lit(5)), root, ["id"], "at")
    assert {r["value"] for r in K.read_store(spark, root).collect()} == {5}


def test_empty_stores_and_new_columns(spark, tmp_path):
    root = str(tmp_path / "store")
    empty = spark.createDataFrame([], SCHEMA)
    K.create_store(empty, root, ["id"], buckets=4)
    assert K.read_store(spark, root).columns == empty.columns and K.read_store(spark, root).count() == 0
    K.upsert_store(spark.createDataFrame([(1, "x", 1, _t(0), _t(0))], SCHEMA), root, ["id"], "at")
    K.upsert_store(spark.createDataFrame([(2, "x", 1, _t(0), _t(0), "more")], SCHEMA + ", extra string"), root, ["id"], "at")
    assert {(r["id"], r["extra"]) for r in K.read_store(spark, root).collect()} == {(1, None), (2, "more")}


def test_stages_share_a_bounded_number_of_folders(spark, tmp_path):
    d = lambda tracks, text: spark.createDataFrame([(t, k, f"{text}{k}") for t in tracks for k in range(3)], "track_id long, seg_idx long, text string")
    S.write_stage(d(range(300), "a"), str(tmp_path), "transcribe", 8)
    S.write_stage(d([5, 6, 400], "b"), str(tmp_path), "transcribe", 8)
    got = S.read_stage(spark, str(tmp_path), "transcribe")
    assert got.count() == 3 * 301 and got.filter("text LIKE 'b%'").select("track_id").distinct().count() == 3
    assert len({p for p in Path(tmp_path).rglob("_bucket=*")}) <= 8 + 3
    assert S.pending_tracks(d([5, 401], ""), got).collect()[0][0] == 401
