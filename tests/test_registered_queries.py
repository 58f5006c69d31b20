"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from cuewright.plans import registry
from tests.conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x.replace(tzinfo=None) if getattr(x, "tzinfo", None) else x


def key(row):
    return [(v is None, str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, TINY)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    q = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in q.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in q.fetchall()), key=key)
    assert sorted(names) == columns
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, TINY).count() > 0


def test_text_queries_take_whole_texts(spark):
    """Results equal the operators' on whole texts; some texts are longer than any bound of before."""
    from pyspark.sql import functions as F

    import __spark_entry__
    from cuewright.functions import text as T
    from cuewright.operators import joins as J
    from cuewright.operators import udfs as X
    from cuewright.plans.views import Views

    v = Views(spark, TINY)
    assert v.segments.selectExpr("max(length(text))").first()[0] > 200
    want = {
        "t15_format_lines": v.segments.withColumn("text", T.format_lines(F.col("text"))).select("track_id", "seg_idx", "text"),
        "x02_similarity_ratio": v.segments.withColumn("ratio", X.similarity_ratio(F.col("text"), F.expr("substring(text, 10)"))).select("track_id", "seg_idx", "ratio"),
        "j03_align_reference_text": J.align_reference(v.segments, v.ref_segments, mode="text").select("track_id", "seg_idx", "best_ref", "ratio", "status"),
    }
    for name, rows in want.items():
        got = __spark_entry__.queries()[name](spark, TINY).select(rows.columns)
        assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0
