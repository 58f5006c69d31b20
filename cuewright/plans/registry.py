"""Registered queries of the timed-text operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .view_sql import with_views
from .views import Views

_KINDS = {"b": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "o": ("boolean", "BOOLEAN"), "t": ("timestamp_ntz", "TIMESTAMP")}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, columns: str, views: str = "", sql: str | None = None) -> Callable:
    """Register a function of Views. columns: names and kinds (b d s o t), in which both sides return them."""
    kinds = dict(c.split() for c in columns.split(", "))

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir)).select(*(F.col(c).cast(_KINDS[k][0]).alias(c) for c, k in kinds.items()))

        _QUERIES[name] = run
        if sql:
            cast = ", ".join(f'CAST("{c}" AS {_KINDS[k][1]}) AS "{c}"' for c, k in kinds.items())
            body = with_views(views, sql)
            _ORACLE[name] = f"SELECT {cast} FROM (\n{body}\n) AS q"
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to cues to slots: the modular flow over the conversations table."""
    from .flow import run_full

    return run_full(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_joins, queries_rows, queries_timeline  # noqa: F401  each registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)
