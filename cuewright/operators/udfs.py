"""The surface for the caller's own functions, and the one measure without a native form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similarity_ratio(a: Column, b: Column) -> Column:
    """The Ratcliff-Obershelp ratio of two texts; null if either is."""
    return _ratio(a, b)


def map_text(df: DataFrame, fn: Callable[[str, object], str], in_col: str = "text", hints_col: str | None = None, out_col: str = "text_hi_raw") -> DataFrame:
    """Adds out_col = fn(text, hints) for rows with text; blank and null texts get null and fn is not called."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hints in batches:
            h = hints.to_dict("records") if isinstance(hints, pd.DataFrame) else list(hints)
            yield pd.Series([fn(t, x) if t and t.strip() else None for t, x in zip(texts, h, strict=True)])

    # not deterministic as far as Spark knows: it is neither called twice for one use nor copied into later expressions
    return df.withColumn(out_col, run.asNondeterministic()(F.col(in_col), F.col(hints_col) if hints_col else F.lit(None).cast("string")))


def with_retry_fallback(df: DataFrame, fns: list[Callable[[str, object], str]], is_bad: Callable[[Column, Column], Column], in_col: str = "text", out_col: str = "text_translated") -> DataFrame:
    """Each function runs only on rows that those before it left bad; at last the source text stands in.

    One pass: a row's text goes to the next function as null once a good text is found, so that no row meets a function
    twice, is lost or comes out twice, whatever the functions return.
    """
    names = set(df.columns) | {in_col, out_col}
    todo, tried = "_todo", "_tried"
    while {todo, tried} & names:
        todo, tried = "_" + todo, "_" + tried
    out = df.withColumn(out_col, F.lit(None).cast("string")).withColumn(todo, F.col(in_col))
    for fn in fns:
        out = map_text(out, fn, todo, None, tried)
        good = ~F.coalesce(is_bad(F.col(in_col), F.col(tried)), F.lit(True))
        out = out.withColumn(out_col, F.when(F.col(todo).isNotNull() & good, F.col(tried)).otherwise(F.col(out_col)))
        out = out.withColumn(todo, F.when(F.col(out_col).isNull(), F.col(todo)))
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.col(in_col))).drop(todo, tried)


def register_sql(spark: SparkSession) -> None:
    """similarity_ratio, and the native functions format_srt_time(ms) and overlap_ms(a, b, c, d), for SQL."""
    spark.udf.register("similarity_ratio", _ratio)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION format_srt_time(ms BIGINT) RETURNS STRING RETURN "
        "format_string('%02d:%02d:%02d,%03d', greatest(ms, 0L) div 3600000, (greatest(ms, 0L) div 60000) % 60, (greatest(ms, 0L) div 1000) % 60, greatest(ms, 0L) % 1000)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION overlap_ms(a BIGINT, b BIGINT, c BIGINT, d BIGINT) RETURNS BIGINT RETURN least(b, d) - greatest(a, c)")
