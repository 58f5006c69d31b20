"""A training-corpus pipeline of four stages over `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm import decontamination, near_duplicates, packing, toxicity
from cuewright.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not take for toxic."""
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of similarity 0.8 or more."""
    return near_duplicates.keep_one_of_each(docs, shingle_words=5, percent=80)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ten or more words of a benchmark item; mostly contaminated documents go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_span=9, max_coverage=0.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-two-fit packing of all that is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, capacity=2048, end_id=0, keep_chunks=150_000)  # workers come from other stages' work


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmarks),
    ("best_fit_packing", pack),
]

#: No stage can be said in SQL alone; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each one's rows are stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
