"""The registered queries of the corpus operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_duplicates, licenses, near_duplicates, packing, page_text, periodic_runs, pseudo_likelihood, token_counts, token_records, toxicity, web_archives, whitening
from .common import table


def op1_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("accepted")


def op4_wacz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archives.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op5_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op6_cross_polytope_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates.embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_record_digests(table(spark, sf_dir, "documents"), end_id=2)


def op8_crf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: of about a tenth of the texts, chosen by their ids' checksums, the words from some place on repeat.

    h = crc32 of the decimal id, g = h / 10 rounded down. If h % 10 is 0 and the text has n > 0 words, each word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8) rounded down. Others stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    some = some.withColumns({"_n": n, "_a": (g % F.nullif(n, F.lit(0))).cast("int"), "_d": (F.lit(3) + g % 8).cast("int")})
    some = some.withColumns({"_m": F.col("_n") - F.col("_a"), "_p": (F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / F.col("_d"))).cast("int")})
    times = F.ceil(F.col("_m") / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), F.col("_m"))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")
    return some.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_grammar_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(with_repeats(table(spark, sf_dir, "documents")), least=12)


def op12_spectrum_slicing_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"), components=16)


def op13_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_budget(table(spark, sf_dir, "documents"), limit=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weak_supervision_toxicity": op1_weak_supervision_toxicity,
    "op2_suffix_automaton_decontamination": op2_suffix_automaton_decontamination,
    "op3_license_templates": op3_license_templates,
    "op4_wacz_round_trip": op4_wacz_round_trip,
    "op5_best_two_fit_packing": op5_best_two_fit_packing,
    "op6_cross_polytope_near_dedup": op6_cross_polytope_near_dedup,
    "op7_token_records": op7_token_records,
    "op8_crf_page_text": op8_crf_page_text,
    "op9_masked_pseudo_likelihood": op9_masked_pseudo_likelihood,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_grammar_run_detection": op11_grammar_run_detection,
    "op12_spectrum_slicing_whitening": op12_spectrum_slicing_whitening,
    "op13_prefix_token_counts": op13_prefix_token_counts,
}

ORACLE: dict[str, str] = {
    "op6_cross_polytope_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, comp.c AS component_id, vec_id = comp.c AS kept
        FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
}
