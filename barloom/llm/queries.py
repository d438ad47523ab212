"""Registered queries of the numbered operators: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import (
    centroids, decontaminate, jaccard, katz, language, licenses, outliers, packed, packing, piece_counts, spelling, toxicity, url_rules,
)
from barloom.llm.common import table


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.round_trip(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_text_hash", "hits")


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), divisor=97)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_heap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_rans_tokens": op1_rans_tokens,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_best_fit": op3_best_fit,
    "op4_url_rules": op4_url_rules,
    "op5_piece_counts": op5_piece_counts,
    "op6_decontaminate": op6_decontaminate,
    "op7_robust_outliers": op7_robust_outliers,
    "op8_licenses": op8_licenses,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_toxicity": op12_toxicity,
    "op13_heap_centroids": op13_heap_centroids,
}
