"""Corpus pipeline: language, quality, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run``
writes what a stage returns as Parquet to the shared folder and reads it as the next stage's docs, so that the loss of
executors costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, jaccard, language, outliers, packing
from barloom.llm.common import small_side, stage, table

#: A language is taken as known from this share of the probability on.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; no letter, no text or an even split between languages rejects."""
    return language.keep_documents(docs, SURE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    return outliers.keep_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of linked documents (the join's own width and ratio).

    Rows without a doc_id stay; texts without words are linked with nothing and stay; of rows with the same doc_id and text
    the one that sorts first as JSON stays. Only ids are shuffled; texts are, where more ids go than can be broadcast.
    """
    found = jaccard.link(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("_head"), F.count(F.lit(1)).alias("_rows")
    )
    found = stage(found.where("NOT _head OR _rows > 1"), "classes")
    gone, again = found.where("NOT _head").select("_id"), found.where("_head").select("_id")
    kept = docs.join(small_side(gone), docs["doc_id"] == F.col("_id"), "left_anti")
    if not again.limit(1).count():
        return kept
    several = small_side(again)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = kept.join(several, kept["doc_id"] == F.col("_id"), "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("_text"))
    one = first.agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return kept.join(several, kept["doc_id"] == F.col("_id"), "left_anti").union(one)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
