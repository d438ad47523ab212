"""Boosted-tree and logistic scoring, and linear attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import extend
from barloom.operators.histogram_trees import BoostedTrees, boosted_trees
from barloom.operators.scaling import melt
from barloom.operators.splits import early_stop_rows, positive_weight


def gbt_fit(
    train: DataFrame, columns: Sequence[str], label: str, trees: int = 600, depth: int = 3, rate: float = 0.02,
    subsample: float = 0.75, column_share: float = 0.70, min_child: int = 5, min_gain: float = 0.0, holdout: float = 0.10,
) -> BoostedTrees:
    """Boosted trees with positive-class weights; the last rows of each ticker decide when to stop."""
    marked = early_stop_rows(train.dropna(subset=[*columns, label]), holdout)
    weight = positive_weight(train, label).first()["pos_weight"]
    keyed = marked.withColumn("_key", F.xxhash64("ticker", "date", *columns))
    return boosted_trees(
        keyed, columns, label, weight, trees=trees, depth=depth, rate=rate, subsample=subsample,
        column_share=column_share, min_child=min_child, min_gain=min_gain,
    )


def logistic_fit(train: DataFrame, columns: Sequence[str], label: str, strength: float = 0.01):
    assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        train.dropna(subset=[*columns, label])
    )
    return LogisticRegression(labelCol=label, regParam=strength).fit(assembled)


def score(model, df: DataFrame, columns: Sequence[str], name: str, label: str | None = None) -> DataFrame:
    """(model, ticker, date, p[, y]) for rows with all features present."""
    whole = df.dropna(subset=list(columns))
    if isinstance(model, BoostedTrees):
        scored = whole.withColumn("p", model.probability())
    else:
        assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(whole)
        scored = model.transform(assembled).withColumn("p", vector_to_array("probability")[1])
    scored = scored.withColumn("model", F.lit(name))
    target = [] if label is None else [F.col(label).cast("int").alias("y")]
    return scored.select("model", "ticker", "date", "p", *target)


def linear_contributions(
    df: DataFrame, columns: Sequence[str], coefficients: DataFrame
) -> DataFrame:
    """(ticker, date, feature, value, contribution) with contribution = coefficient * (value - mean).

    ``coefficients`` has one row per feature; with the means it is read as one small map, so no row is shuffled.
    """
    long = melt(df, columns, ["ticker", "date"]).where("value IS NOT NULL")
    means = long.groupBy("feature").agg(F.avg("value").alias("_mean"))
    entry = F.struct("feature", F.struct("coefficient", "_mean"))
    lookup = means.join(coefficients, "feature").agg(F.map_from_entries(F.collect_list(entry))).scalar()
    scaled = long.withColumn("_of", lookup).where("map_contains_key(_of, feature)")
    return scaled.selectExpr(
        "ticker", "date", "feature", "value", "_of[feature].coefficient * (value - _of[feature]._mean) AS contribution"
    )


def mean_attribution(contributions: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute contribution."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def sample_rows(df: DataFrame, rows: int = 500, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows with the smallest hash of (seed, ticker, date): the same on every run."""
    keyed = extend(df, {"_hash": f"md5(concat_ws('-', '{seed}', ticker, date))"})
    return keyed.orderBy("_hash").limit(rows).drop("_hash")
