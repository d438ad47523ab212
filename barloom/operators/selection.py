"""Feature scoring inside expanding inner folds and the combined selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranks import rank_table
from barloom.functions.windows import extend, num
from barloom.operators.scaling import melt

MI_WEIGHT, TREE_WEIGHT, TOP_K = 0.4, 0.6, 60


def _fold_ranks(long: DataFrame, folds: Sequence[int]) -> DataFrame:
    """Rank tables of all ``folds`` from one: a value is shuffled once, with its count in every fold."""
    counts = {f"c{f}": F.expr(f"int(fold = {f})") for f in folds}
    ups = {f"p{f}": F.expr(f"int(fold = {f} AND _y = 1)") for f in folds}
    table = rank_table(long, ["feature"], "value", counts | ups)
    cells = ", ".join(f"{f}, c{f}, below_c{f}, all_c{f}, p{f}, all_p{f}" for f in folds)
    return table.selectExpr("feature", f"stack({len(folds)}, {cells}) AS (fold, cnt, below, n, pos, all_pos)").where("cnt > 0")


def mutual_information(
    folded: DataFrame, columns: Sequence[str], label: str, bins: int = 10, folds: Sequence[int] | None = None
) -> DataFrame:
    """(fold, feature, mi) in nats between equal-frequency bins of a feature and a 0/1 label.

    Bins are cut on ranks with ties together, so only distinct values and bin counts are shuffled further. With the fold numbers
    given, a row that lies in several folds is shuffled once; other folds are then left out.
    """
    long = melt(folded, columns, ["fold", f"{label} AS _y"]).where("value IS NOT NULL AND _y IS NOT NULL")
    if folds:
        table = _fold_ranks(long, folds)
    else:
        table = rank_table(long, ["fold", "feature"], "value", {"pos": F.expr("int(_y = 1)")})
    binned = table.groupBy("fold", "feature", F.expr(f"int(floor(below * {bins} / n))").alias("bin")).agg(
        F.sum("cnt").alias("_rows"), F.sum("pos").alias("_pos"),
        F.max("n").alias("_n"), F.max("all_pos").alias("_all"),
    )

    def term(joint: str, margin: str) -> str:
        return f"CASE WHEN {joint} > 0 THEN {joint} / _n * ln(double({joint}) * _n / (double(_rows) * {margin})) ELSE 0D END"

    terms = extend(binned, {"_term": f"{term('_pos', '_all')} + {term('(_rows - _pos)', '(_n - _all)')}"})
    return terms.groupBy("fold", "feature").agg(F.sum("_term").alias("mi"))


def label_correlation(folded: DataFrame, columns: Sequence[str], label: str, column: str = "tree") -> DataFrame:
    """(fold, feature, ``column``): absolute correlation of a feature with the label; none where either is constant."""
    long = melt(folded, columns, ["fold", f"{label} AS _y"]).where("value IS NOT NULL AND _y IS NOT NULL")
    found = long.groupBy("fold", "feature").agg(
        F.expr("try_divide(covar_pop(value, _y), stddev_pop(value) * stddev_pop(_y))").alias("_corr"),
        F.expr("min(value) < max(value) AND min(_y) < max(_y)").alias("_varied"),
    )
    return found.select("fold", "feature", F.expr("CASE WHEN _varied THEN abs(_corr) END").alias(column))


def tree_importance(folded: DataFrame, columns: Sequence[str], label: str, folds: Sequence[int], trees: int = 20,
                    depth: int = 4, rate: float = 0.05) -> DataFrame:
    """(fold, feature, tree): boosted-tree importances, one distributed fit per inner fold.

    Folds without complete rows of both labels have no fit and no rows here.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        folded.dropna(subset=[*columns, label])
    ).persist()
    both = assembled.groupBy("fold").agg(F.count_distinct(label).alias("labels")).where("labels > 1")
    fitted = {r["fold"] for r in both.collect()}
    rows = []
    for fold in [f for f in folds if f in fitted]:
        model = GBTClassifier(
            labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
            featureSubsetStrategy="0.7", seed=42,
        ).fit(assembled.where(F.col("fold") == fold))
        rows += [(fold, c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    assembled.unpersist()
    return folded.sparkSession.createDataFrame(rows, "fold int, feature string, tree double")


def filled_scores(scores: DataFrame, folds: Sequence[int], columns: Sequence[str], column: str) -> DataFrame:
    """(fold, feature, ``column``) for all pairs: in a fold that could not be scored all features count 1, elsewhere a feature without a score 0."""
    grid = scores.sparkSession.createDataFrame([(int(f), c) for f in folds for c in columns], "fold int, feature string")
    scored = scores.groupBy("fold").agg(F.count(column).alias("_scored"))
    missing = F.when(F.coalesce("_scored", F.lit(0)) > 0, 0.0).otherwise(1.0)
    joined = grid.join(scores, ["fold", "feature"], "left").join(scored, "fold", "left")
    return joined.select("fold", "feature", F.coalesce(column, missing).alias(column))


def score_features(folded: DataFrame, columns: Sequence[str], label: str, **tree_options) -> DataFrame:
    """(feature, mi, tree): both scores, averaged over the inner folds of ``folded``; without any row all features count 1."""
    folds = sorted(r["fold"] for r in folded.select("fold").distinct().collect()) or [0]  # a handful of fold numbers
    mi = filled_scores(mutual_information(folded, columns, label, folds=folds), folds, columns, "mi")
    tree = filled_scores(tree_importance(folded, columns, label, folds, **tree_options), folds, columns, "tree")
    return average_scores(mi, "mi").join(average_scores(tree, "tree"), "feature")


def average_scores(scores: DataFrame, column: str) -> DataFrame:
    return scores.groupBy("feature").agg(F.avg(column).alias(column))


def select_top(scored: DataFrame, columns: Sequence[str], k: int = TOP_K, mi_weight: float = MI_WEIGHT,
               tree_weight: float = TREE_WEIGHT) -> DataFrame:
    """(ordinal, feature, combined): the ``k`` best by weighted normalised ranks, in column order.

    ``scored`` has one row per feature with ``mi`` and ``tree``, so ranking it is a tiny job.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")) - 1
    placed = scored.withColumn("ordinal", order)
    top = "greatest(count(1) OVER (PARTITION BY 1) - 1, 1)"
    ranks = {
        f"_{c}": f"(row_number() OVER (PARTITION BY 1 ORDER BY {c}, ordinal) - 1) / double({top})"
        for c in ("mi", "tree")
    }
    combined = extend(extend(placed, ranks), {"combined": f"{num(mi_weight)} * _mi + {num(tree_weight)} * _tree"})
    best = combined.orderBy(F.desc("combined"), F.desc("ordinal")).limit(k)
    return best.select("ordinal", "feature", "combined").orderBy("ordinal")


def top_features(importance: DataFrame, n: int = 25, column: str = "importance") -> DataFrame:
    return importance.orderBy(F.desc(column), "feature").limit(n)
