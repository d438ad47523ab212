"""Combining the scores of several models, all on long tables ``(model, ticker, date, p, y)``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import extend, num
from barloom.operators.classification import auc
from barloom.operators.logistic import linear, newton_logistic
from barloom.session import cut_lineage

BAR = ("ticker", "date")
TEMPERATURE, TOLERATED, PENALTY = 4.0, 0.5, 0.1


def probability_audit(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model: rows, null or NaN, infinite and out-of-range scores, and whether the model is known.

    Known models without a single score are listed with zero rows.
    """
    counted = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr("count_if(p IS NULL OR isnan(p))").alias("missing"),
        F.expr("count_if(abs(p) = double('Infinity'))").alias("infinite"),
        F.expr("count_if(p < 0 OR p > 1)").alias("out_of_range"),
    )
    known = scores.sparkSession.createDataFrame([(m,) for m in models], "model string")
    audit = counted.join(known.withColumn("known", F.lit(True)), "model", "full")
    return audit.na.fill(0).na.fill(False, ["known"])


def equal_mean(scores: DataFrame) -> DataFrame:
    """Mean over the models that scored the bar."""
    return scores.groupBy(*BAR).agg(F.expr("avg(nanvl(p, null))").alias("p"))


def score_matrix(scores: DataFrame, models: Sequence[str], **others: str) -> DataFrame:
    """One column per model, and ``others``: aggregates by name. The model list is given, so no job is needed to find it."""
    columns = [F.first(F.when(F.col("model") == m, F.col("p")), ignorenulls=True).alias(m) for m in models]
    return scores.groupBy(*BAR).agg(*columns, *[F.expr(text).alias(name) for name, text in others.items()])


def model_correlations(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """(left, right, corr) for every ordered pair, from one aggregation over the score matrix."""
    pairs = list(combinations(models, 2))
    row = score_matrix(scores, models).agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [f"'{x}', '{y}', _{i}" for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    return row.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (model, rival, corr)")


def ensemble_weights(scores: DataFrame, models: Sequence[str], tasks: int | None = None) -> DataFrame:
    """(model, auc, adjusted, weight): areas lowered for being close to a better model, then a softmax. ``tasks`` as in ``auc``."""
    everyone = "OVER (PARTITION BY 1)"  # a few models: one row each
    areas = extend(
        auc(scores.where(F.col("model").isin(list(models))), tasks=tasks),
        {"_areas": f"map_from_entries(collect_list(struct(model, auc)) {everyone})"},
    )
    fine = f"CASE WHEN _areas[rival] > auc THEN greatest(corr - {num(TOLERATED)}, 0D) ELSE 0D END"
    adjusted = (
        areas.join(model_correlations(scores, models), "model", "left")
        .groupBy("model", "auc")
        .agg(F.expr(f"auc - {num(PENALTY)} * sum(coalesce({fine}, 0D)) AS adjusted"))
    )
    raised = extend(adjusted, {"_raised": f"exp({TEMPERATURE} * (adjusted - avg(adjusted) {everyone}))"})
    return raised.selectExpr("model", "auc", "adjusted", f"_raised / sum(_raised) {everyone} AS weight")


def weighted_mean(scores: DataFrame, weights: DataFrame, parity: bool = False) -> DataFrame:
    """Weighted mean per bar over the models present, weights renormalised; null when none is (``parity=True``: 0).

    The weights are read as one small map: a join by model would put all rows of a model in one task.
    """
    lookup = weights.agg(F.map_from_entries(F.collect_list(F.struct("model", "weight")))).scalar()
    known = scores.withColumn("_weights", lookup).where("map_contains_key(_weights, model)")
    joined = extend(known, {"weight": "_weights[model]"})
    summed = joined.groupBy(*BAR).agg(
        F.expr("sum(weight * p) FILTER (WHERE p IS NOT NULL)").alias("_sum"),
        F.expr("sum(weight) FILTER (WHERE p IS NOT NULL)").alias("_weight"),
    )
    mean = "try_divide(_sum, _weight)"
    return summed.selectExpr(*BAR, f"{f'coalesce({mean}, 0D)' if parity else mean} AS p")


def platt_fit(scores: DataFrame, models: Sequence[str], c: float = 1.0) -> DataFrame:
    """(model, intercept, slope) of a one-feature logistic fit per model, all models in the same Newton steps."""
    known = scores.where(F.col("model").isin(list(models)) & ~F.isnan(F.coalesce("p", F.lit(0.0))))
    fitted = newton_logistic(known, ["p"], "y", ["model"], c)
    return fitted.selectExpr("model", "intercept", "weights[0] AS slope")


def calibrate(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """Replace ``p`` by its calibrated value; models without a calibration keep theirs. The calibration is read as one small map."""
    entry = F.struct("model", F.struct("intercept", "slope"))
    lookup = calibration.where("model IS NOT NULL").agg(F.map_from_entries(F.collect_list(entry))).scalar()
    joined = scores.withColumn("_of", lookup)
    value = "coalesce(1 / (1 + exp(-(_of[model].intercept + _of[model].slope * p))), p)"
    return joined.selectExpr(*[f"{value} AS p" if c == "p" else c for c in scores.columns])


def calibrated_mean(scores: DataFrame, calibration: DataFrame, weights: DataFrame) -> DataFrame:
    return weighted_mean(calibrate(scores, calibration), weights)


@dataclass(frozen=True)
class Stack:
    """Meta-model over standardised scores: one number of each kind per model."""

    models: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    intercept: float
    weights: tuple[float, ...]


def _complete(models: Sequence[str]) -> str:
    return " AND ".join(f"`{m}` IS NOT NULL AND NOT isnan(`{m}`)" for m in models)


def stack_fit(scores: DataFrame, models: Sequence[str], c: float = 0.5) -> Stack:
    """Logistic meta-model on standardised model columns; bars lacking a score are left out of the fit."""
    known = scores.where(" AND ".join(f"{c} IS NOT NULL" for c in BAR))
    matrix = cut_lineage(score_matrix(known, models, _label="double(max(y))").where(f"{_complete(models)} AND _label IS NOT NULL"))
    row = matrix.agg(*[f(m).alias(f"{name}_{i}") for i, m in enumerate(models) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if row["m_0"] is None:
        raise ValueError("no bar has a score of every model")
    means = tuple(row[f"m_{i}"] for i in range(len(models)))
    spreads = tuple(row[f"s_{i}"] or 1.0 for i in range(len(models)))
    scaled = matrix.selectExpr("1 AS _all", "_label", *[f"(`{m}` - {num(a)}) / {num(b)} AS `{m}`" for m, a, b in zip(models, means, spreads)])
    fitted = newton_logistic(scaled, models, "_label", ["_all"], c, cut=False).first()
    return Stack(tuple(models), means, spreads, fitted["intercept"], tuple(fitted["weights"]))


def stack_predict(model: Stack, scores: DataFrame) -> DataFrame:
    """Probability of the meta-model, one row per bar; where a score is lacking, ``p`` is null and ``missing`` true."""
    columns = [f"((`{m}` - {num(a)}) / {num(b)})" for m, a, b in zip(model.models, model.means, model.spreads)]
    whole = _complete(model.models)
    return score_matrix(scores, model.models).selectExpr(
        *BAR, f"CASE WHEN {whole} THEN {linear(model.intercept, model.weights, columns)} END AS p", f"NOT ({whole}) AS missing"
    )


def latest_forecast(scores: DataFrame) -> DataFrame:
    """Newest score there is per model and ticker with direction, strength and both consensus counts.

    A newest bar without a score does not hide the pair; ``age`` is the number of days from the score to the pair's newest bar.
    """
    known = "p IS NOT NULL AND NOT isnan(p)"
    newest = scores.groupBy("ticker", "model").agg(
        F.expr(f"max(date) FILTER (WHERE {known})").alias("date"),
        F.expr(f"max_by(p, date) FILTER (WHERE {known})").alias("p"),
        F.expr(f"datediff(max(date), max(date) FILTER (WHERE {known}))").alias("age"),
    )
    counts = newest.where("p IS NOT NULL").groupBy("ticker").agg(
        F.expr("count_if(p >= 0.5D)").alias("models_up"), F.expr("count_if(p < 0.5D)").alias("models_down")
    )
    edge = "abs(p - 0.5D)"
    named = extend(
        newest.where("p IS NOT NULL"),
        {
            "direction": "CASE WHEN p >= 0.5D THEN 'UP' ELSE 'DOWN' END",
            "strength": f"CASE WHEN {edge} > 0.2D THEN 'STRONG' WHEN {edge} > 0.1D THEN 'MODERATE' ELSE 'WEAK' END",
        },
    )
    return named.join(counts, "ticker")


def ticker_ranking(combined: DataFrame) -> DataFrame:
    """Tickers by their newest combined probability, with the top and bottom pick marked.

    Ranks come from the bucketed rank table, so no task sorts all tickers.
    """
    from barloom.functions.ranks import rank_table

    newest = combined.groupBy("ticker").agg(F.expr("max_by(p, date)").alias("p"))
    table = rank_table(newest.withColumn("_all", F.lit(1)), ["_all"], "p")
    placed = newest.join(
        table.selectExpr("p", "n - below - cnt + 1 AS rank", "n", "below"), "p"
    )
    pick = "CASE WHEN rank = 1 THEN 'top' WHEN below = 0 THEN 'avoid' ELSE '' END AS pick"
    return placed.selectExpr("ticker", "p", "rank", pick)


def best_model(metrics: DataFrame, baseline: str, metric: str = "accuracy") -> DataFrame:
    """The model with the best metric, the baseline left out."""
    rivals = metrics.where(F.col("model") != baseline)
    best = F.max_by("model", F.struct(F.col(metric), F.col("model")))
    return rivals.agg(best.alias("model"), F.max(metric).alias(metric))
