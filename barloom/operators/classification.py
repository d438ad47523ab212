"""Classification quality of scores ``(model, ticker, date, p, y)``; one row per key unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranks import bucket_ranks, linear_quantile, over_lower, rank_table, value_bucket, with_mid_rank
from barloom.functions.windows import extend, is_daily, num

MODEL = ("model",)


def _daily(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key holds at most one row a day and model, so that its rows are few."""
    return {"model", "ticker"} <= set(keys) and is_daily(df)


def predictions(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``prob`` (missing or infinite becomes 0.5) and ``pred``."""
    prob = "CASE WHEN p IS NULL OR isnan(p) OR abs(p) = double('Infinity') THEN 0.5D ELSE p END"
    return extend(extend(scores, {"prob": prob}), {"pred": f"int(prob >= {num(threshold)})"})


def classification_metrics(scores: DataFrame, keys: Sequence[str] = MODEL, threshold: float = 0.5) -> DataFrame:
    """Accuracy, F1 for both classes and Brier score; an empty class scores 0."""
    counted = predictions(scores, threshold).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("avg(double(pred = y))").alias("accuracy"),
        F.expr("count_if(pred = 1 AND y = 1)").alias("_tp"),
        F.expr("count_if(pred = 0 AND y = 0)").alias("_tn"),
        F.expr("count_if(pred <> y)").alias("_wrong"),
        F.expr("avg((prob - y) * (prob - y))").alias("brier"),
    )
    return counted.selectExpr(
        *keys,
        "n",
        "accuracy",
        "coalesce(try_divide(2D * _tp, 2 * _tp + _wrong), 0D) AS f1_up",
        "coalesce(try_divide(2D * _tn, 2 * _tn + _wrong), 0D) AS f1_down",
        "brier",
    )


def confusion(scores: DataFrame, keys: Sequence[str] = MODEL, threshold: float = 0.5) -> DataFrame:
    return predictions(scores, threshold).groupBy(*keys, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_report(scores: DataFrame, keys: Sequence[str] = MODEL, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and support per class."""
    sides = predictions(scores, threshold).selectExpr(
        *keys, "explode(array(0, 1)) AS class", "y", "pred"
    )
    counted = sides.groupBy(*keys, "class").agg(
        F.expr("count_if(pred = class AND y = class)").alias("_hit"),
        F.expr("count_if(pred = class)").alias("_said"),
        F.expr("count_if(y = class)").alias("support"),
    )
    return counted.selectExpr(
        *keys,
        "class",
        "coalesce(try_divide(_hit, _said), 0D) AS precision",
        "coalesce(try_divide(_hit, support), 0D) AS recall",
        "support",
    )


def auc(scores: DataFrame, keys: Sequence[str] = MODEL, tasks: int | None = None) -> DataFrame:
    """ROC area from ranks; 0.5 when a class is missing. Works on distinct scores, not on rows. A missing or infinite score
    counts as 0.5, as in the other figures.

    Daily keys are ranked where they lie. Others cross one shuffle in ``tasks`` tasks, and only totals of value buckets meet per key.
    """
    sides = {"pos": F.expr("int(y = 1)"), "neg": F.expr("int(y = 0)")}
    if _daily(scores, keys):
        table = rank_table(predictions(scores), keys, "prob", sides, bounded=True)
        area = table.groupBy(*keys).agg(
            F.expr("sum(pos * (below_neg + neg / 2D))").alias("_area"),
            F.expr("max(all_pos) * double(max(all_neg))").alias("_pairs"),
        )
    else:
        dealt = [c for c in ("ticker",) if c in scores.columns and c not in keys]
        ranked = bucket_ranks(predictions(scores), keys, "prob", sides, "neg", tasks, dealt)
        buckets = ranked.groupBy(*keys, "_vb").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.expr("sum(pos * (inside + neg / 2D))").alias("_inside")
        )
        area = over_lower(buckets, keys, "neg").groupBy(*keys).agg(
            F.expr("sum(_inside + pos * lower)").alias("_area"), F.expr("sum(pos) * double(sum(neg))").alias("_pairs")
        )
    return area.selectExpr(*keys, "coalesce(try_divide(_area, _pairs), 0.5D) AS auc")


def roc_points(scores: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score (0.5 where missing): rates when rows at or above it count as positive."""
    sides = {"pos": F.expr("int(y = 1)"), "neg": F.expr("int(y = 0)")}
    table = rank_table(predictions(scores), keys, "prob", sides, bounded=_daily(scores, keys))
    return table.selectExpr(
        *keys,
        "prob AS threshold",
        "try_divide(all_neg - below_neg, all_neg) AS fpr",
        "try_divide(all_pos - below_pos, all_pos) AS tpr",
    )


def rank_ic(
    scored_returns: DataFrame, keys: Sequence[str] = MODEL, realised: str = "realised", tasks: int | None = None
) -> DataFrame:
    """Spearman correlation of ``p`` and the realised return; 0 under five rows or for constant input.

    Rows get the rank of their return, and these are summed by distinct ``p``: the products of ranks follow from the sums, so ranks
    of ``p`` are not joined back to the rows. Daily keys are ranked where they lie. For others rows are dealt twice, in ``tasks``
    tasks: by buckets of the return and by buckets of ``p``.
    """
    keys = list(keys)
    complete = scored_returns.where(f"p IS NOT NULL AND {realised} IS NOT NULL")
    if _daily(complete, keys):
        ranked = with_mid_rank(complete.select(*keys, "p", realised), keys, realised, "_rr", True, centred=True)
        stats = _rank_sums(ranked, keys)
    else:
        stats = _bucket_rank_sums(_bucket_mid_ranks(complete.select(*keys, "p", realised), keys, realised, tasks), keys, tasks)
    return stats.selectExpr(*keys, "CASE WHEN _n < 5 THEN 0D ELSE coalesce(nanvl(_ic, 0D), 0D) END AS ic")


def _bucket_mid_ranks(rows: DataFrame, keys: Sequence[str], value: str, tasks: int | None) -> DataFrame:
    """Rows with ``_yb``, a bucket of ``value``, and ``_rr``, its average rank within the key less the mean rank (null for NaN).

    Rows are ranked inside their buckets; bucket totals come from the same shuffle and are joined back by bucket.
    """
    known = rows.where(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))
    bucket = F.coalesce(F.when(~F.isnan(value), value_bucket(F.col(value))), F.lit(_NAN_BUCKET))
    bucketed = known.withColumn("_yb", bucket)
    spread = bucketed.repartition(tasks, *keys, "_yb") if tasks else bucketed.repartition(*keys, "_yb")
    # every column is asked for and none filtered, so that both readers want the same shuffle and Spark makes it once
    ranked_rows = f"count_if(p IS NOT NULL AND NOT isnan(`{value}`)) AS cnt"
    counted = spread.groupBy(*keys, "_yb").agg(F.expr(ranked_rows))
    ordered = f"OVER (PARTITION BY {', '.join(keys)}, _yb ORDER BY `{value}`"
    inside = f"rank() {ordered}) + (count(1) {ordered} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2D"
    ranked = extend(spread, {"_inside": inside}).join(over_lower(counted, keys, "cnt", "_yb").drop("cnt"), [*keys, "_yb"])
    return extend(ranked, {"_rr": f"CASE WHEN _yb <> {_NAN_BUCKET} THEN _inside + lower - (whole + 1) / 2D END"}).drop("_inside", "lower", "whole")


_RANK_SUMS = {"_k": "double(_rr IS NOT NULL)", "_y": "coalesce(_rr, 0D)", "_yy": "coalesce(_rr * _rr, 0D)"}
# Above every bucket of a number.
_NAN_BUCKET = 1 << 62


def _bucket_rank_sums(ranked: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """``_rank_sums`` with ranks of ``p`` inside value buckets; what lower buckets add to the ranks enters by the bucket totals."""
    placed = extend(ranked, {"_nan": "isnan(p)", "_p": "nanvl(p, 0D)"})
    sums = {"cnt": F.lit(1), **{name: F.expr(text) for name, text in _RANK_SUMS.items()}}
    inside = bucket_ranks(placed, [*keys, "_nan"], "_p", sums, "cnt", tasks, ["_yb"])
    inside = extend(inside, {"_x": "inside + (cnt + 1) / 2D"})
    texts = {"cnt": "cnt", "k": "_k", "x": "_k * _x", "xx": "_k * _x * _x", "y": "_y", "yy": "_yy", "xy": "_x * _y"}
    buckets = inside.groupBy(*keys, "_nan", "_vb").agg(*[F.expr(f"sum({text})").alias(f"_b{name}") for name, text in texts.items()])
    moved = extend(over_lower(buckets, [*keys, "_nan"], "_bcnt"), {"_s": "lower - (whole + 1) / 2D"})
    return _correlated(moved, keys, "_bcnt", {
        "k": "_bk", "x": "_bx + _s * _bk", "xx": "_bxx + 2 * _s * _bx + _s * _s * _bk", "y": "_by", "yy": "_byy", "xy": "_bxy + _s * _by",
    })


def _rank_sums(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _ic, _n): correlation of the ranks of ``p`` with the centred ranks ``_rr``. NaN has no rank; such rows count in ``_n`` only."""
    placed = extend(ranked, {"_nan": "isnan(p)", "_p": "nanvl(p, 0D)"})
    table = rank_table(placed, [*keys, "_nan"], "_p", {name: F.expr(text) for name, text in _RANK_SUMS.items()}, True)
    table = extend(table, {"_x": "below + (cnt + 1) / 2D - (n + 1) / 2D"})
    texts = {"k": "_k", "x": "_k * _x", "xx": "_k * _x * _x", "y": "_y", "yy": "_yy", "xy": "_x * _y"}
    return _correlated(table, keys, "cnt", texts)


def _correlated(table: DataFrame, keys: Sequence[str], count: str, texts: dict[str, str]) -> DataFrame:
    """(keys, _ic, _n) from the terms of sums of rows, ranks, squares and products."""
    known = "FILTER (WHERE NOT _nan)"
    totals = table.groupBy(*keys).agg(
        F.sum(count).alias("_n"), *[F.expr(f"sum({text}) {known}").alias(name) for name, text in texts.items()]
    )
    # a constant column leaves rounding errors of the order of 1e-16 of its sum of squares
    spread = {c: f"CASE WHEN {c}{c} - {c} * {c} / k > 1e-13D * {c}{c} THEN {c}{c} - {c} * {c} / k END" for c in ("x", "y")}
    return extend(totals, {"_ic": f"CASE WHEN k > 0 THEN (xy - x * y / k) / sqrt(({spread['x']}) * ({spread['y']})) END"})


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Add ``bin``: the quantile interval of ``value`` within its key, equal edges merged.

    Edges are exact; the edge list has ``bins + 1`` entries per key.
    """
    table = rank_table(df, keys, value)
    marks = [linear_quantile(value, i / bins).alias(f"_e{i}") for i in range(bins + 1)]
    edges = table.groupBy(*keys).agg(*marks).selectExpr(
        *keys, f"array_distinct(array({', '.join(f'_e{i}' for i in range(bins + 1))})) AS _edges"
    )
    below = f"greatest(size(filter(_edges, e -> e < `{value}`)) - 1, 0)"
    return extend(df.join(edges, list(keys)), {"bin": below}).drop("_edges")


def hit_rate_by_decile(
    scores: DataFrame, keys: Sequence[str] = MODEL, bins: int = 10, threshold: float = 0.5
) -> DataFrame:
    """Share of right calls and rows per confidence quantile; identical confidences form one bin."""
    rated = extend(
        scores.where("p IS NOT NULL"),
        {"confidence": "abs(p - 0.5D)", "hit": f"double(int(p >= {num(threshold)}) = y)"},
    )
    return quantile_bins(rated, keys, "confidence", bins).groupBy(*keys, F.col("bin").alias("decile")).agg(
        F.avg("hit").alias("hit_rate"), F.count(F.lit(1)).alias("n")
    )


def up_rate_by_decile(scores: DataFrame, keys: Sequence[str] = MODEL, bins: int = 10) -> DataFrame:
    binned = quantile_bins(scores.where("p IS NOT NULL"), keys, "p", bins)
    return binned.groupBy(*keys, F.col("bin").alias("decile")).agg(
        F.avg("y").alias("up_rate"), F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n")
    )


def calibration_table(scores: DataFrame, keys: Sequence[str] = MODEL, bins: int = 10) -> DataFrame:
    """Mean score and positive share per uniform bin; empty bins are absent."""
    placed = extend(scores.where("p IS NOT NULL"), {"bin": f"least(int(floor(p * {bins})), {bins - 1})"})
    return placed.groupBy(*keys, "bin").agg(
        F.avg("p").alias("mean_p"), F.avg("y").alias("positive_share"), F.count(F.lit(1)).alias("n")
    )


def confidence_labels(scores: DataFrame, threshold: float = 0.5, horizon: int = 1) -> DataFrame:
    """Direction, strength and horizon names; a row without a score has neither direction nor strength."""
    edge, lacking = "abs(p - 0.5D)", "p IS NULL OR isnan(p)"
    when = "TOMORROW" if horizon == 1 else "NEXT WEEK" if horizon <= 7 else "NEXT MONTH"
    return extend(
        scores,
        {
            "direction": f"CASE WHEN {lacking} THEN NULL WHEN p >= {num(threshold)} THEN 'UP' ELSE 'DOWN' END",
            "strength": f"CASE WHEN {lacking} THEN NULL WHEN {edge} > 0.2D THEN 'STRONG' WHEN {edge} > 0.1D THEN 'MODERATE' ELSE 'WEAK' END",
            "horizon": f"'{when}'",
        },
    )


def regime_accuracy(
    scores: DataFrame, regimes: DataFrame, keys: Sequence[str] = MODEL, min_rows: int = 10
) -> DataFrame:
    """Accuracy and share of up moves per market regime with at least ``min_rows`` bars."""
    tagged = predictions(scores).join(regimes.select("ticker", "date", "regime"), ["ticker", "date"])
    grouped = tagged.groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("avg(double(pred = y))").alias("accuracy"),
        F.expr("avg(y) * 100").alias("up_pct"),
    )
    return grouped.where(F.col("n") >= min_rows)
