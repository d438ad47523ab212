"""Per-fold evaluation of scores over purged expanding folds; one job for all tickers and folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import EPS, extend, in_segments, num, running
from barloom.operators.boosting import Boosting, fold_predictions
from barloom.operators.classification import auc, predictions, rank_ic
from barloom.operators.features import ma_crossover_signal
from barloom.operators.splits import expanding_folds, fold_members
from barloom.session import cut_lineage

FOLD = ("ticker", "fold")
SCORED = ("model", *FOLD)


def fold_scores(bars: DataFrame, scores: DataFrame, **fold_options) -> DataFrame:
    """Test-window rows: score (0.5 where it is missing), label, next close return and the crossover baseline of the same window."""
    outlook = in_segments(
        bars,
        lambda panel, axis: extend(panel, {"realised": f"({axis.lead('close')} - close) / (close + {EPS})"}),
        ahead=1,
    )
    tests = fold_members(outlook, **fold_options).where("role = 'test'")
    baseline = ma_crossover_signal(tests.drop("pos", "role"), keys=FOLD).selectExpr(
        *FOLD, "date", "is_clean", "realised", "int(p) AS baseline"
    )
    rated = predictions(scores).selectExpr("model", "ticker", "date", "prob AS p", "y")
    return baseline.join(rated, ["ticker", "date"]).where("realised IS NOT NULL")


def fold_pnl(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``pred`` and the cost-free return of holding +1 or -1."""
    return extend(
        scored,
        {
            "pred": f"int(p >= {num(threshold)})",
            "pnl": f"CASE WHEN p >= {num(threshold)} THEN realised ELSE -realised END",
        },
    )


def fold_drawdown(traded: DataFrame, keys: Sequence[str] = SCORED) -> DataFrame:
    """Deepest drawdown of the compounded, floored fold returns."""
    dated = extend(traded, {"_year": "year(date)"})
    grown = running(dated, {"_cum": ("product", "1 + greatest(pnl, -0.99D)")}, keys, "_year", ("date",))
    peaked = running(grown, {"_peak": ("max", "_cum")}, keys, "_year", ("date",))
    return peaked.groupBy(*keys).agg(F.expr(f"min((_cum - _peak) / (_peak + {EPS}))").alias("max_dd"))


def walk_forward_table(bars: DataFrame, scores: DataFrame, purge: int = 5, seq_len: int = 50, horizon: int = 1,
                       walks: int = 8) -> DataFrame:
    """One row per model, ticker and fold: provenance, classification, trading and baseline figures."""
    options = dict(walks=walks, purge=purge, seq_len=seq_len, horizon=horizon)
    traded = cut_lineage(fold_pnl(fold_scores(bars, scores, **options)))
    root = num(math.sqrt(252))
    stats = traded.groupBy(*SCORED).agg(
        F.min("date").alias("test_start"),
        F.max("date").alias("test_end"),
        F.count(F.lit(1)).alias("te_rows"),
        F.expr("bool_and(is_clean)").alias("is_clean"),
        F.expr("avg(double(pred = y))").alias("acc"),
        F.expr("avg(double(baseline = y))").alias("baseline_acc"),
        F.expr("avg(y) * 100").alias("up_pct"),
        F.expr("avg(double(pnl > 0))").alias("win_rate"),
        F.avg("pnl").alias("_mean"),
        F.stddev_pop("pnl").alias("_std"),
        F.expr("stddev_pop(pnl) FILTER (WHERE pnl < 0)").alias("_down"),
        F.expr("count_if(pnl < 0)").alias("_losses"),
    )
    bounds = expanding_folds(bars, **options).select(*FOLD, "train_end", "gap")
    return (
        stats.join(auc(traded, SCORED), list(SCORED))
        .join(rank_ic(traded, SCORED), list(SCORED))
        .join(fold_drawdown(traded), list(SCORED))
        .join(bounds, list(FOLD))
        .selectExpr(
            *SCORED, "train_end AS tr_rows", "test_start", "test_end", "gap", "is_clean", "te_rows",
            "acc", "auc", "ic",
            f"CASE WHEN te_rows < 2 OR _std < 1e-10D THEN 0D ELSE _mean / _std * {root} END AS sharpe",
            f"CASE WHEN _losses < 2 OR _down < 1e-10D THEN 0D ELSE _mean / _down * {root} END AS sortino",
            "win_rate", "max_dd", "baseline_acc", "acc - baseline_acc AS vs_baseline", "up_pct",
        )
    )


def walk_forward_fitted(
    panel: DataFrame, features: Sequence[str], label: str, settings: Boosting = Boosting(), name: str = "boosted", **fold_options
) -> DataFrame:
    """``walk_forward_table`` of a model fitted anew on each fold's training bars, with what it was fitted on.

    ``panel`` has complete rows of bars, ``features`` and ``label``; folds are counted over these rows.
    """
    fits = cut_lineage(fold_predictions(panel, features, label, settings, **fold_options))
    scores = fits.join(panel.select("ticker", "date", label), ["ticker", "date"]).selectExpr(
        f"'{name}' AS model", "ticker", "date", "p", f"int({label}) AS y"
    )
    provenance = fits.groupBy(*FOLD).agg(
        *[F.max(c).alias(c) for c in ("train_start", "train_end", "pos_weight", "trees")]
    )
    table = walk_forward_table(panel, scores, **fold_options)
    return table.join(provenance, list(FOLD)).select("model", *FOLD, "train_start", "train_end", *table.columns[3:], "pos_weight", "trees")


def walk_forward_summary(table: DataFrame) -> DataFrame:
    """Mean and deviation of each figure per model over all folds, clean folds, and whether there is an edge."""
    figures = ("acc", "auc", "ic", "sharpe", "sortino", "win_rate", "max_dd", "baseline_acc", "vs_baseline")
    return table.groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if("is_clean").alias("clean_folds"),
        *[F.avg(f).alias(f"{f}_mean") for f in figures],
        *[F.stddev_samp(f).alias(f"{f}_std") for f in figures],
        F.expr("avg(vs_baseline) > 0").alias("positive_edge"),
    )
