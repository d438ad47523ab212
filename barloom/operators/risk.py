"""Return-based risk figures, drawdowns and the comparison with buy and hold."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import linear_quantile, rank_table
from barloom.functions.rolling import Roll, rolling
from barloom.functions.windows import EPS, Axis, extend, in_segments, is_daily, num
from barloom.operators.ledger import KEYS, RISK_FREE

# Periods per year.
PERIODS = {"daily": 252, "weekly": 52, "monthly": 12, "hourly": 1638}


def sharpe(mean: str, std: str, count: str, periods: int = 252) -> str:
    """Annualised ratio from aggregates of excess returns; a flat series gives +-1e6, under two values 0."""
    return (
        f"CASE WHEN {count} < 2 THEN 0D WHEN {std} < 1e-10D THEN signum({mean}) * 1e6D"
        f" ELSE {num(math.sqrt(periods))} * ({mean}) / {std} END"
    )


class Figures(NamedTuple):
    """Aggregates of one part of a report, the figures made from them and when a key has them; several parts share one pass."""

    measures: dict[str, str]
    shown: tuple[str, ...]
    known: str = "true"


def summarise(df: DataFrame, keys: Sequence[str], *parts: Figures) -> DataFrame:
    """The figures of all parts per key, from one aggregation."""
    measures = {name: text for part in parts for name, text in part.measures.items()}
    table = df.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in measures.items()])
    return table.where(" AND ".join(part.known for part in parts)).selectExpr(*keys, *[text for part in parts for text in part.shown])


def risk_ratios(
    returns: DataFrame,
    keys: Sequence[str] = KEYS,
    column: str = "net_ret",
    risk_free: float = RISK_FREE,
    frequency: str = "daily",
) -> DataFrame:
    """Sharpe, Sortino and Omega per key."""
    return summarise(returns, keys, ratio_figures(column, risk_free, frequency))


def ratio_figures(column: str = "net_ret", risk_free: float = RISK_FREE, frequency: str = "daily") -> Figures:
    if frequency not in PERIODS:
        raise ValueError(f"unknown frequency {frequency!r}, expected one of {sorted(PERIODS)}")
    periods = PERIODS[frequency]
    hurdle = num(risk_free / periods)
    known = f"{column} IS NOT NULL AND NOT isnan({column})"
    measures = {
        "_mean": f"avg({column} - {hurdle}) FILTER (WHERE {known})",
        "_std": f"stddev_samp({column} - {hurdle}) FILTER (WHERE {known})",
        "_down": f"stddev_pop({column} - {hurdle}) FILTER (WHERE {known} AND {column} < {hurdle})",
        "_gain": f"sum(greatest({column} - {hurdle}, 0D)) FILTER (WHERE {known})",
        "_loss": f"sum(greatest({hurdle} - {column}, 0D)) FILTER (WHERE {known})",
        "_returns": f"count_if({known})",
    }
    shown = (
        "_returns AS n",
        f"{sharpe('_mean', '_std', '_returns', periods)} AS sharpe",
        f"{num(math.sqrt(periods))} * _mean / (_down + {EPS}) AS sortino",
        "CASE WHEN _returns < 2 THEN 1D WHEN _loss >= 1e-12D THEN _gain / _loss WHEN _gain > 0 THEN double('Infinity')"
        " ELSE 1D END AS omega",
    )
    return Figures(measures, shown, "_returns > 0")


def tail_risk(
    returns: DataFrame, keys: Sequence[str] = KEYS, column: str = "net_ret", level: float = 0.95
) -> DataFrame:
    """Value at risk and expected shortfall as positive losses, from an exact interpolated quantile."""
    bounded = "ticker" in keys and is_daily(returns)
    table = rank_table(returns, keys, column, bounded=bounded)
    if bounded:
        whole = Window.partitionBy(*keys)
        cut = table.withColumns({"_cut": linear_quantile(column, 1.0 - level, whole), "_n": F.col("n")})
    else:
        cuts = table.groupBy(*keys).agg(linear_quantile(column, 1.0 - level).alias("_cut"), F.max("n").alias("_n"))
        cut = table.join(cuts, list(keys))
    tail = cut.groupBy(*keys).agg(
        F.max("_cut").alias("_cut"),
        F.max("_n").alias("_n"),
        F.expr(f"sum({column} * cnt) FILTER (WHERE {column} <= _cut)").alias("_sum"),
        F.expr(f"sum(cnt) FILTER (WHERE {column} <= _cut)").alias("_rows"),
    )
    return tail.selectExpr(
        *keys,
        "CASE WHEN _n < 2 THEN 0D ELSE -_cut END AS var_95",
        "CASE WHEN _n < 2 THEN 0D ELSE coalesce(-try_divide(_sum, _rows), -_cut) END AS cvar_95",
    )


def drawdowns(booked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Depth, average, duration and recovery of the deepest drawdown; needs ``pos``."""
    worst = booked.groupBy(*keys).agg(
        F.expr("min(struct(underwater, pos, peak))").alias("_worst"),
        F.expr("coalesce(avg(underwater) FILTER (WHERE underwater < 0), 0D)").alias("avg_dd"),
    )
    at_peak = "equity >= _worst.peak - 1e-10D"
    around = booked.join(worst, list(keys)).groupBy(*keys).agg(
        F.expr("max(_worst.underwater)").alias("max_dd"),
        F.expr("max(avg_dd)").alias("avg_dd"),
        F.expr("max(_worst.pos)").alias("_trough"),
        F.expr(f"max(pos) FILTER (WHERE pos <= _worst.pos AND {at_peak})").alias("_top"),
        F.expr(f"min(pos) FILTER (WHERE pos > _worst.pos AND {at_peak})").alias("_back"),
    )
    return around.selectExpr(
        *keys,
        "max_dd",
        "avg_dd",
        "_trough - coalesce(_top, 0) AS max_dd_duration",
        "_back - _trough AS max_dd_recovery",
    )


def total_returns(booked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Total and annualised return and Calmar ratio of the equity curve."""
    return summarise(booked, keys, total_figures())


def total_figures() -> Figures:
    yearly = "(pow(_last, 252D / (_bars + 1)) - 1)"
    return Figures(
        {"_last": "max_by(equity, date)", "_bars": "count(1)", "_deepest": "min(underwater)"},
        ("_last - 1 AS total_ret", f"{yearly} AS ann_ret", f"{yearly} / (abs(_deepest) + {EPS}) AS calmar"),
    )


def benchmark(booked: DataFrame, keys: Sequence[str] = KEYS, risk_free: float = RISK_FREE) -> DataFrame:
    """Buy and hold over the same bars: returns, Sharpe, beta, alpha, information ratio, excess."""
    hurdle = num(risk_free / 252)
    paired = extend(booked, {"_hold": f"(next_close - close) / (close + {EPS})"})
    stats = paired.groupBy(*keys).agg(
        F.expr("max_by(next_close, date) / min_by(close, date)").alias("_hold_growth"),
        F.count(F.lit(1)).alias("_n"),
        F.expr(f"avg(_hold - {hurdle})").alias("_hold_mean"),
        F.expr(f"stddev_samp(_hold - {hurdle})").alias("_hold_std"),
        F.expr("covar_samp(net_ret, _hold)").alias("_cov"),
        F.expr("var_samp(_hold)").alias("_var"),
        F.expr("avg(net_ret - _hold)").alias("_active"),
        F.expr("stddev_samp(net_ret - _hold)").alias("_active_std"),
        F.product(1 + F.col("net_ret")).alias("_growth"),
        F.product(1 + F.col("_hold")).alias("_hold_product"),
    )
    stats = extend(
        stats,
        {
            "bh_total_ret": "_hold_growth - 1",
            "bh_ann_ret": "pow(_hold_growth, 252D / (_n + 1)) - 1",
            "bh_sharpe": sharpe("_hold_mean", "_hold_std", "_n"),
            "beta": "CASE WHEN _var > 1e-12D THEN _cov / _var ELSE 1D END",
            "_capital": "greatest(_growth, 1e-12D)",
        },
    )
    return stats.selectExpr(
        *keys,
        "bh_total_ret",
        "bh_ann_ret",
        "bh_sharpe",
        "beta",
        "pow(_capital, 252D / (_n + 1)) - 1 - beta * bh_ann_ret AS alpha",
        f"CASE WHEN _active_std > 1e-10D THEN {num(math.sqrt(252))} * _active / _active_std ELSE 0D END"
        " AS information_ratio",
        "_capital - _hold_product AS excess_vs_bh",
    )


def rolling_sharpe(
    booked: DataFrame, rows: int = 63, risk_free: float = RISK_FREE, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add ``rolling_sharpe`` over the trailing ``rows`` bars; null before the first full window."""
    total, spread = Roll("sum", "_excess", rows), Roll("m2", "_excess", rows)

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        panel = extend(panel, {"_excess": f"net_ret - {num(risk_free / 252)}"})
        panel = rolling(panel, axis, [total, spread])
        ratio = sharpe(f"{total.name} / {rows}", f"sqrt({spread.name} / {rows - 1})", str(rows))
        return extend(panel, {"rolling_sharpe": f"CASE WHEN pos >= {rows - 1} THEN {ratio} END"})

    shown = in_segments(booked.drop("seg"), stage, back=rows, keys=keys, blocks=False)
    return shown.select(*[c for c in booked.columns if c not in ("pos", "n", "seg")], "rolling_sharpe")


def buy_and_hold_curve(bars: DataFrame) -> DataFrame:
    """Close relative to the ticker's first close."""
    first = bars.groupBy("ticker").agg(F.min_by("close", "date").alias("_first"))
    return bars.join(first, "ticker").selectExpr("ticker", "date", "close / _first AS growth")
