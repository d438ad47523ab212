"""Assembled model reports, comparisons, health checks and the tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import extend, num
from barloom.operators.classification import auc, classification_metrics, rank_ic
from barloom.operators.features import build_features
from barloom.operators.ledger import KEYS, impact_bps, scenario_ledgers, trade_measures, trade_stats
from barloom.operators.risk import (
    Figures, benchmark, drawdowns, ratio_figures, risk_ratios, summarise, tail_risk, total_figures, total_returns,
)
from barloom.session import cut_lineage


def trading_metrics(booked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All ledger-based figures, one row per key."""
    on = list(keys)
    parts = [
        total_returns(booked, keys), drawdowns(booked, keys), tail_risk(booked, keys), trade_stats(booked, keys),
        benchmark(booked, keys),
    ]
    table = risk_ratios(booked, keys)
    for part in parts:
        table = table.join(part, on)
    return table


def model_report(scores: DataFrame, booked: DataFrame, keys: Sequence[str] = KEYS, digits: int = 6) -> DataFrame:
    """Classification, signal and trading figures in one flat row per key; infinities become text.

    Seven aggregations read the ledger, so its lineage is cut first.
    """
    on = list(keys)
    booked = cut_lineage(booked)
    realised = extend(booked, {"realised": "(next_close - close) / (close + 1e-9D)"})
    table = (
        classification_metrics(scores, keys).drop("n")
        .join(auc(scores, keys), on)
        .join(rank_ic(realised, keys), on)
        .join(trading_metrics(booked, keys), on)
    )
    shown = []
    for name, kind in table.dtypes:
        if name in ("omega", "profit_factor"):
            shown.append(
                f"CASE WHEN {name} = double('Infinity') THEN 'inf' ELSE string(round({name}, {digits})) END AS {name}"
            )
        else:
            shown.append(f"round({name}, {digits}) AS {name}" if kind == "double" else name)
    return table.selectExpr(*shown)


def compare_models(reports: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Rows sorted by a metric, best first."""
    return reports.orderBy(F.desc(metric), *[k for k in KEYS if k in reports.columns])


def cost_stress(held: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """Figures per cost level, difference to the cheapest level and the level where the Sharpe reaches zero.

    A third of the level is commission, the rest slippage; market impact comes on top. All figures come from one pass over the
    ledgers, and a key's levels are compared where they lie, so the ledgers are neither written nor read again.
    """
    on = ("total_cost_bps", *keys)
    booked = scenario_ledgers(held, **options).where(" AND ".join(f"{k} IS NOT NULL" for k in on))
    deepest = Figures({"_worst": "min(underwater)"}, ("_worst AS max_dd",))
    table = summarise(booked, on, ratio_figures(), total_figures(), deepest, Figures(*trade_measures()))
    levels = f"OVER (PARTITION BY {', '.join(keys)})"
    table = extend(table, {
        "_cheapest": f"min_by(sharpe, total_cost_bps) {levels}",
        "_last": f"max(CASE WHEN sharpe >= 0 THEN struct(total_cost_bps AS c, sharpe AS s) END) {levels}",
        "_first": f"min(CASE WHEN sharpe < 0 THEN struct(total_cost_bps AS c, sharpe AS s) END) {levels}",
    })
    impact = num(impact_bps())
    parts = (
        "round(total_cost_bps / 3, 4) AS commission_bps", "round(total_cost_bps - round(total_cost_bps / 3, 4), 4) AS slippage_bps",
        f"{impact} AS impact_bps", f"total_cost_bps + {impact} AS effective_bps",
    )
    zero = "_last.c + (0 - _last.s) * (_first.c - _last.c) / (_first.s - _last.s)"
    return table.selectExpr(
        *keys, "total_cost_bps", *parts, "sharpe", "ann_ret", "max_dd", "win_rate", "n_trades", "turnover",
        "sharpe - _cheapest AS sharpe_vs_cheapest", f"{zero} AS breakeven_bps",
    )


def diagnostics(metrics: DataFrame, walk: DataFrame, baseline: str, min_auc: float = 0.52) -> DataFrame:
    """(check, value, passed): whether models trade, rank, beat the ``baseline`` model and have an edge over the folds.

    ``metrics`` has ``n_trades``, ``auc`` and ``accuracy`` per model, ``walk`` the fold table with ``vs_baseline``. The last
    row counts the failed checks.
    """
    rival, own = f"model <> '{baseline}'", f"model = '{baseline}'"
    row = metrics.agg(
        F.min("n_trades").alias("t"),
        F.max("auc").alias("a"),
        F.expr(f"max(accuracy) FILTER (WHERE {rival}) - max(accuracy) FILTER (WHERE {own})").alias("c"),
    )
    checks = (
        "'every model trades', double(t), t > 0",
        f"'best auc', a, a >= {min_auc}D",
        "'best accuracy above baseline', c, c > 0",
    )
    found = row.selectExpr(f"stack({len(checks)}, {', '.join(checks)}) AS (check, value, passed)").union(
        walk.agg(F.avg("vs_baseline").alias("e")).selectExpr("'walk-forward edge'", "e", "e >= 0")
    )
    failed = found.agg(F.expr("double(count_if(NOT coalesce(passed, false)))").alias("n"))
    return found.union(failed.selectExpr("'issues'", "n", "n = 0"))


def price_overlay(bars: DataFrame) -> DataFrame:
    return build_features(bars, ("sma_20", "sma_50", "sma_200")).select(
        "ticker", "date", "close", "sma_20", "sma_50", "sma_200", "volume"
    )


def regime_timeline(bars: DataFrame) -> DataFrame:
    timeline = build_features(bars, ("regime_trend",))
    return timeline.selectExpr("ticker", "date", "close", "regime_trend", "int(signum(regime_trend)) AS trend_sign")
