"""Cross-sectional normalisation per date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import extend, replace

SPREAD_EPS = "1e-8D"


def cs_zscore(panel: DataFrame, columns: Sequence[str], min_tickers: int = 3) -> DataFrame:
    """Z-score of each column within its date; dates with fewer than ``min_tickers`` stay as they are.

    Per-date statistics are aggregated (one row per date) and joined back.
    """
    stats = panel.groupBy("date").agg(
        F.count(F.lit(1)).alias("_tickers"),
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns],
    )
    scaled = {
        c: f"CASE WHEN _tickers < {min_tickers} THEN `{c}`"
        f" ELSE (`{c}` - `_mean_{c}`) / (`_std_{c}` + {SPREAD_EPS}) END"
        for c in columns
    }
    return replace(panel.join(stats, "date"), scaled).select(*panel.columns)


def cs_rank(panel: DataFrame, columns: Sequence[str], min_tickers: int = 3, tasks: int | None = None) -> DataFrame:
    """Average-tie percentile rank within the date; null values and thin dates get 0.5.

    Rows cross one shuffle, by date, and each column is ranked by one window there; a date has one row per ticker. Rows without a
    ticker count in the ranks of others and get 0.5; of rows with the same ticker and date the highest rank counts for all.
    """
    days = panel.where("date IS NOT NULL")
    placed = extend(days.repartition(tasks, "date") if tasks else days, {"_tickers": "count(1) OVER (PARTITION BY date)"})
    for c in columns:
        known = f"`{c}` IS NOT NULL AND NOT isnan(double(`{c}`))"
        ordered = f"PARTITION BY date, {known} ORDER BY `{c}`"
        finite = f"count(1) OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        ties = f"count(1) OVER ({ordered} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
        middle = f"(rank() OVER ({ordered}) - 1 + ({ties} + 1) / 2D) / {finite}"
        placed = extend(placed, {f"_r_{c}": f"CASE WHEN {known} AND {finite} >= 2 THEN {middle} END"})
    ranked = {
        c: f"CASE WHEN _tickers < {min_tickers} THEN `{c}` WHEN ticker IS NULL THEN 0.5D"
        f" ELSE coalesce(max(`_r_{c}`) OVER (PARTITION BY date, ticker), 0.5D) END"
        for c in columns
    }
    return replace(placed, ranked).select(*panel.columns)


def normalise(
    panel: DataFrame, columns: Sequence[str], method: str = "zscore", min_tickers: int = 3, tasks: int | None = None
) -> DataFrame:
    """``zscore`` or ``rank``; any other method leaves the panel unchanged. ``tasks`` as in ``cs_rank``."""
    if method == "zscore":
        return cs_zscore(panel, columns, min_tickers)
    return cs_rank(panel, columns, min_tickers, tasks) if method == "rank" else panel
