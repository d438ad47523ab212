"""Common calendars across tickers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import extend, in_segments
from barloom.operators.quality import MAX_GAP, MIN_BARS


def align_inner(bars: DataFrame) -> DataFrame:
    """Keep the dates on which every ticker has a bar."""
    tickers = bars.agg(F.countDistinct("ticker")).scalar()
    common = bars.groupBy("date").agg(F.countDistinct("ticker").alias("_n")).where(F.col("_n") == tickers)
    return bars.join(common.select("date"), "date", "left_semi")


def calendar(bars: DataFrame) -> DataFrame:
    """Sorted distinct dates over all tickers with a 0-based ``day`` number. One row per calendar day."""
    days = bars.select("date").distinct()
    return days.withColumn("day", F.row_number().over(Window.orderBy("date")) - 1)


def align_outer(bars: DataFrame, max_fill: int = MAX_GAP) -> DataFrame:
    """Every ticker on the union calendar; a bar fills at most ``max_fill`` following days without a bar.

    Each bar spreads itself over the days up to the next bar of its ticker, so the full ticker x date grid is
    never built. Filled rows carry ``filled = true``.
    """
    days = calendar(bars)
    last_day = days.agg(F.max("day")).scalar()

    def stage(panel: DataFrame, axis) -> DataFrame:
        return extend(panel, {"_next": axis.lead("day")})

    spread = in_segments(bars.join(days, "date"), stage, ahead=1)
    until = F.least(F.col("day") + max_fill, F.coalesce(F.col("_next") - 1, last_day))
    exploded = spread.withColumn("_day", F.explode(F.sequence("day", until)))
    fields = [c for c in bars.columns if c not in ("ticker", "date")]
    return (
        exploded.withColumn("filled", F.col("_day") != F.col("day"))
        .select("ticker", F.col("_day").alias("day"), "filled", *fields)
        .join(days, "day")
        .select("ticker", "date", *fields, "filled")
    )


def align(bars: DataFrame, how: str = "inner", min_common: int = MIN_BARS) -> DataFrame:
    """Inner or outer alignment with the guard on the number of common dates."""
    if how not in ("inner", "outer"):
        raise ValueError(f"align must be 'inner' or 'outer', not {how!r}")
    aligned = align_inner(bars) if how == "inner" else align_outer(bars).drop("filled")
    days = aligned.select("date").distinct().count()
    if days < min_common:
        raise ValueError(f"only {days} aligned dates, {min_common} needed")
    return aligned


def shared_dates(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, [f.select("date") for f in frames])


def any_dates(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [f.select("date") for f in frames]).distinct()


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union by name over the columns all frames share."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*shared) for f in frames])


def common_columns(frames: Sequence[DataFrame], required: Sequence[str] = ()) -> list[str]:
    """Columns present in every frame, in the order of the first; missing required ones are an error."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    lacking = [c for c in required if c not in shared]
    if lacking:
        raise ValueError(f"columns not in all frames: {lacking}")
    return shared
