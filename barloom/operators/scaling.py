"""Robust scaling with exact quartiles, and model input sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranks import quantiles
from barloom.functions.windows import Axis, extend, in_segments, replace, with_position


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (kept columns, feature, value)."""
    cells = ", ".join(f"'{c}', double(`{c}`)" for c in columns)
    return df.selectExpr(*keep, f"stack({len(columns)}, {cells}) AS (feature, value)")


def robust_fit(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median, iqr) from interpolated quartiles."""
    table = quantiles(melt(train, columns), ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return table.selectExpr("feature", "median", "q3 - q1 AS iqr")


def robust_apply(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / iqr as float; a zero range divides by 1. The scaler is read as one small map."""
    entry = F.struct("feature", F.struct("median", "iqr"))
    lookup = scaler.agg(F.map_from_entries(F.collect_list(entry)).alias("scaler")).scalar()
    scaled = {
        c: f"float((`{c}` - _scaler['{c}'].median) / CASE WHEN _scaler['{c}'].iqr = 0 THEN 1D"
        f" ELSE _scaler['{c}'].iqr END)"
        for c in columns
    }
    return replace(df.withColumn("_scaler", lookup), scaled).select(*df.columns)


def make_sequences(df: DataFrame, columns: Sequence[str], label: str, length: int = 50, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """For each row the ``length`` rows before it in its series, oldest first, paired with its own label.

    With ``keys`` of ticker and split no sequence crosses the border of a split.
    """
    values = ", ".join(f"double(`{c}`)" for c in columns)

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        frame = axis.over(f"ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING")
        return extend(panel, {"sequence": f"collect_list(array({values})) {frame}"})

    built = in_segments(df, stage, back=length, keys=keys)
    return built.where(F.size("sequence") == length).select("ticker", "date", F.col(label).alias("label"), "sequence")


def last_sequence(df: DataFrame, columns: Sequence[str], length: int = 50) -> DataFrame:
    """Per ticker the newest ``length`` rows, oldest first. Shorter tickers are left out."""
    values = ", ".join(f"double(`{c}`)" for c in columns)
    newest = with_position(df).where(f"pos >= n - {length} AND n >= {length}")
    ordered = F.expr(f"transform(array_sort(collect_list(struct(pos, array({values}) AS v))), x -> x.v)")
    return newest.groupBy("ticker").agg(F.max("date").alias("date"), ordered.alias("sequence"))


def short_tickers(df: DataFrame, length: int = 50) -> DataFrame:
    """Tickers without enough rows for one sequence."""
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") < length)
