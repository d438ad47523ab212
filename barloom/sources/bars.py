"""Reading price bars and checking their contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume")
BARS_SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(name, T.DoubleType()) for name in FIELDS]
)


def read_bars(
    spark: SparkSession,
    path: str,
    source_format: str = "parquet",
    schema: T.StructType = BARS_SCHEMA,
    tickers: Sequence[str] | None = None,
    years: int | None = None,
    **options: str,
) -> DataFrame:
    """Bars from any batch source. The ticker list becomes a pushed-down filter."""
    bars = spark.read.format(source_format).schema(schema).options(**options).load(path)
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(list(tickers)))
    require_columns(bars, ("ticker", "date", *FIELDS))
    return bars if years is None else trailing_years(bars, years)


def read_universe(spark: SparkSession, path: str, tickers: Sequence[str], **options) -> DataFrame:
    """Bars of many tickers in one scan; raises only when none of them has a row."""
    bars = read_bars(spark, path, tickers=tickers, **options)
    if bars.isEmpty():
        raise ValueError(f"no bars for any of {list(tickers)}")
    return bars


def universe_audit(bars: DataFrame, tickers: Sequence[str], min_rows: int = 252) -> DataFrame:
    """One row per requested ticker: bars found and whether it passes the minimum."""
    requested = bars.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    found = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))
    rows = F.coalesce("bars", F.lit(0))
    status = F.when(rows == 0, "missing").when(rows < min_rows, "too_short").otherwise("ok")
    return requested.join(found, "ticker", "left").select("ticker", rows.alias("bars"), status.alias("status"))


def trailing_years(bars: DataFrame, years: int, order: str = "date") -> DataFrame:
    """Keep the last ``years`` years before the newest bar of the whole set."""
    newest = bars.agg(F.max(order).alias("newest")).scalar()
    return bars.where(F.col(order) > F.add_months(newest, -12 * years))


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Drop repeated column names (ignoring case), keeping the first of each."""
    unique, kept = [f"_{i}" for i in range(len(df.columns))], {}
    for short, name in zip(unique, df.columns):
        kept.setdefault(name.lower(), (short, name))
    return df.toDF(*unique).select(*[F.col(short).alias(name) for short, name in kept.values()])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
