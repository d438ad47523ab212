"""Bar panels, dirty bars and rule-based scores derived from the star-schema tables.

A ticker is a supplier (the panel grows with the data) or a region (five long series with full daily ranges).
``damped`` bars use ``100 * (price / 1000) ** 0.05`` so that daily moves are a few per cent, as the ledger and
risk queries need.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.windows import EPS, extend, in_segments, with_position
from barloom.sources.bars import FIELDS

MODELS = ("ma_5_20", "mean_rev_14", "momentum_20", "momentum_null")
WARM_UP = 19
# Trades whose bars one task holds. The number of tasks grows with the trades and is not merged by adaptive execution, which
# sees only compressed bars and not the four score rows that each becomes, or the twenty of five cost levels.
TASK_TRADES = 40_000
# Such tasks whose trades are made into bars together: a trade is one narrow row there, and fewer of them keep the number of
# shuffle blocks between the two dealings down.
TRADE_SHARE = 5
TRADE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(trades: DataFrame) -> int:
    """Tasks for the bars of a table; counting a Parquet table reads its footers only."""
    return max(trades.sparkSession.sparkContext.defaultParallelism, math.ceil(trades.count() / TASK_TRADES))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for rows that come from supplier bars."""
    return _tasks(table(spark, sf_dir, "lineitem"))


def bars(spark: SparkSession, sf_dir: str, ticker: str = "supplier", damped: bool = False) -> DataFrame:
    """Daily bars of line-item unit prices.

    Regions are few: their aggregates combine map-side. Suppliers have about one trade a day, where combining saves nothing and
    would sort whole input files: trades are dealt by (ticker, date) and the bars by ticker, so that no later window deals them again.
    """
    trades = table(spark, sf_dir, "lineitem")
    dealt_to = _tasks(trades) if ticker != "region" else 0
    if ticker == "region":
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        # one table after the other: Spark knows the size of a table, but takes a join of small ones for large
        trades = (
            trades.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        name: Column = F.col("r_name")
    else:
        name = F.col("l_suppkey").cast("string")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    if damped:
        price = 100.0 * F.pow(price / 1000.0, F.lit(0.05))
    first = F.struct(*TRADE_ORDER)
    priced = trades.select(
        name.alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        price.alias("px"),
        "l_quantity",
        first.alias("o"),
    )
    least = spark.sparkContext.defaultParallelism
    dealt = priced.repartition(max(least, math.ceil(dealt_to / TRADE_SHARE)), "ticker", "date") if dealt_to else priced
    daily = (
        dealt.groupBy("ticker", "date")
        .agg(
            F.min_by("px", "o").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    return daily.repartition(dealt_to, "ticker") if dealt_to else daily


def raw_bars(spark: SparkSession, sf_dir: str, ticker: str = "region") -> DataFrame:
    """Bars with one planted defect per cleaning rule, as strings under vendor column names."""
    clean = with_position(bars(spark, sf_dir, ticker)).withColumn("rn", F.col("pos") + 1)
    rn = F.col("rn")
    o, h, l, c, v = (F.col(name) for name in FIELDS)
    lost = rn.between(200, 202) | rn.between(400, 407)
    swap = (rn == 510) & (h > l)
    rows = clean.select(
        "ticker",
        "date",
        "rn",
        F.when(~lost, F.when(rn == 520, h * 1.1).otherwise(o)).alias("o"),
        F.when(~lost, F.when(swap, l).otherwise(h)).alias("h"),
        F.when(~lost, F.when(rn == 500, -1.0).when(swap, h).otherwise(l)).alias("l"),
        F.when(~lost & (rn != 580), F.when(rn == 530, l * 0.9).otherwise(c)).alias("c"),
        F.when(
            ~lost & (rn % 97 != 0), F.when(rn == 540, -1.0).when(rn == 550, 0.0).otherwise(v)
        ).cast("string").alias("vol"),
    )
    rows = rows.withColumn("vol", F.when(rn == 570, "n/a").otherwise(F.col("vol")))
    copies = F.when(rn == 560, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    repeated = rows.withColumn("ingest_seq", F.explode(copies))
    stale = (rn == 560) & (F.col("ingest_seq") == 1)
    return repeated.select(
        "ticker",
        "date",
        F.col("ingest_seq").cast("long").alias("ingest_seq"),
        F.col("o").cast("string").alias("open"),
        F.col("h").cast("string").alias("HIGH"),
        F.col("l").cast("string").alias("low"),
        F.when(stale, F.col("l")).otherwise(F.col("c")).cast("string").alias("Adj Close"),
        "vol",
    )


def scores(
    spark: SparkSession, sf_dir: str, ticker: str = "supplier", damped: bool = True,
    priced: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rule-based probabilities ``(model, ticker, date, p, y)`` plus the bar position ``pos`` and ``n``.

    Rows start once all rules are defined and end with the last bar that has a next one, so ``pos`` and
    ``n`` number the scored bars. ``priced`` adds columns to the bars; these and ``close`` go with every score.
    """

    def stage(panel: DataFrame, axis) -> DataFrame:
        fast, slow = axis.roll("avg", "close", 5), axis.roll("avg", "close", 20)
        low, high = axis.roll("min", "low", 14), axis.roll("max", "high", 14)
        z = f"(close - {slow}) / ({axis.roll('stddev_samp', 'close', 20)} + {EPS})"
        following = axis.lead("close")
        panel = extend(
            panel,
            {
                "y": f"CASE WHEN {following} IS NOT NULL THEN int({following} > close) END",
                "ma_5_20": f"coalesce(double({fast} > {slow}), 0D)",
                "mean_rev_14": f"1 - (close - {low}) / ({high} - {low} + {EPS})",
                "momentum_20": f"1 / (1 + exp(-({z})))",
            },
        )
        return extend(panel, {"momentum_null": "CASE WHEN pos % 10 <> 0 THEN momentum_20 END"})

    source = bars(spark, sf_dir, ticker, damped)
    taken = priced(source) if priced else source
    carried = ["close", *[c for c in taken.columns if c not in (*source.columns, "pos", "n", "seg")]] if priced else []
    scored = in_segments(taken.drop("seg"), stage, back=20, ahead=1, keep=True, blocks=False, by="date")
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in MODELS])
    return (
        scored.where((F.col("pos") >= WARM_UP) & F.col("y").isNotNull())
        .select(
            "ticker", "date", "y", *carried,
            (F.col("pos") - WARM_UP).alias("pos"), (F.col("n") - WARM_UP - 1).alias("n"),
            F.explode(cells).alias("cell"),
        )
        .select("cell.model", "ticker", "date", "cell.p", "y", "pos", "n", *carried)
    )
