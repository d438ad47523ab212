import contextlib
import datetime
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.expanding import expanding_rank
from barloom.functions.ranks import quantiles, with_mid_rank
from barloom.functions.rolling import Roll, rolling
from barloom.functions.windows import ewm_columns, extend, in_segments, running, with_position
from barloom.operators.features import FAMILIES, build_features
from barloom.plans.queries import QUERIES
from tests.compare import DATA
from tests.conftest import ordered


def close_to(ours, theirs, tolerance=1e-9):
    ours, theirs = np.asarray(ours, float), np.asarray(theirs, float)
    assert (np.isnan(ours) == np.isnan(theirs)).all()
    np.testing.assert_allclose(ours, theirs, rtol=tolerance, atol=1e-9)


def test_positions_agree_between_daily_and_timestamp_series(bars):
    daily = ordered(with_position(bars), "ticker", "date")
    timed = ordered(with_position(bars.selectExpr("ticker", "timestamp(date) AS date", "close")), "ticker", "date")
    assert (daily.pos == timed.pos).all() and (daily.n == timed.n).all()
    assert daily.groupby("ticker").pos.apply(lambda s: (s.values == np.arange(len(s))).all()).all()


def test_running_scan_on_buckets_equals_plain_scan(bars, walk):
    timed = bars.selectExpr("ticker", "timestamp(date) AS date", "close / 100 AS x", "month(date) + 12 * year(date) AS bucket")
    specs = {"s": ("sum", "x"), "m": ("max", "x"), "p": ("product", "x"), "l": ("last", "CASE WHEN x > 1 THEN x END")}
    got = ordered(running(timed, specs, bucket="bucket", order=("date",)), "ticker", "date")
    for _, part in got.groupby("ticker"):
        close_to(part.s, part.x.cumsum())
        close_to(part.m, part.x.cummax())
        close_to(part.p, part.x.cumprod())
        close_to(part.l, part.x.where(part.x > 1).ffill())


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 20, 60])
def test_rolling_statistics(bars, walk, rows):
    requests = [Roll("sum", "close", rows), Roll("m2", "close", rows), Roll("max", "high", rows), Roll("min", "low", rows)]
    names = [r.name for r in requests]
    got = ordered(in_segments(bars, lambda p, axis: rolling(p, axis, requests)), "ticker", "date")
    for _, part in got.groupby("ticker"):
        full = part.iloc[rows - 1:]
        close_to(full[names[0]], part.close.rolling(rows).sum().iloc[rows - 1:])
        close_to(full[names[1]], (part.close.rolling(rows).var(ddof=0) * rows).iloc[rows - 1:], 1e-7)
        close_to(full[names[2]], part.high.rolling(rows).max().iloc[rows - 1:])
        close_to(full[names[3]], part.low.rolling(rows).min().iloc[rows - 1:])


def test_full_constant_window_has_zero_deviation(spark):
    flat = spark.range(40).selectExpr("'A' AS ticker", "date_add(date'2020-01-01', int(id)) AS date", "0.1D AS x")
    request = Roll("m2", "x", 20)
    got = ordered(in_segments(flat, lambda p, axis: rolling(p, axis, [request])), "date")
    assert (got[request.name].iloc[19:] == 0).all()


@pytest.mark.parametrize("alpha", [2 / 3, 2 / 27, 1 / 21])
def test_ewm_matches_recursion(spark, alpha):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 3, 2000)
    frame = pd.DataFrame(dict(ticker="A", date=pd.date_range("2000-01-01", periods=2000).date, x=x))
    got = ordered(
        in_segments(spark.createDataFrame(frame), lambda p, a: extend(p, ewm_columns(a, {"y": ("x", alpha, 0)}))), "date"
    )
    close_to(got.y, frame.x.ewm(alpha=alpha, adjust=False).mean(), 1e-12)


def test_segmented_features_equal_whole_series(bars):
    columns = [*FAMILIES["sma"], *FAMILIES["autocorr"], *FAMILIES["rsi"], *FAMILIES["obv"], "macd_signal"]
    whole = ordered(build_features(bars, columns), "ticker", "date")
    cut = ordered(build_features(bars, columns, rows=100), "ticker", "date")
    for column in columns:
        close_to(cut[column], whole[column], 1e-8)


def test_features_are_causal(bars):
    columns = [*FAMILIES["volume"], *FAMILIES["obv"], *FAMILIES["year_range"], *FAMILIES["ema"]]
    whole = ordered(build_features(bars, columns), "ticker", "date")
    early = ordered(build_features(bars.where("date < '2020-12-01'"), columns), "ticker", "date")
    merged = early.merge(whole, on=["ticker", "date"], suffixes=("", "_w"))
    for column in columns:
        close_to(merged[column], merged[f"{column}_w"], 1e-10)


@pytest.mark.parametrize("rows, task_rows", [(64, 1 << 14), (50, 1 << 14), (7, 30), (1, 64), (1, 0), (1000, 1 << 14)])
def test_expanding_rank_against_pandas(bars, walk, rows, task_rows):
    rounded = bars.selectExpr("ticker", "date", "CASE WHEN day(date) <> 13 THEN round(close, 0) END AS v")  # many ties, some nulls
    got = ordered(expanding_rank(with_position(rounded), {"r": "v"}, rows=rows, task_rows=task_rows), "ticker", "date")
    assert len(got) == len(walk)
    for _, part in got.groupby("ticker"):
        close_to(part.r, part.v.expanding().rank(pct=True), 1e-12)


def test_expanding_rank_takes_one_path_for_dates_and_timestamps(bars):
    timed = bars.selectExpr("ticker", "timestamp(date) AS date", "round(close, 1) AS v", "volume AS w")
    daily = timed.selectExpr("ticker", "date(date) AS date", "v", "w")
    frames = [
        ordered(expanding_rank(with_position(df), {"r": "v", "q": "w"}, rows=16), "ticker", "date") for df in (daily, timed)
    ]
    assert (frames[0][["r", "q"]] == frames[1][["r", "q"]]).all().all()


def test_expanding_rank_of_empty_and_single_rows(spark):
    df = spark.createDataFrame([("A", 0, 1, 2.0), ("B", 0, 1, None), (None, 0, 1, 1.0)], "ticker string, pos long, n long, v double")
    got = {r.ticker: r.r for r in expanding_rank(df, {"r": "v"}).collect()}
    assert got == {"A": 1.0, "B": None, None: 1.0}
    assert expanding_rank(df.where("false"), {"r": "v"}).count() == 0


def test_quantiles_and_ranks_are_exact(bars, walk):
    got = quantiles(bars, ["ticker"], "close", {"a": 0.05, "b": 0.5, "c": 0.975}).toPandas().set_index("ticker")
    for ticker, part in walk.groupby("ticker"):
        close_to(got.loc[ticker, ["a", "b", "c"]], np.quantile(part.close, [0.05, 0.5, 0.975]), 1e-12)
    tied = bars.selectExpr("ticker", "date", "round(close - 100, 0) AS v")
    ranked = ordered(with_mid_rank(tied, ["ticker"], "v", "r"), "ticker", "date")
    for _, part in ranked.groupby("ticker"):
        close_to(part.r, part.v.rank(), 1e-12)


def test_ranks_of_daily_series_cross_no_shuffle_of_their_own(spark):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        QUERIES["feat_vol_rank"](spark, str(DATA / "sf0.001")).explain()
    plan = shown.getvalue()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Sort [ticker") <= 3 and "Generate" not in plan


def test_expanding_rank_of_daily_series_with_odd_values_and_any_order(spark):
    rng, nan = np.random.default_rng(5), float("nan")
    odd = [None, nan, float("inf"), float("-inf"), -0.0, 0.0, 1.0, 2.0]
    series = {t: [odd[i] for i in rng.integers(0, len(odd), 400)] for t in ("A", "B", None)}
    day = datetime.date(2020, 1, 1)
    rows = [(t, day + datetime.timedelta(i), v) for t, values in series.items() for i, v in enumerate(values)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    positioned = with_position(spark.createDataFrame(rows, "ticker string, date date, v double"))
    found = {(r.ticker, r.date): r.v_rank for r in expanding_rank(positioned.repartition(7, "date"), {"v_rank": "v"}).collect()}
    assert len(found) == 1200
    late = expanding_rank(positioned, {"v_rank": "v"}).where(F.col("date") >= day + datetime.timedelta(390)).collect()
    assert {(r.ticker, r.date): r.v_rank for r in late} == {k: v for k, v in found.items() if k[1] >= day + datetime.timedelta(390)}
    place = {v: (2.0 if v != v else 1.0 if v == float("inf") else -1.0 if v == float("-inf") else v / 4) for v in odd if v is not None}
    for t, values in series.items():
        past = []
        for i, v in enumerate(values):
            if v is None:
                assert found[t, day + datetime.timedelta(i)] is None
                continue
            past.append(2.0 if v != v else place[v])
            below, same = sum(x < past[-1] for x in past), sum(x == past[-1] for x in past)
            assert found[t, day + datetime.timedelta(i)] == (below + (same + 1) / 2) / len(past)


def test_expanding_rank_refuses_series_out_of_order(spark):
    rows = [("A", datetime.date(2020, 1, 1) + datetime.timedelta(i), i, 10, float(i)) for i in reversed(range(10))]
    frame = spark.createDataFrame(rows, "ticker string, date date, pos long, n long, v double").coalesce(1)
    assert [r.r for r in expanding_rank(frame, {"r": "v"}).collect()] == [1.0] * 10
    with pytest.raises(Exception, match="order of its positions"):
        expanding_rank(frame, {"r": "v"}, in_order=True).collect()
