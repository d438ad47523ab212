"""What keeps queries on long tables bounded: shuffles in their plans, and the short paths against the general ones."""

import contextlib
import datetime
import io
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.ranks import rank_table, with_mid_rank
from barloom.operators import classification, cross_section, ensemble, histogram_trees, ledger, models, selection, splits
from barloom.plans.queries import QUERIES
from barloom.session import cut_lineage
from tests.compare import DATA, differences


def plan_of(df) -> str:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return shown.getvalue()


@pytest.mark.parametrize("name, most", [
    ("ledger", 2), ("ledger_parity", 2), ("ledger_long_only", 2), ("trade_stats", 2), ("rolling_sharpe", 2), ("benchmark", 2),
    ("var_cvar", 2), ("risk_metrics", 2), ("cost_stress", 2), ("auc", 2), ("feat_vol_rank", 4),
])
def test_rows_are_dealt_by_ticker_and_date_and_by_ticker_only(spark, name, most):
    plan = plan_of(QUERIES[name](spark, str(DATA / "sf0.001")))
    assert plan.count("Exchange hashpartitioning") <= most and "Join" not in plan and "Scan ExistingRDD" not in plan


def test_tasks_grow_with_the_trades(spark, monkeypatch):
    from barloom.plans import fixtures

    monkeypatch.setattr(fixtures, "TASK_TRADES", 100)
    trades = spark.read.parquet(str(DATA / "sf0.001" / "lineitem.parquet")).count()
    held = fixtures.bars(spark, str(DATA / "sf0.001"))
    assert held.rdd.getNumPartitions() == math.ceil(trades / 100)


@pytest.mark.parametrize("name", ["linear_attribution", "ens_auc_weighted", "ens_calibrated"])
def test_no_row_is_dealt_by_model_or_feature_alone(spark, name):
    lines = plan_of(QUERIES[name](spark, str(DATA / "sf0.001"))).split("\n")
    dealt = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\((model|feature)#\d+, \d+\)", line)]
    assert not [lines[i] for i in dealt if "Aggregate" not in lines[i + 1] and any("Generate" in line for line in lines[i + 1 : i + 5])]


def test_ranks_of_a_date_cross_one_shuffle(spark):
    plan = plan_of(QUERIES["cs_rank"](spark, str(DATA / "sf0.001")))
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan


def test_regions_join_without_dealing_trades(spark):
    plan = plan_of(QUERIES["bars_daily"](spark, str(DATA / "sf0.001")))
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def odd_scores(spark):
    day, nan = datetime.date(2020, 1, 1), float("nan")
    rows = []
    for m, model in enumerate(("a", "b", "c")):
        for t, ticker in enumerate(("A", "B", None)):
            for i in range(30):
                p = ((i * 7 + m * 5 + t) % 11) / 11 if m < 2 else float(i % 2)
                p = None if i % 9 == 8 else nan if i % 13 == 12 else p
                rows.append((model, ticker, day + datetime.timedelta(i), p, None if i == 3 else (i * 5 + t) % 2, nan if i == 4 else ((i * 3 + m) % 7) / 7))
    return spark.createDataFrame(rows, "model string, ticker string, date date, p double, y int, realised double")


def test_areas_by_buckets_equal_those_of_pairs(spark):
    scores = odd_scores(spark)
    frame = scores.toPandas()
    prob = frame.p.fillna(0.5)
    for tasks in (None, 3):
        found = {r.model: r.auc for r in classification.auc(scores, tasks=tasks).collect()}
        for model, own in frame.assign(prob=prob).groupby("model"):
            ups, downs = own.prob[own.y == 1], own.prob[own.y == 0]
            pairs = [(u > d) + (u == d) / 2 for u in ups for d in downs]
            assert found[model] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)


def test_rank_correlation_makes_one_shuffle_of_the_rows_by_return(spark):
    scores = odd_scores(spark)
    frame = scores.toPandas()
    for tasks in (None, 3):
        found = {r.model: r.ic for r in classification.rank_ic(scores, tasks=tasks).collect()}
        for model, own in frame[frame.p.notna() & frame.realised.notna()].groupby("model"):
            assert found[model] == pytest.approx(own.p.rank().corr(own.realised.rank()), abs=0.2)
    counted = classification._bucket_mid_ranks(scores.where("p IS NOT NULL AND realised IS NOT NULL").select("model", "p", "realised"), ["model"], "realised", 3)
    counted.collect()
    assert "ReusedExchange" in plan_of(counted)


def test_ranks_of_dates_with_nulls_thin_days_and_repeats(spark):
    day, nan = datetime.date(2020, 1, 1), float("nan")
    late = datetime.date(2020, 1, 2)
    rows = [("A", day, 1.0), ("B", day, 3.0), ("C", day, 3.0), ("D", day, None), ("E", day, nan), (None, day, 0.0), ("A", day, 9.0), ("A", late, 5.0), ("B", late, 6.0), ("Z", None, 1.0)]
    panel = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ticker string, date date, x double, i int")
    found = {r.i: r.x for r in cross_section.cs_rank(panel, ["x"], tasks=3).collect()}
    assert found == pytest.approx({0: 1.0, 1: 0.7, 2: 0.7, 3: 0.5, 4: 0.5, 5: 0.5, 6: 1.0, 7: 5.0, 8: 6.0})


def test_weights_and_calibration_leave_rows_where_they_lie(spark):
    scores = odd_scores(spark)
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "model string, weight double")
    calibration = spark.createDataFrame([("a", -1.0, 2.0)], "model string, intercept double, slope double")
    combined = ensemble.calibrated_mean(scores, calibration, weights)
    assert "Join" not in plan_of(combined)
    frame = scores.toPandas().query("model != 'c' and ticker == 'A'")
    frame["q"] = [1 / (1 + math.exp(1 - 2 * p)) if m == "a" else p for m, p in zip(frame.model, frame.p)]
    frame = frame[frame.q.notna()]
    frame["w"] = frame.model.map({"a": 0.75, "b": 0.25})
    frame["wq"] = frame.w * frame.q
    summed = frame.groupby("date")[["wq", "w"]].sum()
    found = {r.date: r.p for r in combined.where("ticker = 'A' AND NOT isnan(p)").collect() if r.p is not None}
    assert found == pytest.approx((summed.wq / summed.w).to_dict())
    attributed = models.linear_contributions(scores.dropna(), ["p", "realised"], spark.createDataFrame([("p", 2.0)], "feature string, coefficient double"))
    assert {r.feature for r in attributed.select("feature").distinct().collect()} == {"p"}


def valued(spark):
    day = datetime.date(2020, 1, 1)
    values = [1.0, 1.0, 2.0, None, float("nan"), -3.0, 0.0, -0.0, 2.0, 7.5]
    rows = [(k, day + datetime.timedelta(i), v) for k in ("A", "B", None) for i, v in enumerate(values[: 10 if k else 6])]
    return spark.createDataFrame(rows, "ticker string, date date, x double")


def test_bounded_ranks_equal_bucketed_ranks(spark):
    df = valued(spark)
    sums = {"early": F.expr("int(date < '2020-01-04')")}
    bounded, general = (rank_table(df, ["ticker"], "x", sums, bounded=b).toPandas() for b in (True, False))
    assert differences(bounded, general) is None
    df = df.where("ticker IS NOT NULL")
    for centred in (False, True):
        bounded, general = (with_mid_rank(df, ["ticker"], "x", "r", b, centred).toPandas() for b in (True, False))
        assert differences(bounded, general) is None


def test_rank_correlation_from_sums_equals_that_of_rows(spark):
    day = datetime.date(2020, 1, 1)
    odd = float("nan")
    rows = [("m", "A", day + datetime.timedelta(i), (i * 7) % 11 / 11, float((i * 5) % 13)) for i in range(40)]
    rows += [("m", "A", day + datetime.timedelta(50), odd, 1.0), ("m", "A", day + datetime.timedelta(51), 0.5, odd)]
    rows += [("flat", "A", day + datetime.timedelta(i), 0.3, float(i)) for i in range(40)]
    rows += [("same", "A", day + datetime.timedelta(i), float(i), 0.1) for i in range(40)]
    rows += [("few", "A", day + datetime.timedelta(i), float(i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "model string, ticker string, date date, p double, realised double")
    by_model = {r.model: r.ic for r in classification.rank_ic(df).collect()}
    by_ticker = {r.model: r.ic for r in classification.rank_ic(df, ("model", "ticker")).collect()}
    assert by_model["flat"] == by_model["same"] == by_model["few"] == 0
    frame = pd.DataFrame(rows, columns=["model", "t", "d", "p", "r"]).query("model == 'm'")
    ranks = frame.assign(p=frame.p.rank(), r=frame.r.rank()).dropna()
    assert by_model["m"] == pytest.approx(ranks.p.corr(ranks.r), abs=1e-12)
    assert by_ticker == pytest.approx(by_model, abs=1e-12)


def test_folds_share_one_rank_table(spark):
    rows = [(f, float((i * 7) % 5), (i * 3) % 2) for i in range(60) for f in range(3) if i < 20 * (f + 1)]
    folded = spark.createDataFrame(rows, "fold int, x double, y int")
    apart = selection.mutual_information(folded, ["x"], "y").toPandas().round(12)
    together = selection.mutual_information(folded, ["x"], "y", folds=range(5))
    assert "fold" not in [line for line in plan_of(together).split("\n") if "Exchange hashpartitioning(feature" in line][-1].split("]")[0]
    assert differences(together.toPandas().round(12), apart) is None


def test_scores_that_carry_prices_give_the_same_ledger(spark):
    day = datetime.date(2020, 1, 1)
    bars = spark.createDataFrame(
        [("A", day + datetime.timedelta(i), 100.0 + i % 7, 101.0 + i % 5) for i in range(40)], "ticker string, date date, open double, close double"
    )
    scores = bars.selectExpr("'m' AS model", "ticker", "date", "day(date) % 10 / 10D AS p", "1 AS y").where("day(date) > 3")
    for parity in (False, True):
        carried = scores.join(ledger.with_execution(bars, parity).drop("pos", "n", "open"), ["ticker", "date"])
        assert differences(ledger.ledger(carried, parity=parity).toPandas(), ledger.ledger(scores, bars, parity=parity).toPandas()) is None


def test_cost_levels_are_not_sorted_apart(spark):
    plan = plan_of(QUERIES["cost_stress"](spark, str(DATA / "sf0.001")))
    assert not [line for line in plan.split("\n") if "Sort [" in line and "total_cost_bps" in line]


def test_cost_levels_side_by_side_equal_ledgers_of_each_level(spark):
    day = datetime.date(2020, 1, 1)
    bars = spark.createDataFrame(
        [(t, day + datetime.timedelta(i), 100.0 + (i * 7) % 13, 101.0 + i % 5) for t in "AB" for i in range(40)],
        "ticker string, date date, open double, close double",
    )
    scores = bars.selectExpr("'m' AS model", "ticker", "date", "CASE WHEN day(date) % 9 > 0 THEN day(date) % 10 / 10D END AS p")
    held = ledger.positions(scores, bars).cache()
    for extra in (0.0, 1.0):
        together = ledger.scenario_ledgers(held, extra_leg=extra)
        for level in ledger.COST_SCENARIOS:
            rate = (level + ledger.impact_bps()) / 10000
            found = together.where(f"total_cost_bps = {level}").drop("total_cost_bps", "_rate")
            assert differences(found.toPandas(), ledger.equity(held, rate, extra_leg=extra).toPandas()) is None


def test_windows_of_a_daily_series_share_the_sort_of_its_ranking(spark):
    lines = plan_of(QUERIES["rolling_sharpe"](spark, str(DATA / "sf0.001"))).split("\n")
    assert len([line for line in lines if "Sort [" in line]) <= 4 and not [line for line in lines if "Sort [" in line and "blk" in line]


def test_trades_are_dealt_to_fewer_tasks_than_their_bars(spark, monkeypatch):
    from barloom.plans import fixtures

    monkeypatch.setattr(fixtures, "TASK_TRADES", 100)
    trades = spark.read.parquet(str(DATA / "sf0.001" / "lineitem.parquet")).count()
    plan = plan_of(fixtures.bars(spark, str(DATA / "sf0.001")))
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(ticker#\d+, date#\d+, (\d+)\)", plan)]
    assert dealt == [max(spark.sparkContext.defaultParallelism, math.ceil(math.ceil(trades / 100) / fixtures.TRADE_SHARE))]


def labelled_rows(spark, seed=5, tickers=6, days=200):
    """Three features of few values, a label that depends on two of them."""
    rng = np.random.default_rng(seed)
    n = tickers * days
    a, b, c = rng.integers(0, 12, n) / 4, rng.integers(0, 9, n) - 4.0, rng.integers(0, 20, n) * 1.5
    up = (rng.random(n) < 1 / (1 + np.exp(1 - a + 0.6 * b * (c > 12)))).astype(int)
    day = np.tile(pd.date_range("2020-01-01", periods=days).date, tickers)
    return spark.createDataFrame(pd.DataFrame(dict(ticker=np.repeat([f"T{k}" for k in range(tickers)], days), date=day, a=a, b=b, c=c, up=up)))


@pytest.mark.parametrize("columns, depth", [(["a", "b", "c"], 3), (["a", "b"], 4), (["b"], 2), (["a", "b", "c"], 1)])
@pytest.mark.parametrize("holdout", [0.0, 0.2])
def test_boosted_trees_equal_those_of_the_library(spark, columns, depth, holdout):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled_rows(spark).cache()
    ours = models.gbt_fit(rows, columns, "up", trees=5, depth=depth, rate=0.3, subsample=1.0, column_share=1.0, holdout=holdout)
    marked = splits.early_stop_rows(rows, holdout)
    weight = splits.positive_weight(rows, "up").first()["pos_weight"]
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(marked.withColumn("_w", F.when(F.col("up") == 1, weight).otherwise(1.0)))
    held = {"validationIndicatorCol": "is_validation"} if holdout else {}
    theirs = GBTClassifier(labelCol="up", weightCol="_w", maxIter=5, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, validationTol=0.0, **held).fit(assembled)
    assert len(ours.trees) == theirs.getNumTrees
    seen = [models.score(m, rows, columns, "m", "up").toPandas().sort_values(["ticker", "date"]) for m in (ours, theirs)]
    np.testing.assert_allclose(seen[0]["p"], seen[1]["p"], atol=1e-9)


def test_boosted_trees_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(histogram_trees, "LEAST_ROWS", 300)
    rows, columns = labelled_rows(spark), ["a", "b", "c"]
    found = [models.gbt_fit(rows.repartition(n), columns, "up", trees=6, rate=0.3).trees for n in (1, 5)]
    assert len(found[0]) == len(found[1])
    for one, other in zip(*found):
        for x, y in zip(one, other):
            np.testing.assert_allclose(x, y)


def test_pairs_of_columns_give_the_trees_of_single_levels(spark, monkeypatch):
    rows, columns = labelled_rows(spark), ["a", "b", "c"]
    found = []
    for most in (5, 0):
        monkeypatch.setattr(histogram_trees, "PAIRED_COLUMNS", most)
        found.append(models.gbt_fit(rows, columns, "up", trees=23, rate=0.1, holdout=0.0).trees)
    for one, other in zip(*found):
        for x, y in zip(one, other):
            np.testing.assert_allclose(x, y)


def test_boosted_trees_take_two_jobs_a_tree(spark):
    """Two sums a tree, a checkpoint every twenty trees; the library took five jobs and more."""
    context, rows = spark.sparkContext, cut_lineage(labelled_rows(spark))
    taken = []
    for trees in (2, 12):
        context.setJobGroup(f"trees-{trees}", "count of jobs")
        models.gbt_fit(rows, ["a", "b", "c"], "up", trees=trees, holdout=0.0)
        taken.append(len(context.statusTracker().getJobIdsForGroup(f"trees-{trees}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert taken[1] - taken[0] <= 2 * 10


def test_trees_read_cells_of_equal_rows_and_not_the_rows(spark, monkeypatch):
    monkeypatch.setattr(histogram_trees, "BLOCK_ROWS", 100)
    rows = labelled_rows(spark).withColumn("_key", F.xxhash64("ticker", "date")).withColumn("is_validation", F.expr("day(date) > 25"))
    n, edges = histogram_trees.thresholds(rows, ["a", "b"], 32)
    blocks = histogram_trees._blocks(rows, ["a", "b"], "up", edges, n).collect()
    frame = rows.toPandas()
    kinds = frame.groupby(["a", "b", "up", "is_validation"]).size()
    assert sum(len(b[3]) for b in blocks) <= len(kinds) < n / 2 and sum(int(b[3].sum()) for b in blocks) == n == len(frame)
    assert sorted(k for b in blocks for k in b[4].view(np.int64)) == sorted(frame._key[~frame.is_validation])
    for codes, up, held, of, key, z in blocks:
        assert codes.shape == (2, len(of)) and len(up) == len(held) == len(z) == len(of) and of[~held].sum() == len(key)


def test_trees_do_not_depend_on_how_many_are_counted_at_once_or_on_the_size_of_blocks(spark, monkeypatch):
    rows, columns = labelled_rows(spark), ["a", "b", "c"]
    found = []
    for counted, block in ((20, 1_000_000), (1, 1_000_000), (4, 150)):
        monkeypatch.setattr(histogram_trees, "COUNTED_TREES", counted)
        monkeypatch.setattr(histogram_trees, "BLOCK_ROWS", block)
        found.append(models.gbt_fit(rows, columns, "up", trees=8, rate=0.1, holdout=0.1).trees)
    assert len(found[0]) == len(found[1]) == len(found[2])
    for other in found[1:]:
        for one, two in zip(found[0], other):
            for x, y in zip(one, two):
                np.testing.assert_allclose(x, y)


def test_trees_of_columns_without_a_threshold(spark):
    rows = labelled_rows(spark).withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2.0))
    model = models.gbt_fit(rows, ["a", "b"], "up", trees=3, holdout=0.0)
    assert all((feature < 0).all() for feature, _, _ in model.trees)
    assert models.score(model, rows, ["a", "b"], "m").select("p").distinct().count() == 1
