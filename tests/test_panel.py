"""Panel build, fold models, grouped logistic fits."""

import math

import numpy as np
import pandas as pd
import pytest

from barloom.operators import boosting, classification, logistic, panel, quality, splits
from tests.conftest import ordered

FEATURES = ["ret_5d", "zscore_20", "vol_ratio_10"]


def test_isolated_windows_never_cross_a_border(bars, walk):
    built = ordered(panel.build_panel(bars, ["ret_5d", "zscore_20"], ["target_1d"], isolate_splits=True, normalisation="none"), "ticker", "date")
    for ticker, own in walk.groupby("ticker"):
        days = own["date"].tolist()
        for split, lo, hi in (("train", 0, 294), ("val", 294, 357), ("test", 357, 420)):
            part = own.iloc[lo:hi]
            close = part["close"]
            mean, std = close.rolling(20).mean(), close.rolling(20).std()
            want = pd.DataFrame({"ret_5d": close / close.shift(5) - 1, "zscore_20": (close - mean) / (std + 1e-9)})
            want["target_1d"] = (close.shift(-1) > close).where(close.shift(-1).notna()).astype(float)
            want = want.dropna()
            got = built[(built["ticker"] == ticker) & (built["split"] == split)]
            assert got["date"].tolist() == [days[i] for i in want.index - own.index[0]] and len(got) == hi - lo - 20
            np.testing.assert_allclose(got[["ret_5d", "zscore_20", "target_1d"]], want, rtol=1e-9)


def test_shared_windows_and_split_of_complete_rows(bars):
    built = panel.build_panel(bars, FEATURES, ["target_1d", "target_5d"], normalisation="none")
    alone = splits.calendar_split(built.drop("split"))
    assert ordered(built, "ticker", "date").equals(ordered(alone.select(built.columns), "ticker", "date"))
    assert built.where("target_1d IS NULL OR target_5d IS NULL OR zscore_20 IS NULL").count() == 0
    assert {r["n"] for r in built.groupBy("ticker").count().withColumnRenamed("count", "n").collect()} == {420 - 19 - 5}


def test_pandas_hooks_see_one_series_each(bars):
    def range_of(series):
        assert series["ticker"].nunique() == 1 and series["split"].nunique() == 1 and series["date"].is_monotonic_increasing
        return series.assign(spread=series["high"] / series["low"], place=np.arange(len(series), dtype=float))

    hook = panel.by_series(range_of, {"spread": "double", "place": "double"})
    built = panel.build_panel(bars, ["spread", "place"], ["target_1d"], feature_fn=hook, isolate_splits=True, normalisation="none")
    assert built.where("place = 0").count() == 6 and built.where("spread < 1").count() == 0

    def picky(series):
        if series["ticker"].iloc[0] == "A":
            raise ValueError("no data")
        return series.assign(one=1.0)

    kept = panel.build_panel(bars, ["one"], ["target_1d"], feature_fn=panel.by_series(picky, {"one": "double"}, skip_failed=True), normalisation="none")
    assert [r["ticker"] for r in panel.missing_series(bars, kept).collect()] == ["A"]
    with pytest.raises(Exception, match="no data"):
        panel.build_panel(bars, ["one"], ["target_1d"], feature_fn=panel.by_series(picky, {"one": "double"}), normalisation="none")
    with pytest.raises(ValueError, match="absent"):
        panel.build_panel(bars, ["absent"], ["target_1d"], feature_fn=hook)


def test_drop_non_finite_takes_each_kind_of_missing_value(spark):
    rows = [(1, 1.0, 1), (2, None, 1), (3, float("nan"), 1), (4, float("inf"), 1), (5, -float("inf"), 1), (6, 0.0, None)]
    df = spark.createDataFrame(rows, "i int, x double, k int")
    assert [r["i"] for r in quality.drop_non_finite(df, ["x", "k"]).collect()] == [1]
    wide = spark.range(5).selectExpr("id", *[f"double(id) / {i + 1} AS c{i}" for i in range(120)])
    renamed = quality.drop_non_finite(wide, wide.columns).selectExpr(*[f"{c} * 2 AS {c}" for c in wide.columns])
    assert renamed.where("c3 > 1").count() == 2  # planning stays short however many columns


def series(n=700, seed=1, tickers=("A", "B")):
    rng = np.random.default_rng(seed)
    frames = []
    for t in tickers:
        x = rng.normal(size=(n, 4))
        y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
        frames.append(pd.DataFrame(x, columns=list("abcd")).assign(ticker=t, date=pd.date_range("2020-01-01", periods=n).date, y=y))
    return pd.concat(frames, ignore_index=True)


def test_fold_models_learn_a_rule_and_never_look_ahead(spark):
    rows = series()
    small = boosting.Boosting(trees=200, rate=0.1)
    out = boosting.fold_predictions(spark.createDataFrame(rows), list("abcd"), "y", small).toPandas()
    full = out.merge(rows, on=["ticker", "date"])
    assert len(full) == len(out) == out[["ticker", "date"]].drop_duplicates().shape[0]
    late = full[full["fold"] >= 5]
    assert ((late["p"] >= 0.5) == (late["y"] == 1)).mean() > 0.9
    bounds = {(r["ticker"], r["fold"]): r["train_end"] for r in splits.expanding_folds(spark.createDataFrame(rows)).collect()}
    assert {(t, f): n for t, f, n in zip(out["ticker"], out["fold"], out["tr_rows"])} == bounds
    changed = rows.copy()
    day = out[out["fold"] == 3]["date"].min()
    changed.loc[changed["date"] >= day, ["y"]] = 1 - changed.loc[changed["date"] >= day, ["y"]]
    again = boosting.fold_predictions(spark.createDataFrame(changed), list("abcd"), "y", small).toPandas()
    both = out.merge(again, on=["ticker", "fold", "date"])
    assert (both[both["fold"] <= 3]["p_x"] == both[both["fold"] <= 3]["p_y"]).all() and (both[both["fold"] > 4]["p_x"] != both[both["fold"] > 4]["p_y"]).any()


def test_first_tree_matches_all_thresholds_tried_out(spark):
    rows = series(420, 2, ("A",))
    one = boosting.Boosting(trees=1, depth=1, subsample=1.0, column_share=1.0, holdout=0.0, bins=1 << 20)
    out = boosting.fold_predictions(spark.createDataFrame(rows), list("abcd"), "y", one).toPandas()
    for _, own in out.groupby("fold"):
        train = rows.iloc[: own["tr_rows"].iloc[0]]
        w = np.where(train["y"] == 1, own["pos_weight"].iloc[0], 1.0)
        g, h = w * (0.5 - train["y"]), w * 0.25
        soft = lambda v: math.copysign(max(abs(v) - 0.15, 0), v)
        value = lambda a, b: soft(a) ** 2 / (b + 1.5)
        best = max(
            (value(g[m].sum(), h[m].sum()) + value(g[~m].sum(), h[~m].sum()) - value(g.sum(), h.sum()), -k, -x)
            for k, c in enumerate("abcd") for x in train[c] for m in [train[c] <= x] if min(h[m].sum(), h[~m].sum()) >= 5
        )
        column, x = "abcd"[-best[1]], -best[2]
        m = train[column] <= x
        leaf = [-0.02 * soft(g[s].sum()) / (h[s].sum() + 1.5) for s in (m, ~m)]
        test = rows.set_index("date").loc[own["date"], column]
        np.testing.assert_allclose(own["p"], [1 / (1 + math.exp(-(leaf[0] if v <= x else leaf[1]))) for v in test])


def test_grouped_newton_finds_each_group_s_least_loss(spark):
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"k": k, "a": rng.normal(size=300), "b": rng.normal(size=300) * s}) for k, s in (("x", 1.0), ("y", 5.0))]
    rows = pd.concat(frames, ignore_index=True)
    rows["y"] = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + rows["a"] - 0.2 * rows["b"])))).astype(float)
    rows.loc[5, "a"] = None
    got = {r["k"]: np.array([r["intercept"], *r["weights"]]) for r in logistic.newton_logistic(spark.createDataFrame(rows), ["a", "b"], "y", ["k"], 0.5).collect()}
    for k, own in rows.dropna().groupby("k"):
        x, y, b = np.column_stack([np.ones(len(own)), own[["a", "b"]]]), own["y"].to_numpy(), got[k]
        slope = x.T @ (1 / (1 + np.exp(-x @ b)) - y) + np.array([0, *(b[1:] / 0.5)])
        assert np.abs(slope).max() < 1e-6


def test_missing_scores_count_as_one_half_in_the_area(spark):
    rows = [("m", 0.9, 1), ("m", 0.4, 0), ("m", None, 1), ("m", float("nan"), 0), ("m", float("inf"), 0)]
    scores = spark.createDataFrame(rows, "model string, p double, y int")
    # pairs: 0.9 beats 0.4, 0.5, 0.5; the missing positive (0.5) beats 0.4 and ties with both missing negatives
    assert classification.auc(scores).first()["auc"] == pytest.approx((3 + 1 + 0.5 + 0.5) / 6)
