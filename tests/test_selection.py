"""Feature scores within inner folds, their fallbacks, and sequences within splits."""

import numpy as np
import pandas as pd

from barloom.operators import features, scaling, selection, splits
from barloom.plans.oracle import ORACLES
from barloom.plans.queries import QUERIES
from tests.compare import DATA


def panel(spark, sizes, seed=3):
    """Complete rows of several tickers: ``signal`` decides most labels, ``noise`` none."""
    rng = np.random.default_rng(seed)
    parts = []
    for ticker, n in sizes.items():
        label = rng.integers(0, 2, n).astype(float)
        parts.append(pd.DataFrame({
            "ticker": ticker, "date": pd.date_range("2020-01-01", periods=n).date, "noise": rng.normal(size=n),
            "signal": label + rng.normal(size=n), "weak": label * 0.2 + rng.normal(size=n), "target_1d": label,
        }))
    return spark.createDataFrame(pd.concat(parts))


COLUMNS = ["noise", "signal", "weak"]


def test_short_series_are_scored_once_and_whole(spark):
    folded = splits.inner_folds(panel(spark, {"long": 660, "edge": 200, "short": 199})).groupBy("ticker", "fold").count().collect()
    found = {(r["ticker"], r["fold"]): r["count"] for r in folded}
    want = {("long", k): min(110 + 110 * (k + 1), 660) for k in range(5)} | {("short", 0): 199}
    want |= {("edge", k): min(100 + 33 * (k + 1), 200) for k in range(5)}
    assert found == want
    one = splits.inner_folds(panel(spark, {"long": 660}), folds=1)
    assert one.count() == 660 and one.where("fold <> 0").count() == 0


def test_planted_features_win_by_fitted_trees(spark):
    folded = splits.inner_folds(panel(spark, {"A": 500, "B": 150}))
    scored = selection.score_features(folded, COLUMNS, "target_1d", trees=5)
    found = {r["feature"]: (r["mi"], r["tree"]) for r in scored.collect()}
    assert found["signal"][0] > 2 * max(found["noise"][0], found["weak"][0])
    assert found["signal"][1] > max(found["noise"][1], found["weak"][1])
    assert abs(sum(tree for _, tree in found.values()) - 1) < 1e-6
    best = selection.select_top(scored, COLUMNS, k=1).collect()
    assert [(r["ordinal"], r["feature"], r["combined"]) for r in best] == [(1, "signal", 1.0)]


def test_folds_that_cannot_be_fitted_count_all_features_alike(spark):
    rows = panel(spark, {"A": 240})
    one_label = rows.selectExpr("noise", "signal", "weak", "1D AS target_1d", "1 AS fold")
    both = rows.selectExpr("noise", "signal", "weak", "target_1d", "0 AS fold")
    alone = {r["feature"]: r["tree"] for r in selection.tree_importance(both, COLUMNS, "target_1d", [0], trees=3).collect()}
    scored = selection.score_features(both.union(one_label), COLUMNS, "target_1d", trees=3).collect()
    assert {r["feature"]: round(r["tree"], 9) for r in scored} == {c: round((alone[c] + 1) / 2, 9) for c in COLUMNS}
    none = selection.score_features(both.limit(0), COLUMNS, "target_1d").collect()
    assert {(r["feature"], r["mi"], r["tree"]) for r in none} == {(c, 1.0, 1.0) for c in COLUMNS}


def test_a_feature_without_values_scores_zero_in_a_scored_fold(spark):
    scores = spark.createDataFrame([(0, "noise", 0.5), (0, "signal", 0.25)], "fold int, feature string, mi double")
    found = selection.filled_scores(scores, [0, 1], COLUMNS, "mi").collect()
    assert {(r["fold"], r["feature"]): r["mi"] for r in found} == {
        (0, "noise"): 0.5, (0, "signal"): 0.25, (0, "weak"): 0.0, (1, "noise"): 1.0, (1, "signal"): 1.0, (1, "weak"): 1.0,
    }


def test_sequences_stay_within_their_split(spark):
    rows = panel(spark, {"A": 130}).selectExpr("*", "CASE WHEN date < '2020-03-11' THEN 'train' ELSE 'test' END AS split")
    own = rows.toPandas().sort_values("date")
    found = {r["date"]: r for r in scaling.make_sequences(rows, ["signal", "noise"], "target_1d", 50, ("ticker", "split")).collect()}
    parts = [part for _, part in own.groupby("split")]
    assert sorted(map(len, parts)) == [60, 70] and len(found) == 30
    for part in parts:
        for at in range(50, len(part)):
            row = found[part["date"].iloc[at]]
            np.testing.assert_array_equal(np.array(row["sequence"]), part[["signal", "noise"]].iloc[at - 50 : at].to_numpy())
            assert row["label"] == part["target_1d"].iloc[at]
    assert scaling.make_sequences(rows, ["signal"], "target_1d").count() == 80


def test_registered_selection_ranks_all_indicators_and_keeps_the_published_number(spark, monkeypatch):
    asked = []
    whole = selection.mutual_information
    monkeypatch.setattr(selection, "mutual_information", lambda folded, columns, *a, **k: asked.append(list(columns)) or whole(folded, columns, *a, **k))
    best = QUERIES["select_top_k"](spark, str(DATA / "sf0.001")).collect()
    assert asked == [list(features.FEATURES)] and len(features.FEATURES) == 109
    assert len(best) == selection.TOP_K == 60 and all(features.FEATURES[r["ordinal"]] == r["feature"] for r in best)
    assert all(f"'{c}'" in ORACLES["select_top_k"] for c in features.FEATURES) and "LIMIT 60" in ORACLES["select_top_k"]


def test_label_correlation_skips_missing_values_and_constants(spark):
    rows = panel(spark, {"A": 300}).selectExpr(
        "0 AS fold", "target_1d", "signal", "7D AS noise", "CASE WHEN day(date) > 9 THEN weak END AS weak", "double(null) AS gone"
    )
    found = {r["feature"]: r["tree"] for r in selection.label_correlation(rows, [*COLUMNS, "gone"], "target_1d").collect()}
    own = rows.toPandas()
    assert set(found) == set(COLUMNS) and found["noise"] is None
    for c in ("signal", "weak"):
        assert abs(found[c] - abs(own[c].corr(own.target_1d))) < 1e-12
    one_label = rows.selectExpr("fold", "1D AS target_1d", "signal")
    assert [r["tree"] for r in selection.label_correlation(one_label, ["signal"], "target_1d").collect()] == [None]
