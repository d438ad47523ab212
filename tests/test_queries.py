import pytest

from __spark_entry__ import entry, oracle_sql, queries
from barloom.plans.queries import QUERIES
from tests.compare import DATA, connect, differences

SF = "sf0.001"
QUICK = (
    "bars_supplier", "bars_quality", "bars_quality_audit", "bars_jumps", "align_outer", "feat_bands", "feat_autocorr",
    "feat_candle", "feat_ema_macd", "feat_rsi", "feat_obv_force", "feat_vol_rank", "regime", "targets_excess", "targets_rank",
    "split_position", "fold_members", "cs_zscore", "cs_rank", "sequences", "select_top_k", "ens_equal", "ens_auc_weighted",
    "ledger", "ledger_parity", "kelly_history", "cost_stress", "deciles", "roc_points", "drawdown", "var_cvar", "benchmark",
    "rolling_sharpe", "rank_ic", "walk_forward", "latest_forecast", "trade_stats_confident", "ledger_long_only", "ledger_audit",
    "diagnostics", "ens_weights", "model_report", "ens_calibration", "ens_calibrated", "ens_stacking", "panel_shared", "panel_isolated",
    "boosted_stumps", "bars_run_audit", "confidence_labels", "inner_folds", "mi_scores", "mi_top", "early_stop", "short_tickers", "best_model", "align_checked",
    "dates_shared", "dates_any", "frames_stacked",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(oracle_sql()) == {"gbt_scores", "select_top_fitted", "walk_forward_fitted"}


def test_entry(spark):
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_twin(spark, duck, name):
    ours = queries()[name](spark, str(DATA / SF)).toPandas()
    assert differences(ours, duck.execute(oracle_sql()[name]).df()) is None
