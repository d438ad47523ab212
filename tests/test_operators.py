import datetime as dt
import hashlib

import numpy as np
import pytest

from barloom.operators import alignment, classification, ensemble, ledger, quality, risk, significance, splits, targets
from barloom.sources import sinks
from barloom.sources.bars import first_of_each_name, read_bars, trailing_years, universe_audit
from tests.conftest import ordered

DAY = dt.date(2024, 1, 1)


def dates(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def test_each_consistency_rule_has_its_reason(spark):
    rows = [
        ("ok", 10.0, 11.0, 9.0, 10.0, 5.0), ("non_positive_price", 10.0, 11.0, -1.0, 10.0, 5.0),
        ("inverted_range", 10.0, 9.0, 11.0, 10.0, 5.0), ("open_outside_range", 12.0, 11.0, 9.0, 10.0, 5.0),
        ("close_outside_range", 10.0, 11.0, 9.0, 8.0, 5.0), ("negative_volume", 10.0, 11.0, 9.0, 10.0, -1.0),
        ("zero_volume", 10.0, 11.0, 9.0, 10.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "want string, open double, high double, low double, close double, volume double")
    got = df.withColumn("got", quality.rejection_reason()).collect()
    assert all((r.got or "ok") == r.want for r in got)


def test_long_gaps_drop_and_short_gaps_fill(spark):
    rows = []
    for i, day in enumerate(dates(30)):
        hole = 3 <= i < 6 or 10 <= i < 17
        rows.append(("A", day, *[None if hole else float(10 + i)] * 5))
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    kept = ordered(quality.ffill_then_bfill(quality.drop_long_gaps(df)), "date")
    assert len(kept) == 23
    assert kept.close[3:6].tolist() == [12.0] * 3


def test_last_arrival_wins_and_two_sources_raise(spark):
    df = spark.createDataFrame([("A", DAY, 1, 5.0), ("A", DAY, 2, 6.0)], "ticker string, date date, ingest_seq int, close double")
    assert quality.dedupe_keep_last(df).collect()[0].close == 6.0
    twice = spark.createDataFrame([(1, 1, 1, 1, 1, 1)], "open int, high int, low int, Close int, `Adj Close` int, vol int")
    with pytest.raises(ValueError):
        quality.normalise_columns(twice, keep=())


def test_outer_alignment_fills_at_most_five_days(spark):
    rows = [("A", d, 1.0) for d in dates(20)] + [("B", DAY, 2.0), ("B", DAY + dt.timedelta(days=10), 3.0)]
    got = alignment.align_outer(spark.createDataFrame(rows, "ticker string, date date, close double")).toPandas()
    b = got[got.ticker == "B"]
    assert len(b) == 12 and b.filled.sum() == 10
    assert alignment.align_inner(spark.createDataFrame(rows, "ticker string, date date, close double")).count() == 4


@pytest.mark.parametrize("n, width, folds", [(2494, 267, 8), (2436, 260, 8), (2395, 255, 8), (1000, 81, 8), (340, 0, 0)])
def test_fold_layout(spark, n, width, folds):
    df = spark.range(n).selectExpr("'A' AS ticker", "date_add(date'2000-01-01', int(id)) AS date")
    got = ordered(splits.expanding_folds(df), "fold")
    assert len(got) == folds
    if folds:
        assert got.train_end.tolist() == [300 + k * width for k in range(8)]
        assert (got.test_start - got.train_end == 51).all()
        assert (got.test_start[1:].values == got.test_end[:-1].values).all()
        members = splits.fold_members(df).groupBy("fold", "role").count().toPandas()
        assert set(members[members.role == "test"]["count"]) == {width}


def test_position_split_is_disjoint_and_complete(bars):
    got = splits.position_split(bars).groupBy("ticker", "split").count().toPandas()
    assert got.groupby("ticker")["count"].sum().tolist() == [420, 420]
    assert set(got.split) == {"train", "val", "test"}
    redone = splits.split_cleaned(bars, lambda df: df.where("split <> 'val' OR ticker = 'A'"))
    assert redone.select("ticker").distinct().collect()[0].ticker == "A"


def test_unknown_target_mode_raises(bars):
    with pytest.raises(ValueError):
        targets.add_targets(bars, "nonsense")
    last = targets.add_targets(bars, "binary", parity=True).where("target_1d IS NULL")
    assert last.count() == 0


def ledger_of(spark, probabilities, opens, **options):
    n = len(probabilities)
    bars = spark.createDataFrame([("A", d, o, o) for d, o in zip(dates(len(opens)), map(float, opens))], "ticker string, date date, open double, close double")
    scores = spark.createDataFrame([("m", "A", d, p, 1) for d, p in zip(dates(n), probabilities)], "model string, ticker string, date date, p double, y int")
    return ordered(ledger.ledger(scores, bars, **options), "date")


def test_stop_closes_one_bar_and_reenters(spark):
    got = ledger_of(spark, [1.0] * 6, [100, 100, 100, 90, 90, 80, 80, 80.0], kelly=False, rate=0.0)
    # entry 100 at bar 0; bar 2 sees 90 and stops; bar 3 enters at 90; bar 4 sees 80 and stops; bar 5 enters
    assert got.stopped.tolist() == [False, False, True, False, True, False]
    assert got.signal.tolist() == [1, 1, 0, 1, 0, 1]
    np.testing.assert_allclose(got.equity, np.cumprod(1 + got.net_ret))


def _stops(prices, sides, limit):
    """Bars stopped when one series is walked bar by bar."""
    stopped, entry, before = [], None, None
    for price, side in zip(prices, sides):
        entry, before = (entry if side == before else None), side
        hit = entry is not None and side * (price - entry) / entry < -limit
        stopped.append(bool(hit))
        entry = None if hit else price if entry is None else entry
    return stopped


def test_stop_in_runs_of_either_side_against_a_walk(spark):
    rng = np.random.default_rng(11)
    rows, wanted = [], []
    for model in ("m", "k"):
        prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 300)))
        sides = np.repeat(rng.choice([-1.0, 0.0, 1.0], 60), 5)
        rows += [(model, "A", d, float(s), float(p)) for d, s, p in zip(dates(300), sides, prices)]
        wanted.append((model, _stops(prices, sides, 0.05)))
    df = spark.createDataFrame(rows, "model string, ticker string, date date, signal double, next_open double")
    got = ledger.stop_loss(ledger.with_position(df, ledger.KEYS), 0.05).toPandas().sort_values(["model", "date"])
    for model, stops in wanted:
        part = got[got.model == model]
        assert part.stopped.tolist() == stops and any(stops)
        assert (part.signal[part.stopped] == 0).all()


def test_stop_passes_one_run_of_200000_bars(spark):
    n = 200_000
    df = spark.range(n).selectExpr(
        "'m' AS model", "'A' AS ticker", "timestamp_seconds(1500000000 + 600 * id) AS date", "1D AS signal",
        "100 + 10 * sin(id / 7D) AS next_open",
    )
    got = ledger.stop_loss(ledger.with_position(df, ledger.KEYS), 0.05).select("date", "next_open", "stopped").toPandas().sort_values("date")
    assert len(got) == n
    assert got.stopped.tolist() == _stops(got.next_open.to_numpy(), np.ones(n), 0.05)


def test_run_audit_accounts_for_every_raw_row(spark):
    rows = [("A", d, 1, "10", "11", "9", "10", "5") for d in dates(30)]
    rows += [("A", dates(30)[3], 2, "10", "11", "9", "10", "6")]  # a duplicate
    rows += [("B", d, 1, "10", "11", "9", "10", None if 2 <= i < 12 else "5") for i, d in enumerate(dates(20))]  # a long gap
    rows += [("C", d, 1, "10", "11", "9", "10", "n/a") for d in dates(4)]  # nothing to fill from
    rows += [("D", d, 1, "10", "11", "9", "30" if i == 1 else "10", "5") for i, d in enumerate(dates(5))]  # close out of range
    raw = spark.createDataFrame(rows, "ticker string, date date, ingest_seq int, open string, high string, low string, close string, volume string")
    got = {r.ticker: r for r in quality.run_audit(raw, min_rows=10).collect()}
    assert (got["A"].raw_rows, got["A"].duplicates, got["A"].clean, got["A"].kept) == (31, 1, 30, 30)
    assert (got["B"].long_gap, got["B"].clean, got["B"].kept) == (10, 10, 10)
    assert (got["C"].unfilled, got["C"].clean) == (4, 0)
    assert (got["D"].inconsistent, got["D"].clean, got["D"].kept) == (1, 4, 0)
    for r in got.values():
        assert r.raw_rows == r.duplicates + r.long_gap + r.unfilled + r.inconsistent + r.clean


def test_reversal_cost_with_and_without_extra_leg(spark):
    opens = [100.0] * 6
    plain = ledger_of(spark, [1.0, 0.0, 0.0], opens, kelly=False, rate=0.01)
    assert plain.cost.tolist() == pytest.approx([0.01, 0.02, 0.0])
    parity = ledger_of(spark, [1.0, 0.0, 0.0], opens, kelly=False, rate=0.01, parity=True)
    assert parity.cost.tolist() == pytest.approx([0.01, 0.03, 0.0])


def test_default_impact_is_ten_basis_points():
    assert ledger.impact_bps() == pytest.approx(10.0)
    assert ledger.cost_rate() == pytest.approx(13e-4)


def test_drawdown_duration_and_recovery(spark):
    equity = [1.0, 1.2, 0.9, 0.6, 1.0, 1.2, 1.3]
    peaks = np.maximum.accumulate(equity)
    rows = [("m", "A", i, float(e), float(p), float((e - p) / p)) for i, (e, p) in enumerate(zip(equity, peaks))]
    df = spark.createDataFrame(rows, "model string, ticker string, pos long, equity double, peak double, underwater double")
    got = risk.drawdowns(df).collect()[0]
    assert got.max_dd == pytest.approx(-0.5) and got.max_dd_duration == 2 and got.max_dd_recovery == 2


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(1)
    p, y = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    df = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "model string, p double, y int")
    up, down = p[y == 1], p[y == 0]
    pairs = (up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()
    assert classification.auc(df).collect()[0].auc == pytest.approx(pairs / (len(up) * len(down)))


def test_identical_confidences_form_one_bin(spark):
    df = spark.createDataFrame([("m", 0.7, i % 2) for i in range(20)], "model string, p double, y int")
    got = classification.hit_rate_by_decile(df).collect()
    assert len(got) == 1 and got[0].n == 20 and got[0].hit_rate == 0.5


def test_weighted_mean_renormalises_and_handles_missing(spark):
    scores = spark.createDataFrame(
        [("a", "T", DAY, 0.2), ("b", "T", DAY, None), ("a", "U", DAY, None), ("b", "U", DAY, None)],
        "model string, ticker string, date date, p double")
    weights = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "model string, weight double")
    for parity, none in ((False, None), (True, 0.0)):
        got = {r.ticker: r.p for r in ensemble.weighted_mean(scores, weights, parity=parity).collect()}
        assert got == {"T": 0.2, "U": none}


def test_ensemble_weights_sum_to_one(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, day in enumerate(dates(200)):
        y = int(rng.integers(0, 2))
        base = 0.5 + (0.2 if y else -0.2) * rng.random()
        rows += [("a", "T", day, base, y), ("b", "T", day, base + 0.01 * rng.random(), y), ("c", "T", day, rng.random(), y)]
    df = spark.createDataFrame(rows, "model string, ticker string, date date, p double, y int")
    got = ensemble.ensemble_weights(df, ("a", "b", "c")).toPandas()
    assert got.weight.sum() == pytest.approx(1.0)
    assert (got.adjusted <= got.auc + 1e-12).all()


def test_bootstrap_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("m", d, float(r)) for d, r in zip(dates(120), rng.normal(0.001, 0.01, 120))], "model string, date date, net_ret double")
    one = significance.bootstrap_interval(df.coalesce(1), replicates=200).collect()[0]
    many = significance.bootstrap_interval(df.repartition(7), replicates=200).collect()[0]
    assert (one.ci_lower, one.ci_upper) == pytest.approx((many.ci_lower, many.ci_upper))
    assert one.ci_lower < one.ci_upper


@pytest.mark.parametrize("parity", [False, True])
def test_bootstrap_draws_the_blocks_it_hashes(spark, parity):
    noise = np.random.default_rng(5).normal(0.0, 0.01, 131)
    walk = [0.0]
    for shock in noise[1:]:
        walk.append(0.85 * walk[-1] + shock)  # blocks of several days, and a last block that is shorter
    df = spark.createDataFrame([("m", d, float(r)) for d, r in zip(dates(131), walk)], "model string, date date, net_ret double")
    length = significance.block_lengths(df).first()["len"]
    assert length > 2 and 131 % length
    got = {r.rep: r.sharpe for r in significance.bootstrap_sharpes(df, replicates=40, seed=9, parity=parity).collect()}
    assert sorted(got) == list(range(40))
    for rep, value in got.items():
        drawn = []
        for t in range(131):
            digest = hashlib.md5(f"9-{rep}-{t // length}".encode()).hexdigest()
            place = int(digest[:8], 16) % 131 + t % length
            if place < 131 or not parity:
                drawn.append(walk[place % 131])
        assert value == pytest.approx(np.sqrt(252) * np.mean(drawn) / np.std(drawn, ddof=1), rel=1e-9)


def test_normal_cdf_and_benchmark(spark):
    from statistics import NormalDist

    points = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "z double")
    for row in points.selectExpr("z", f"{significance.normal_cdf('z')} AS c").collect():
        assert row.c == pytest.approx(NormalDist().cdf(row.z), abs=1e-7)


def test_sources_and_sinks_round_trip(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    sinks.write_table(bars, path)
    assert read_bars(spark, path, tickers=["A"]).count() == 420
    assert universe_audit(bars, ["A", "Z"]).where("status = 'missing'").count() == 1
    assert trailing_years(bars, 1).count() < bars.count()
    assert first_of_each_name(bars.selectExpr("ticker", "close", "close AS CLOSE")).columns == ["ticker", "close"]
    recorded = sinks.manifest(spark, path).cache()
    assert recorded.count() > 0 and sinks.manifest_differences(spark, path, recorded).count() == 0
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_log(spark.createDataFrame([("r", 1.0)], "run string, value double"), log)
    assert spark.read.parquet(log).count() == 2
    names = str(tmp_path / "names")
    sinks.write_feature_list(spark.createDataFrame([(1, "b"), (0, "a")], "ordinal int, feature string"), names)
    assert sinks.read_feature_list(spark, names, []) == ["a", "b"]
    assert sinks.read_feature_list(spark, str(tmp_path / "absent"), ["x"]) == ["x"]


def test_stacking_keeps_bars_that_lack_a_score(spark):
    """A score that is null, NaN or not there at all: the bar keeps its row, without a probability and marked."""
    rng = np.random.default_rng(2)
    rows = []
    for i, day in enumerate(dates(60)):
        y = int(rng.random() < 0.5)
        rows.append(("m1", "A", day, float(0.3 + 0.4 * y + 0.1 * rng.normal()), y))
        if i % 10 == 3:
            continue
        p = None if i % 10 == 0 else float("nan") if i % 10 == 7 else float(rng.random())
        rows.append(("m2", "A", day, p, y))
    lacking = {day for i, day in enumerate(dates(60)) if i % 10 in (0, 3, 7)}
    scores = spark.createDataFrame(rows, "model string, ticker string, date date, p double, y int")
    got = ensemble.stack_predict(ensemble.stack_fit(scores, ("m1", "m2")), scores).collect()
    assert len(got) == 60 == len({r.date for r in got})
    for r in got:
        assert r.missing == (r.date in lacking) and (r.p is None) == r.missing
        assert r.missing or 0 < r.p < 1
