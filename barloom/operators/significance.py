"""How much of a Sharpe ratio is luck: block bootstrap, deflated ratio, verdict."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranks import quantiles
from barloom.functions.windows import extend, in_segments, is_daily, num
from barloom.operators.risk import sharpe
from barloom.session import cut_lineage

REPLICATES, SEED = 2000, 42
REPLICATE_SHARES = 64
EULER = 0.5772156649


def portfolio_returns(booked: DataFrame) -> DataFrame:
    """Equal-weight daily return per model over its tickers."""
    return booked.groupBy("model", "date").agg(F.avg("net_ret").alias("net_ret"))


def block_lengths(returns: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Returns with ``pos``, ``n`` and the block length ``len`` of their series.

    The length follows the first autocorrelation and is at most a quarter of the series.
    """
    lagged = in_segments(
        returns, lambda panel, axis: extend(panel, {"_prev": axis.lag("net_ret")}), back=1, keys=keys, keep=True
    ).drop("seg")
    rho = lagged.groupBy(*keys).agg(F.corr("_prev", "net_ret").alias("_rho"))
    joined = lagged.join(rho, list(keys))
    size = "greatest(1, int(round(1 / (1 - least(abs(coalesce(_rho, 0D)), 0.99D)))))"
    return extend(joined, {"len": f"least({size}, greatest(n div 4, 1))"}).drop("_prev", "_rho")


def bootstrap_sharpes(
    returns: DataFrame,
    keys: Sequence[str] = ("model",),
    replicates: int = REPLICATES,
    seed: int = SEED,
    risk_free: float = 0.0,
    parity: bool = False,
) -> DataFrame:
    """One Sharpe ratio per key and replicate from circular blocks.

    A block's start is a hash of (seed, replicate, block), so results do not depend on partitioning. Blocks
    that run over the end wrap around; ``parity`` cuts them instead. A block is one hash and two places in the running
    sums of the returns and of their squares, so the work is replicates times blocks, not days. A daily series fits
    one array (at most 366 values a year), so replicates are spread over tasks with the sums and drawn without joins.
    """
    if not is_daily(returns):
        raise ValueError("the bootstrap needs one return per DATE")
    # sums are taken around the series mean, so the spread keeps its precision
    centred = extend(block_lengths(returns, keys), {"_centre": f"avg(net_ret) OVER (PARTITION BY {', '.join(keys)})"})
    to_date = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY pos)"
    summed = extend(centred, {"_s": f"sum(net_ret - _centre) {to_date}", "_q": f"sum(pow(net_ret - _centre, 2)) {to_date}"})
    series = summed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("len").alias("len"),
        F.max("_centre").alias("_centre"),
        F.expr("array_sort(collect_list(struct(pos, _s, _q)))").alias("_sums"),
    ).selectExpr(*keys, "n", "len", "_centre", *[f"concat(array(0D), _sums.{c}) AS {c}" for c in ("_s", "_q")])
    shares = min(REPLICATE_SHARES, replicates)
    # an explicit number: the rows are few and small, but the work behind each is not
    tasks = max(shares, int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = (
        series.where("n >= 10")
        .selectExpr("*", f"explode(sequence(0, {shares - 1})) AS _share")
        .repartition(tasks, *keys, "_share")
        .selectExpr(*keys, "n", "len", "_centre", "_s", "_q", f"explode(sequence(_share, {replicates - 1}, {shares})) AS rep")
    )
    start = f"int(bigint(conv(substr(md5(concat_ws('-', '{seed}', rep, block)), 1, 8), 16, 10)) % n)"
    starts = f"transform(sequence(0, int((n - 1) div len)), block -> {start})"
    # ``t`` days are drawn before a block, which is shorter when fewer than ``len`` are left
    stop = "x + int(least(len, n - a.t))"
    inside, wrapped = f"int(least({stop}, n))", f"int(greatest({stop} - n, 0))"

    def drawn(sums: str) -> str:
        return f"{sums}[{inside}] - {sums}[x]" + ("" if parity else f" + {sums}[{wrapped}]")

    root, hurdle = num(math.sqrt(252)), num(risk_free / 252)
    spread_of = "sqrt(greatest(a.q - a.s * a.s / a.k, 0D) / (a.k - 1))"
    ratio = (
        f"aggregate({starts}, named_struct('t', 0L, 'k', 0L, 's', 0D, 'q', 0D), (a, x) -> named_struct("
        f"'t', a.t + least(len, n - a.t), 'k', a.k + {f'{inside} - x' if parity else 'least(len, n - a.t)'},"
        f" 's', a.s + {drawn('_s')}, 'q', a.q + {drawn('_q')}),"
        f" a -> CASE WHEN {spread_of} > 1e-10D THEN {root} * (_centre + a.s / a.k - {hurdle}) / {spread_of} ELSE 0D END)"
    )
    return spread.selectExpr(*keys, "rep", f"{ratio} AS sharpe")


def bootstrap_interval(
    returns: DataFrame, keys: Sequence[str] = ("model",), level: float = 0.95, **options
) -> DataFrame:
    """Percentile interval per key; series under ten rows get an infinite one. Reads the returns (one row a day) four times."""
    alpha = 1.0 - level
    returns = cut_lineage(returns)
    ratios = cut_lineage(bootstrap_sharpes(returns, keys, **options))
    bounds = quantiles(ratios, keys, "sharpe", {"ci_lower": alpha / 2, "ci_upper": 1 - alpha / 2})
    return (
        returns.select(*keys).distinct().join(bounds, list(keys), "left").selectExpr(
            *keys,
            "coalesce(ci_lower, double('-Infinity')) AS ci_lower",
            "coalesce(ci_upper, double('Infinity')) AS ci_upper",
        )
    )


def normal_cdf(x: str) -> str:
    """Standard normal distribution function, rational approximation good to seven digits."""
    # Published coefficients of the approximation (Abramowitz and Stegun 26.2.17).
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = f"(1 / (1 + 0.2316419D * abs({x})))"
    series = "0D"
    for coefficient in reversed(b):
        series = f"{t} * ({num(coefficient)} + {series})"
    tail = f"({num(1 / math.sqrt(2 * math.pi))} * exp(-({x}) * ({x}) / 2) * ({series}))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def trial_benchmark(trials: int) -> float:
    """Expected best z-score among ``trials`` worthless strategies."""
    count, quantile = max(trials, 2), NormalDist().inv_cdf
    return (1 - EULER) * quantile(1 - 1 / count) + EULER * quantile(1 - 1 / (count * math.e))


def deflated_sharpe(
    returns: DataFrame, keys: Sequence[str] = ("model",), trials: int = 9, risk_free: float = 0.0
) -> DataFrame:
    """Probability that the annualised ratio beats the best of ``trials`` worthless ones.

    The annualised ratio is compared with an unscaled z-score benchmark, as the method is published.
    """
    hurdle = num(risk_free / 252)
    stats = returns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.expr(f"avg(net_ret - {hurdle})").alias("_mean"),
        F.stddev_samp("net_ret").alias("_std"),
        F.coalesce(F.skewness("net_ret"), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.kurtosis("net_ret"), F.lit(0.0)).alias("excess_kurtosis"),
    )
    bench = num(trial_benchmark(trials))
    stats = extend(stats, {"sharpe": sharpe("_mean", "_std", "n_obs")})
    stats = extend(stats, {"_per": f"sharpe / {num(math.sqrt(252))}"})
    variance = "(1 - skewness * _per + excess_kurtosis / 4 * _per * _per) / greatest(n_obs - 1, 1)"
    stats = extend(stats, {"_z": f"(sharpe - {bench}) / sqrt(greatest(({variance}) * 252, 1e-12D))"})
    return stats.selectExpr(
        *keys, "n_obs", "sharpe", "skewness", "excess_kurtosis",
        f"{normal_cdf('_z')} AS dsr", f"{bench} AS sr_benchmark", f"{trials} AS n_trials",
    )


def significance_summary(
    returns: DataFrame, keys: Sequence[str] = ("model",), trials: int = 9, risk_free: float = 0.0, **options
) -> DataFrame:
    """Interval, deflated ratio and verdict per key, rounded as reported. Reads the returns several times."""
    returns = cut_lineage(returns)
    joined = deflated_sharpe(returns, keys, trials, risk_free).join(
        bootstrap_interval(returns, keys, risk_free=risk_free, **options), list(keys)
    )
    verdict = (
        "CASE WHEN dsr < 0.5D THEN 'FAIL' WHEN dsr < 0.8D THEN 'WEAK' WHEN dsr < 0.95D THEN 'MODERATE'"
        " ELSE 'SIGNIFICANT' END"
    )
    return joined.selectExpr(
        *keys,
        "round(ci_lower, 3) AS ci_lower",
        "round(ci_upper, 3) AS ci_upper",
        "round(ci_upper - ci_lower, 3) AS ci_width",
        "round(dsr, 4) AS dsr",
        "round(sr_benchmark, 3) AS sr_benchmark",
        "dsr > 0.95D AS is_significant",
        "n_obs",
        "n_trials",
        "round(skewness, 3) AS skewness",
        "round(excess_kurtosis, 3) AS excess_kurtosis",
        f"{verdict} AS verdict",
    )
