"""Trailing-window indicators of a bar panel.

``build_features`` runs in three stages on halo-extended segments: per-row inputs and lags, all first-level
windows and exponential means, then what builds on those. Each stage is one ``withColumns``, so equal window
expressions are shared, every frame uses the same sort, and columns nobody selects are pruned from the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expanding import expanding_rank
from barloom.functions.rolling import Roll, roll_mean, roll_std, roll_when_full, rolling
from barloom.functions.windows import (
    EPS,
    EWM_HALO,
    Axis,
    ewm_columns,
    extend,
    in_segments,
    num,
    period_alpha,
    span_alpha,
    with_position,
)

RETURN_LAGS = (1, 2, 3, 5, 10, 20)
SMA_WINDOWS = (5, 10, 20, 50, 100, 200)
SMA_CROSSES = ((5, 20), (10, 50), (20, 50), (50, 200))
EMA_SPANS = (9, 12, 21, 26)
RSI_PERIODS = (7, 14, 21)
ATR_PERIODS = (7, 14, 21)
BAND_WINDOWS = (10, 20)
GK_WINDOWS = (5, 20)
VOL_WINDOWS = (5, 10, 20, 60)
VOLUME_WINDOWS = (5, 10, 20)
ROC_PERIODS = (5, 10, 20)
DONCHIAN_WINDOWS = (10, 20)
ZSCORE_WINDOWS = (20, 60, 120)
REGIME_WINDOW = 60
YEAR = 252
LOOKBACK = 280

SMA_LEVELS = tuple(f"sma_{k}" for k in SMA_WINDOWS)

FAMILIES: dict[str, tuple[str, ...]] = {
    "returns": tuple(f"{kind}_{k}d" for k in RETURN_LAGS for kind in ("ret", "log_ret")),
    "sma": tuple(f"price_vs_sma_{k}" for k in SMA_WINDOWS)
    + tuple(f"sma_cross_{a}_{b}" for a, b in SMA_CROSSES),
    "ema": tuple(f"price_vs_ema_{k}" for k in EMA_SPANS)
    + ("macd", "macd_signal", "macd_hist", "macd_cross", "macd_norm"),
    "rsi": tuple(f"rsi_{p}{tail}" for p in RSI_PERIODS for tail in ("", "_dist_50", "_lag_3", "_momentum")),
    "bands": tuple(f"bb_{kind}_{k}" for k in BAND_WINDOWS for kind in ("width", "pos", "squeeze")),
    "atr": tuple(f"atr_{p}{tail}" for p in ATR_PERIODS for tail in ("", "_norm")) + ("keltner_pos",),
    "gk": tuple(f"gk_vol_{k}" for k in GK_WINDOWS),
    "volatility": tuple(f"vol_{k}d" for k in VOL_WINDOWS) + ("hv_ratio_5_20", "hv_ratio_10_60"),
    "vol_rank": tuple(f"vol_{k}d_rank" for k in VOL_WINDOWS),
    "volume": tuple(f"vol_ratio_{k}" for k in VOLUME_WINDOWS) + ("vol_trend_5", "amihud", "vwap_dev"),
    "obv": ("obv_norm", "force_index_2", "force_index_13"),
    "candle": ("body", "body_pct", "upper_shadow", "lower_shadow", "high_low_pct"),
    "roc": tuple(f"roc_{k}" for k in ROC_PERIODS),
    "elder": ("elder_bull", "elder_bear"),
    "year_range": ("dist_52w_high", "dist_52w_low", "52w_range_pct"),
    "regime": ("regime_trend", "regime_vol", "regime_mr"),
    "autocorr": ("autocorr_1", "autocorr_5"),
    "entropy": ("ret_entropy_20",),
    "oscillators": ("stoch_k", "stoch_d", "williams_r", "cci"),
    "donchian": tuple(f"don_{kind}_{k}" for k in DONCHIAN_WINDOWS for kind in ("pos", "width")),
    "zscore": tuple(f"zscore_{k}" for k in ZSCORE_WINDOWS),
    "acceleration": ("price_accel", "vol_accel"),
}
FEATURES: tuple[str, ...] = tuple(name for family in FAMILIES.values() for name in family)
OUTPUTS = SMA_LEVELS + FEATURES


def _smooth_name(series: str, alpha: float) -> str:
    return f"_ewm{series}_{round(alpha * 1e6)}"


class _Needs:
    """Collects the lags, rolling statistics and exponential means the requested formulas refer to.

    Formulas see only column names, so a plan holds exactly what the requested indicators use.
    """

    # Fixed positions of the first non-null value per derived series.
    FIRST = {"_lr": 1, "_dc": 1, "_lr_lag_1": 2, "_lr_lag_5": 6, "_gain": 1, "_loss": 1, "_force": 1, "_ill": 1}

    def __init__(self) -> None:
        self.rolls: set[Roll] = set()
        self.lags: set[tuple[str, int]] = set()
        self.series: set[str] = set()
        self.smooth: dict[str, tuple[str, float, int]] = {}

    def use(self, series: str) -> str:
        if series.startswith("_"):
            self.series.add(series)
        return series

    def moment(self, stat: str, series: str, rows: int, other: str = "") -> Roll:
        self.use(series)
        self.use(other)
        request = Roll(stat, series, rows, self.FIRST.get(series, 0), other)
        self.rolls.add(request)
        return request

    def lag(self, series: str, rows: int) -> str:
        self.lags.add((series, rows))
        return f"_lag{rows}_{series}"

    def mean(self, series: str, rows: int, min_rows: int | None = None) -> str:
        request = self.moment("sum", series, rows)
        return f"({roll_when_full(request, roll_mean(request), min_rows)})"

    def sum(self, series: str, rows: int) -> str:
        request = self.moment("sum", series, rows)
        return f"({roll_when_full(request, request.name)})"

    def std(self, series: str, rows: int, min_rows: int | None = None) -> str:
        request = self.moment("m2", series, rows)
        return f"({roll_when_full(request, roll_std(request), min_rows)})"

    def extreme(self, stat: str, series: str, rows: int, min_rows: int | None = None) -> str:
        request = self.moment(stat, series, rows)
        return f"({roll_when_full(request, request.name, min_rows)})"

    def ewm(self, series: str, alpha: float) -> str:
        name = _smooth_name(series, alpha)
        self.smooth[name] = (self.use(series), alpha, self.FIRST.get(series, 0))
        return name


def _series(name: str, needs: _Needs) -> str:
    """Definition of a derived input series."""
    if name == "_range":
        return "nullif(high - low, 0D)"
    if name == "_tp":
        return "(high + low + close) / 3"
    if name == "_flow":
        return "(high + low + close) / 3 * volume"
    if name == "_gk":
        return (
            f"0.5D * pow(ln(high / (low + {EPS}) + {EPS}), 2)"
            f" - {num(2 * math.log(2) - 1)} * pow(ln(close / (open + {EPS}) + {EPS}), 2)"
        )
    if name.startswith("_lr_lag_"):
        k = int(name.removeprefix("_lr_lag_"))
        return f"ln(try_divide({needs.lag('close', k)}, {needs.lag('close', k + 1)}))"
    prev = needs.lag("close", 1)
    log_return = f"ln(try_divide(close, {prev}))"
    return {
        "_lr": log_return,
        "_gain": f"CASE WHEN {prev} IS NOT NULL THEN greatest(close - {prev}, 0D) END",
        "_loss": f"CASE WHEN {prev} IS NOT NULL THEN greatest({prev} - close, 0D) END",
        "_tr": f"greatest(high - low, abs(high - {prev}), abs(low - {prev}))",
        "_ill": f"abs({log_return}) / (volume * close + {EPS})",
        "_up": f"double(coalesce({log_return} > 0, false))",
        "_down": f"double(coalesce({log_return} < 0, false))",
        "_force": f"(close - {prev}) * volume",
        "_signed": f"coalesce(signum({log_return}) * volume, 0D)",
    }[name]


def _formula(name: str, w: _Needs) -> str:
    """First-level indicator ``name``; later levels refer to these by name."""
    stem, _, tail = name.rpartition("_")
    number = int(tail) if tail.isdigit() else int(tail[:-1]) if tail[:-1].isdigit() else 0

    def sma(k: int) -> str:
        return w.mean("close", k, min(max(k // 4, 5), k))

    def ema(k: int) -> str:
        return w.ewm("close", span_alpha(k))

    if stem == "log_ret":
        return f"ln(close / ({w.lag('close', number)} + {EPS}))"
    if stem == "ret":
        return f"try_divide(close, {w.lag('close', number)}) - 1"
    if stem == "roc":
        return f"close / ({w.lag('close', number)} + {EPS}) - 1"
    if stem == "sma":
        return sma(number)
    if stem == "price_vs_sma":
        return f"close / ({sma(number)} + {EPS}) - 1"
    if name.startswith("sma_cross_"):
        fast, slow = (int(x) for x in name.split("_")[2:])
        return f"{sma(fast)} / ({sma(slow)} + {EPS}) - 1"
    if stem == "price_vs_ema":
        return f"close / ({ema(number)} + {EPS}) - 1"
    if name == "macd":
        return f"{ema(12)} - {ema(26)}"
    if name == "macd_norm":
        return f"({ema(12)} - {ema(26)}) / (close + {EPS})"
    if stem == "rsi":
        gain, loss = w.ewm("_gain", period_alpha(number)), w.ewm("_loss", period_alpha(number))
        return f"100 - 100 / (1 + {gain} / ({loss} + {EPS}))"
    if stem in ("bb_width", "bb_pos", "bb_squeeze"):
        mean, std = w.mean("close", number), w.std("close", number)
        width = f"(({mean} + 2 * {std}) - ({mean} - 2 * {std}))"
        return {
            "bb_width": f"{width} / ({mean} + {EPS})",
            "bb_pos": f"(close - ({mean} - 2 * {std})) / ({width} + {EPS})",
            "bb_squeeze": f"{std} / ({mean} + {EPS})",
        }[stem]
    if stem == "atr":
        return w.ewm("_tr", period_alpha(number))
    if stem.startswith("atr_"):
        return f"{w.ewm('_tr', period_alpha(int(stem.removeprefix('atr_'))))} / (close + {EPS})"
    if name == "keltner_pos":
        atr = w.ewm("_tr", period_alpha(14))
        return f"(close - ({ema(21)} - 2 * {atr})) / (4 * {atr} + {EPS})"
    if stem == "gk_vol":
        mean = w.mean("_gk", number)
        return f"CASE WHEN {mean} IS NOT NULL THEN sqrt(greatest({mean}, 0D) * {YEAR}) END"
    if stem == "vol":
        return f"{w.std('_lr', number)} * {num(math.sqrt(YEAR))}"
    if name.startswith("hv_ratio_"):
        fast, slow = (int(x) for x in name.split("_")[2:])
        return f"{w.std('_lr', fast)} / ({w.std('_lr', slow)} + {EPS})"
    if stem == "vol_ratio":
        return f"volume / ({w.mean('volume', number)} + {EPS})"
    if name == "vol_trend_5":
        return f"try_divide(volume, {w.lag('volume', 5)}) - 1"
    if name == "amihud":
        return w.mean("_ill", 20)
    if name == "vwap_dev":
        vwap = f"({w.sum('_flow', 20)} / ({w.sum('volume', 20)} + {EPS}))"
        return f"(close - {vwap}) / ({vwap} + {EPS})"
    if name in FAMILIES["candle"]:
        span = w.use("_range")
        return {
            "body": f"(close - open) / (open + {EPS})",
            "body_pct": f"abs(close - open) / ({span} + {EPS})",
            "upper_shadow": f"(high - greatest(open, close)) / ({span} + {EPS})",
            "lower_shadow": f"(least(open, close) - low) / ({span} + {EPS})",
            "high_low_pct": f"{span} / (close + {EPS})",
        }[name]
    if stem == "elder":
        side = "high" if tail == "bull" else "low"
        return f"({side} - {ema(13)}) / ({ema(13)} + {EPS})"
    if name in FAMILIES["year_range"]:
        top, bottom = w.extreme("max", "close", YEAR, 60), w.extreme("min", "close", YEAR, 60)
        return {
            "dist_52w_high": f"close / ({top} + {EPS}) - 1",
            "dist_52w_low": f"close / ({bottom} + {EPS}) - 1",
            "52w_range_pct": f"(close - {bottom}) / ({top} - {bottom} + {EPS})",
        }[name]
    k = REGIME_WINDOW
    root = num(math.sqrt(k))
    if name == "regime_trend":
        return f"{w.mean('_lr', k)} / ({w.std('_lr', k)} + {EPS}) * {root}"
    if name == "regime_vol":
        return f"{w.std('_lr', 20)} / ({w.std('_lr', 120)} + {EPS})"
    if name == "regime_mr":
        return f"(close - {w.mean('close', k)}) / ({w.std('_lr', k)} * {root} + {EPS})"
    if stem == "autocorr":
        return _autocorr(w, {1: 20, 5: 30}[number], number)
    if name == "ret_entropy_20":
        return _entropy(w, 20)
    if name in ("stoch_k", "williams_r"):
        high, low = w.extreme("max", "high", 14), w.extreme("min", "low", 14)
        if name == "stoch_k":
            return f"(close - {low}) / ({high} - {low} + {EPS}) * 100"
        return f"({high} - close) / ({high} - {low} + {EPS}) * -100"
    if name == "cci":
        return f"({w.use('_tp')} - {w.mean('_tp', 20)}) / (0.015D * {w.std('_tp', 20)} + {EPS})"
    if stem in ("don_pos", "don_width"):
        high, low = w.extreme("max", "high", number), w.extreme("min", "low", number)
        if stem == "don_pos":
            return f"(close - {low}) / ({high} - {low} + {EPS})"
        return f"({high} - {low}) / (close + {EPS})"
    if stem == "zscore":
        return f"(close - {w.mean('close', number)}) / ({w.std('close', number)} + {EPS})"
    if name == "price_accel":
        return f"{w.use('_lr')} - {w.use('_lr_lag_1')}"
    if name == "_std_lr_10":
        return w.std("_lr", 10)
    raise ValueError(f"unknown indicator: {name}")


def _autocorr(w: _Needs, rows: int, lag: int) -> str:
    """Lagged correlation inside the window; 0 when it is degenerate or still holds the missing first return."""
    pairs, before = rows - lag, f"_lr_lag_{lag}"
    scale = f"(sqrt({w.moment('m2', '_lr', pairs).name}) * sqrt({w.moment('m2', before, pairs).name}))"
    covariation = w.moment("co", before, pairs, "_lr").name
    return (
        f"CASE WHEN pos < {rows - 1} OR n < {rows + lag} THEN NULL"
        f" WHEN pos >= {rows} AND {scale} > 1e-10D THEN {covariation} / ({scale} + 1e-12D) ELSE 0D END"
    )


def _entropy(w: _Needs, rows: int) -> str:
    """Entropy of up, down and other moves; the missing first return counts as other."""
    up, down = f"({w.sum('_up', rows)} / {rows}D)", f"({w.sum('_down', rows)} / {rows}D)"
    parts = [
        f"(CASE WHEN {s} > 0 THEN {s} * ln({s} + 1e-12D) ELSE 0D END)" for s in (up, down, f"(1 - {up} - {down})")
    ]
    return f"CASE WHEN pos >= {rows - 1} THEN -({' + '.join(parts)}) END"


# Second-level indicators and the first-level ones they are made of.
_SECOND = {
    "macd_signal": ("macd",),
    "macd_hist": ("macd",),
    "macd_cross": ("macd",),
    "stoch_d": ("stoch_k",),
    "vol_accel": ("_std_lr_10",),
    **{f"rsi_{p}{tail}": (f"rsi_{p}",) for p in RSI_PERIODS for tail in ("_dist_50", "_lag_3", "_momentum")},
    **{f"vol_{k}d_rank": (f"vol_{k}d",) for k in VOL_WINDOWS},
}


def _second_level(panel: DataFrame, axis: Axis, names: set[str]) -> DataFrame:
    columns: dict[str, str] = {}
    if names & {"macd_signal", "macd_hist", "macd_cross"}:
        panel = extend(panel, ewm_columns(axis, {"macd_signal": ("macd", span_alpha(9), 0)}))
        columns["macd_hist"] = "macd - macd_signal"
        columns["macd_cross"] = "int(macd > macd_signal)"
    columns["stoch_d"] = axis.roll("avg", "stoch_k", 3)
    columns["vol_accel"] = f"_std_lr_10 - {axis.lag('_std_lr_10')}"
    for p in RSI_PERIODS:
        columns[f"rsi_{p}_dist_50"] = f"rsi_{p} - 50"
        columns[f"rsi_{p}_lag_3"] = axis.lag(f"rsi_{p}", 3)
        columns[f"rsi_{p}_momentum"] = f"rsi_{p} - {axis.lag(f'rsi_{p}', 3)}"
    return extend(panel, {name: text for name, text in columns.items() if name in names})


def _with_history_totals(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add signed volume and volume before the first row of the window, and the whole volume.

    Segments get theirs from a table with one row per segment.
    """
    names = ", ".join(keys)
    if "halo" not in panel.columns:
        total = f"sum(volume) OVER (PARTITION BY {names})"
        return extend(panel, {"_signed_start": "0D", "_volume_start": "0D", "_volume_total": total})
    before = f"OVER (PARTITION BY {names} ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    totals = (
        panel.groupBy(*keys, "seg")
        .agg(
            F.expr("sum(_signed) FILTER (WHERE NOT halo) AS _signed_own"),
            F.expr("sum(_signed) FILTER (WHERE halo) AS _signed_halo"),
            F.expr("sum(volume) FILTER (WHERE NOT halo) AS _volume_own"),
            F.expr("sum(volume) FILTER (WHERE halo) AS _volume_halo"),
        )
        .selectExpr(
            *keys,
            "seg",
            *[
                f"coalesce(sum(_{x}_own) {before}, 0D) - coalesce(_{x}_halo, 0D) AS _{x}_start"
                for x in ("signed", "volume")
            ],
            f"sum(_volume_own) OVER (PARTITION BY {names}) AS _volume_total",
        )
    )
    return panel.join(totals, [*keys, "seg"])


def _volume_flow(panel: DataFrame, axis: Axis, keys: Sequence[str], causal: bool) -> DataFrame:
    """On-balance volume against its mean, and force index scaled by mean volume.

    The mean volume runs to the current bar; ``causal=False`` takes the whole series, which looks ahead.
    """
    upto = axis.history()
    mean = f"(_volume_start + sum(volume) {upto}) / (pos + 1)" if causal else "_volume_total / n"
    panel = extend(
        _with_history_totals(panel, keys),
        {"_obv": f"_signed_start + sum(_signed) {upto}", "_volume_mean": mean},
    )
    panel = extend(panel, ewm_columns(axis, {"_obv_mean": ("_obv", span_alpha(20), 0)}))
    outputs = {"obv_norm": f"(_obv - _obv_mean) / (abs(_obv_mean) + {EPS})"}
    for k in (2, 13):
        smooth = _smooth_name("_force", span_alpha(k))
        outputs[f"force_index_{k}"] = f"{smooth} / (close * _volume_mean + {EPS})"
    return extend(panel, outputs)


def build_features(
    bars: DataFrame,
    columns: Sequence[str] = OUTPUTS,
    keys: Sequence[str] = ("ticker",),
    causal: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """The input columns plus the requested indicators (default: all of them).

    ``keys`` may add ``split`` or ``fold`` so that no window crosses such a border. ``rows`` overrides the
    segment length.
    """
    unknown = [c for c in columns if c not in OUTPUTS]
    if unknown:
        raise ValueError(f"unknown indicators: {unknown}")
    wanted = set(columns)
    flow = wanted & set(FAMILIES["obv"])
    second = wanted & set(_SECOND)
    first = sorted((wanted - second - flow) | {part for name in second for part in _SECOND[name]})

    needs = _Needs()
    formulas = {name: _formula(name, needs) for name in first}
    if flow:
        needs.use("_signed")
        for k in (2, 13):
            needs.ewm("_force", span_alpha(k))
    derived = {name: _series(name, needs) for name in sorted(needs.series)}

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        lags = {f"_lag{k}_{series}": axis.lag(series, k) for series, k in sorted(needs.lags)}
        panel = rolling(extend(extend(panel, lags), derived), axis, needs.rolls)
        panel = extend(extend(panel, ewm_columns(axis, needs.smooth)), formulas)
        panel = _second_level(panel, axis, second)
        return _volume_flow(panel, axis, keys, causal) if flow else panel

    positioned = with_position(bars, keys)
    back = EWM_HALO if needs.smooth else LOOKBACK
    ranked = {name: name.removesuffix("_rank") for name in FAMILIES["vol_rank"] if name in wanted}
    features = in_segments(positioned, stage, back=back, keys=keys, rows=rows, keep=bool(ranked), blocks=bool(needs.smooth))
    if ranked:
        features = expanding_rank(features, ranked, keys, in_order=rows is None)
    return require_indicators(features.selectExpr(*bars.columns, *[f"`{c}`" for c in columns]), columns)


def require_indicators(features: DataFrame, names: Sequence[str] = SMA_LEVELS) -> DataFrame:
    missing = [c for c in names if c not in features.columns]
    if missing:
        raise ValueError(f"missing indicators: {missing}")
    return features


def feature_columns(features: DataFrame) -> list[str]:
    """Model inputs in a fixed order: indicators without the raw moving-average levels."""
    return [c for c in FEATURES if c in features.columns]


def ma_crossover_signal(
    bars: DataFrame, fast: int = 5, slow: int = 20, keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Add ``p``: 1.0 where the fast average is above the slow one, else 0.0 (also during warm-up)."""

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        above = f"{axis.roll('avg', 'close', fast)} > {axis.roll('avg', 'close', slow)}"
        return extend(panel, {"p": f"coalesce(double({above}), 0D)"})

    return in_segments(bars, stage, back=slow, keys=keys)


def classify_regime(
    bars: DataFrame,
    trend_rows: int = 60,
    short_rows: int = 20,
    long_rows: int = 120,
    trend_limit: float = 0.5,
    vol_limit: float = 1.3,
    keys: Sequence[str] = ("ticker",),
) -> DataFrame:
    """Add ``regime``. A volatility spike wins over a trend; undecided bars are mean reverting."""
    needs = _Needs()
    half = trend_rows // 2
    trend = (
        f"{needs.mean('_lr', trend_rows, half)} / ({needs.std('_lr', trend_rows, half)} + {EPS})"
        f" * {num(math.sqrt(YEAR))}"
    )
    ratio = (
        f"{needs.std('_lr', short_rows, short_rows // 2)}"
        f" / ({needs.std('_lr', long_rows, long_rows // 2)} + {EPS})"
    )

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        panel = extend(panel, {"_lr": f"ln(try_divide(close, {axis.lag('close')}))"})
        panel = extend(rolling(panel, axis, needs.rolls), {"_trend": trend, "_ratio": ratio})
        label = (
            f"CASE WHEN _ratio > {vol_limit} THEN 'high_vol' WHEN _trend < {-trend_limit} THEN 'trending_down'"
            f" WHEN _trend > {trend_limit} THEN 'trending_up' ELSE 'mean_reverting' END"
        )
        return extend(panel, {"regime": label})

    labelled = in_segments(bars, stage, back=max(trend_rows, long_rows) + 1, keys=keys)
    return labelled.select(*bars.columns, "regime")
