"""DuckDB twins of the registered queries, composed from named CTEs over the same tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from barloom.operators.features import FEATURES
from barloom.operators.selection import TOP_K
from barloom.operators.significance import REPLICATES, SEED, trial_benchmark
from barloom.plans.fixtures import MODELS

E = "1e-9::DOUBLE"
FIELDS = ("open", "high", "low", "close", "volume")
ROOT_YEAR = repr(math.sqrt(252))
PANEL = ("ret_5d", "price_vs_sma_20", "zscore_20", "vol_ratio_10")


def _with(ctes: Sequence[str], final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + final


def _r(columns: dict[str, str] | Sequence[str], digits: int = 6) -> str:
    """Rounded select list from {name: expression} or plain names."""
    pairs = columns.items() if isinstance(columns, dict) else [(c, f'"{c}"') for c in columns]
    return ", ".join(f'round({text}, {8 if name in FIELDS[:4] else digits}) AS "{name}"' for name, text in pairs)


def _bars(ticker: str = "supplier", damped: bool = False) -> str:
    price = "l_extendedprice / l_quantity"
    if damped:
        price = f"100 * pow({price} / 1000, 0.05::DOUBLE)"
    order = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    name, joins = "CAST(l_suppkey AS VARCHAR)", ""
    if ticker == "region":
        name = "r_name"
        joins = (
            " JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
            " JOIN region ON n_regionkey = r_regionkey"
        )
    return f"""trades AS (SELECT {name} AS ticker, CAST(l_shipdate AS DATE) AS date, {price} AS px,
    l_quantity, {order} AS o FROM lineitem{joins}),
bars AS (SELECT ticker, date, min_by(px, o) AS open, max(px) AS high, min(px) AS low,
    max_by(px, o) AS close, sum(l_quantity) AS volume FROM trades GROUP BY ticker, date)"""


def _over(rows: int | None = None, keys: str = "ticker") -> str:
    frame = "" if rows is None else f" ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY {keys} ORDER BY date{frame})"


def _roll(f: str, x: str, rows: int, least: int | None = None, keys: str = "ticker") -> str:
    return f"(CASE WHEN count({x}) {_over(rows, keys)} >= {least or rows} THEN {f}({x}) {_over(rows, keys)} END)"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {_over()}"


SERIES = f"""s0 AS (SELECT *, row_number() {_over()} AS rn, count(*) OVER (PARTITION BY ticker) AS n,
    {_lag('close')} AS pc FROM bars),
s AS (SELECT *, ln(close / pc) AS lr, (high + low + close) / 3 AS tp, close - pc AS dc,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    0.5 * pow(ln(high / (low + {E}) + {E}), 2) - (2 * ln(2::DOUBLE) - 1) * pow(ln(close / (open + {E}) + {E}), 2) AS gk,
    nullif(high - low, 0) AS span, abs(ln(close / pc)) / (volume * close + {E}) AS ill,
    tp * volume AS flow FROM s0)"""


def _feature(columns: dict[str, str], ticker: str = "supplier", extra: Sequence[str] = (), source: str = "s") -> str:
    ctes = [_bars(ticker), SERIES, *extra, f"f AS (SELECT ticker, date, "
            + ", ".join(f'{text} AS "{name}"' for name, text in columns.items()) + f" FROM {source})"]
    return _with(ctes, f"SELECT ticker, date, {_r(list(columns))} FROM f")


def _sma(k: int) -> str:
    return _roll("avg", "close", k, min(max(k // 4, 5), k))


def _std(k: int) -> str:
    return _roll("stddev_samp", "lr", k)


def _plain_features() -> dict[str, dict[str, str]]:
    families: dict[str, dict[str, str]] = {}
    families["feat_returns"] = {
        f"{kind}_{k}d": f"close / {_lag('close', k)} - 1" if kind == "ret" else f"ln(close / ({_lag('close', k)} + {E}))"
        for k in (1, 2, 3, 5, 10, 20) for kind in ("ret", "log_ret")
    }
    families["feat_sma"] = {f"price_vs_sma_{k}": f"close / ({_sma(k)} + {E}) - 1" for k in (5, 10, 20, 50, 100, 200)} | {
        f"sma_cross_{a}_{b}": f"{_sma(a)} / ({_sma(b)} + {E}) - 1" for a, b in ((5, 20), (10, 50), (20, 50), (50, 200))
    }
    bands = {}
    for k in (10, 20):
        mean, std = _roll("avg", "close", k), _roll("stddev_samp", "close", k)
        bands[f"bb_width_{k}"] = f"4 * {std} / ({mean} + {E})"
        bands[f"bb_pos_{k}"] = f"(close - ({mean} - 2 * {std})) / (4 * {std} + {E})"
        bands[f"bb_squeeze_{k}"] = f"{std} / ({mean} + {E})"
    families["feat_bands"] = bands
    families["feat_volatility"] = {f"vol_{k}d": f"{_std(k)} * {ROOT_YEAR}" for k in (5, 10, 20, 60)} | {
        f"hv_ratio_{a}_{b}": f"{_std(a)} / ({_std(b)} + {E})" for a, b in ((5, 20), (10, 60))
    }
    families["feat_gk"] = {
        f"gk_vol_{k}": f"CASE WHEN rn >= {k} THEN sqrt(greatest({_roll('avg', 'gk', k)}, 0) * 252) END" for k in (5, 20)
    }
    top, bottom = _roll("max", "close", 252, 60), _roll("min", "close", 252, 60)
    ranges = {
        "dist_52w_high": f"close / ({top} + {E}) - 1",
        "dist_52w_low": f"close / ({bottom} + {E}) - 1",
        "52w_range_pct": f"(close - {bottom}) / ({top} - {bottom} + {E})",
    }
    for k in (10, 20):
        high, low = _roll("max", "high", k), _roll("min", "low", k)
        ranges[f"don_pos_{k}"] = f"(close - {low}) / ({high} - {low} + {E})"
        ranges[f"don_width_{k}"] = f"({high} - {low}) / (close + {E})"
    families["feat_range"] = ranges
    vwap = f"({_roll('sum', 'flow', 20)} / ({_roll('sum', 'volume', 20)} + {E}))"
    families["feat_volume"] = {
        f"vol_ratio_{k}": f"volume / ({_roll('avg', 'volume', k)} + {E})" for k in (5, 10, 20)
    } | {
        "vol_trend_5": f"volume / {_lag('volume', 5)} - 1",
        "amihud": _roll("avg", "ill", 20),
        "vwap_dev": f"(close - {vwap}) / ({vwap} + {E})",
    }
    families["feat_candle"] = {
        "body": f"(close - open) / (open + {E})",
        "body_pct": f"abs(close - open) / (span + {E})",
        "upper_shadow": f"(high - greatest(open, close)) / (span + {E})",
        "lower_shadow": f"(least(open, close) - low) / (span + {E})",
        "high_low_pct": f"span / (close + {E})",
    }
    shares = [
        f"(avg(CASE WHEN lr {sign} 0 THEN 1.0::DOUBLE ELSE 0.0 END) {_over(20)})" for sign in (">", "<")
    ]
    shares.append(f"(1 - {shares[0]} - {shares[1]})")
    entropy = " + ".join(f"(CASE WHEN {p} > 0 THEN {p} * ln({p} + 1e-12) ELSE 0 END)" for p in shares)
    families["feat_entropy"] = {"ret_entropy_20": f"CASE WHEN rn >= 20 THEN -({entropy}) END"}
    families["feat_zscore"] = {
        f"zscore_{k}": f"(close - {_roll('avg', 'close', k)}) / ({_roll('stddev_samp', 'close', k)} + {E})"
        for k in (20, 60, 120)
    }
    families["feat_regime"] = {
        "regime_trend": f"{_roll('avg', 'lr', 60)} / ({_std(60)} + {E}) * sqrt(60)",
        "regime_vol": f"{_std(20)} / ({_std(120)} + {E})",
        "regime_mr": f"(close - {_roll('avg', 'close', 60)}) / ({_std(60)} * sqrt(60) + {E})",
    }
    return families


def _autocorr(rows: int, lag: int) -> str:
    pairs = rows - lag
    scale = f"(stddev_pop(lr) {_over(pairs)} * stddev_pop(lr{lag}) {_over(pairs)} * {pairs})"
    return (
        f"CASE WHEN rn < {rows} OR n < {rows + lag} THEN NULL WHEN rn > {rows} AND {scale} > 1e-10"
        f" THEN covar_pop(lr{lag}, lr) {_over(pairs)} * {pairs} / ({scale} + 1e-12) ELSE 0 END"
    )


def _ewm_query(columns: dict[str, str], smooth: dict[str, tuple[str, float, int]], second: Sequence[str] = ()) -> str:
    """``smooth`` maps name to (input over s, alpha, first row number with a value)."""
    step = ", ".join(
        f"CASE WHEN i.rn = {at} THEN i.x_{name} ELSE e.{name} * {1 - alpha!r}::DOUBLE + i.x_{name} * {alpha!r}::DOUBLE END"
        for name, (_, alpha, at) in smooth.items()
    )
    inputs = ", ".join(f"({x})::DOUBLE AS x_{name}" for name, (x, _, _) in smooth.items())
    seeds = ", ".join(f"CASE WHEN {at} = 1 THEN x_{name} END" for name, (_, _, at) in smooth.items())
    names = ", ".join(smooth)
    ctes = [
        _bars(), SERIES,
        f"t AS (SELECT *, sum(coalesce(sign(lr) * volume, 0)) {_over()} AS obv,"
        f" avg(volume) {_over()} AS volume_mean FROM s)",
        f"i AS (SELECT ticker, rn, {inputs} FROM t)",
        f"e(ticker, rn, {names}) AS (SELECT ticker, rn, {seeds} FROM i WHERE rn = 1"
        f" UNION ALL SELECT i.ticker, i.rn, {step} FROM e JOIN i ON i.ticker = e.ticker AND i.rn = e.rn + 1)",
        "j AS (SELECT t.*, e.* EXCLUDE (ticker, rn) FROM t JOIN e USING (ticker, rn))",
        *second,
    ]
    source = "k" if second else "j"
    listed = ", ".join(f'{text} AS "{name}"' for name, text in columns.items())
    ctes.append(f"f AS (SELECT ticker, date, {listed} FROM {source})")
    return _with(ctes, f"SELECT ticker, date, {_r(list(columns))} FROM f", recursive=True)


def _ema_queries() -> dict[str, str]:
    def span(k: int) -> float:
        return 2 / (k + 1)

    queries = {}
    emas = {f"e{k}": ("close", span(k), 1) for k in (9, 12, 21, 26)}
    macd = (
        "k0 AS (SELECT *, e12 - e26 AS macd FROM j)",
        f"m(ticker, rn, macd_signal) AS (SELECT ticker, rn, macd FROM k0 WHERE rn = 1 UNION ALL SELECT k0.ticker, k0.rn,"
        f" m.macd_signal * {1 - span(9)!r}::DOUBLE + k0.macd * {span(9)!r}::DOUBLE"
        " FROM m JOIN k0 ON k0.ticker = m.ticker AND k0.rn = m.rn + 1)",
        "k AS (SELECT k0.*, macd_signal FROM k0 JOIN m USING (ticker, rn))",
    )
    columns = {f"price_vs_ema_{k}": f"close / (e{k} + {E}) - 1" for k in (9, 12, 21, 26)} | {
        "macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal",
        "macd_cross": "CAST(macd > macd_signal AS INT)", "macd_norm": f"macd / (close + {E})",
    }
    queries["feat_ema_macd"] = _ewm_query(columns, emas, macd)

    smooth, columns = {}, {}
    for p in (7, 14, 21):
        smooth[f"g{p}"] = ("greatest(dc, 0)", 1 / p, 2)
        smooth[f"l{p}"] = ("greatest(-dc, 0)", 1 / p, 2)
        rsi = f"(100 - 100 / (1 + g{p} / (l{p} + {E})))"
        columns |= {
            f"rsi_{p}": rsi, f"rsi_{p}_dist_50": f"{rsi} - 50", f"rsi_{p}_lag_3": _lag(rsi, 3),
            f"rsi_{p}_momentum": f"{rsi} - {_lag(rsi, 3)}",
        }
    queries["feat_rsi"] = _ewm_query(columns, smooth)

    smooth = {f"a{p}": ("tr", 1 / p, 1) for p in (7, 14, 21)} | {"e21": ("close", span(21), 1)}
    columns = {}
    for p in (7, 14, 21):
        columns |= {f"atr_{p}": f"a{p}", f"atr_{p}_norm": f"a{p} / (close + {E})"}
    columns["keltner_pos"] = f"(close - (e21 - 2 * a14)) / (4 * a14 + {E})"
    queries["feat_atr_keltner"] = _ewm_query(columns, smooth)

    smooth = {f"f{k}": ("dc * volume", span(k), 2) for k in (2, 13)} | {"o20": ("obv", span(20), 1)}
    columns = {"obv_norm": f"(obv - o20) / (abs(o20) + {E})"} | {
        f"force_index_{k}": f"f{k} / (close * volume_mean + {E})" for k in (2, 13)
    }
    queries["feat_obv_force"] = _ewm_query(columns, smooth)

    columns = {"elder_bull": f"(high - e13) / (e13 + {E})", "elder_bear": f"(low - e13) / (e13 + {E})"}
    queries["feat_elder"] = _ewm_query(columns, {"e13": ("close", span(13), 1)})
    return queries


def _raw_bars() -> str:
    """Dirty bars of the cleaning fixture, kept numeric except for the one bad token."""
    return f"""{_bars('region')},
numbered AS (SELECT *, row_number() {_over()} AS rn FROM bars),
raw0 AS (SELECT ticker, date, rn, (rn BETWEEN 200 AND 202 OR rn BETWEEN 400 AND 407) AS lost,
    (rn = 510 AND high > low) AS swap, open, high, low, close, volume FROM numbered),
raw1 AS (SELECT ticker, date, rn,
    CASE WHEN NOT lost THEN CASE WHEN rn = 520 THEN high * 1.1 ELSE open END END AS open,
    CASE WHEN NOT lost THEN CASE WHEN swap THEN low ELSE high END END AS high,
    CASE WHEN NOT lost THEN CASE WHEN rn = 500 THEN -1 WHEN swap THEN high ELSE low END END AS low,
    CASE WHEN NOT lost AND rn <> 580 THEN CASE WHEN rn = 530 THEN low * 0.9 ELSE close END END AS close,
    CASE WHEN rn = 570 THEN 'n/a' WHEN NOT lost AND rn % 97 <> 0 THEN CAST(CASE WHEN rn = 540 THEN -1 WHEN rn = 550 THEN 0
        ELSE volume END AS VARCHAR) END AS vol FROM raw0),
raw AS (SELECT ticker, date, 1 AS seq, open, high, low, CASE WHEN rn = 560 THEN low ELSE close END AS close, vol FROM raw1
    UNION ALL SELECT ticker, date, 2, open, high, low, close, vol FROM raw1 WHERE rn = 560)"""


def _complete() -> str:
    runs = ", ".join(
        f"count({c}) OVER (PARTITION BY ticker ORDER BY date) AS run_{c}" for c in FIELDS
    )
    longs = " OR ".join(
        f"({c} IS NULL AND sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, run_{c}) > 5)"
        for c in FIELDS
    )
    fills = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING"
        f" AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED"
        f" PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in FIELDS
    )
    present = " AND ".join(f"{c} IS NOT NULL" for c in FIELDS)
    return f"""typed AS (SELECT ticker, date, seq, open, high, low, close, try_cast(vol AS DOUBLE) AS volume FROM raw),
latest AS (SELECT * EXCLUDE (seq) FROM typed QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) = 1),
marked AS (SELECT *, {runs} FROM latest),
flagged AS (SELECT *, ({longs}) AS long_gap FROM marked),
filled AS (SELECT ticker, date, {fills} FROM flagged WHERE NOT long_gap),
complete AS (SELECT * FROM filled WHERE {present}),
judged AS (SELECT *, CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price'
    WHEN high < low THEN 'inverted_range' WHEN open NOT BETWEEN low AND high THEN 'open_outside_range'
    WHEN close NOT BETWEEN low AND high THEN 'close_outside_range' WHEN volume < 0 THEN 'negative_volume'
    WHEN volume = 0 THEN 'zero_volume' ELSE 'kept' END AS reason FROM complete)"""


def _quality_queries() -> dict[str, str]:
    region, dirty = _bars("region"), _raw_bars()
    shown = f"ticker, date, {_r(FIELDS)}"
    nulls = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in FIELDS)
    every = " AND ".join(f"{c} IS NULL" for c in FIELDS)
    some = " OR ".join(f"{c} IS NULL" for c in FIELDS)
    return {
        "bars_daily": _with([region], f"SELECT {shown} FROM bars"),
        "bars_supplier": _with([_bars()], f"SELECT {shown} FROM bars"),
        "bars_gap_fill": _with([dirty, _complete()], f"SELECT {shown} FROM complete"),
        "bars_quality": _with(
            [dirty, _complete(), "kept AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS c FROM judged WHERE reason = 'kept')"],
            f"SELECT {shown} FROM kept WHERE c >= 252",
        ),
        "bars_quality_audit": _with(
            [dirty, _complete()],
            "SELECT ticker, CASE WHEN reason = 'kept' AND count(*) < 252 THEN 'short_history' ELSE reason END AS reason,"
            " count(*) AS n FROM judged GROUP BY ticker, judged.reason",
        ),
        "bars_run_audit": _with(
            [
                dirty, _complete(),
                f"ok AS (SELECT *, coalesce(abs(close / nullif({_lag('close')}, 0) - 1) > 0.4, false) AS jump FROM judged WHERE reason = 'kept')",
                "a AS (SELECT ticker, count(*) AS raw_rows FROM raw GROUP BY ticker)",
                "b AS (SELECT ticker, count(*) AS uniq, count(*) FILTER (WHERE long_gap) AS long_gap FROM flagged GROUP BY ticker)",
                "c AS (SELECT ticker, count(*) AS whole, count(*) FILTER (WHERE reason = 'kept') AS clean FROM judged GROUP BY ticker)",
                "d AS (SELECT ticker, count(*) FILTER (WHERE jump) AS jumps FROM ok GROUP BY ticker)",
            ],
            "SELECT ticker, raw_rows, raw_rows - uniq AS duplicates, long_gap, uniq - long_gap - coalesce(whole, 0) AS unfilled,"
            " coalesce(whole, 0) - coalesce(clean, 0) AS inconsistent, coalesce(clean, 0) AS clean,"
            " CASE WHEN coalesce(clean, 0) < 252 THEN 0 ELSE clean END AS kept, coalesce(jumps, 0) AS jumps"
            " FROM a JOIN b USING (ticker) LEFT JOIN c USING (ticker) LEFT JOIN d USING (ticker)",
        ),
        "bars_null_audit": _with(
            [dirty, "typed AS (SELECT * EXCLUDE (vol), try_cast(vol AS DOUBLE) AS volume FROM raw)"],
            f"SELECT ticker, {nulls}, count(*) FILTER (WHERE {every}) AS rows_all_null,"
            f" count(*) FILTER (WHERE ({some}) AND NOT ({every})) AS rows_some_null FROM typed GROUP BY ticker",
        ),
        "bars_bad_tokens": _with(
            [dirty],
            "SELECT ticker, 0::BIGINT AS open, 0::BIGINT AS high, 0::BIGINT AS low, 0::BIGINT AS close,"
            " count(*) FILTER (WHERE vol IS NOT NULL AND try_cast(vol AS DOUBLE) IS NULL) AS volume FROM raw GROUP BY ticker",
        ),
        "bars_jumps": _with(
            [region, f"j AS (SELECT ticker, date, abs(close / {_lag('close')} - 1) > 0.4 AS jump FROM bars)"],
            "SELECT ticker, count(*) AS jumps, array_to_string(list_slice(list(CAST(date AS VARCHAR) ORDER BY date), 1, 5), ',')"
            " AS first_dates FROM j WHERE jump GROUP BY ticker",
        ),
        "align_inner": _with(
            [region],
            f"SELECT {shown} FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date"
            " HAVING count(*) = (SELECT count(DISTINCT ticker) FROM bars))",
        ),
        "align_outer": _with(
            [
                region,
                "grid AS (SELECT d.date, t.ticker FROM (SELECT DISTINCT date FROM bars) d, (SELECT DISTINCT ticker FROM bars) t)",
                "wide AS (SELECT grid.ticker, grid.date, open, high, low, close, volume FROM grid LEFT JOIN bars"
                " ON grid.ticker = bars.ticker AND grid.date = bars.date)",
                "filled AS (SELECT ticker, date, close IS NULL AS filled, "
                + ", ".join(f"last_value({c} IGNORE NULLS) {_over(6)} AS {c}" for c in FIELDS)
                + " FROM wide)",
            ],
            f"SELECT {shown}, filled FROM filled WHERE close IS NOT NULL",
        ),
    }


def _targets_queries() -> dict[str, str]:
    hs = (1, 5, 21)
    forward = "f0 AS (SELECT *, " + ", ".join(
        f"ln(lead(close, {h}) {_over()} / nullif(close, 0)) AS f{h}, lead(close, {h}) {_over()} AS c{h}" for h in hs
    ) + " FROM bars)"
    exc = "f1 AS (SELECT *, " + ", ".join(
        f"CASE WHEN count(f{h}) {_over(60)} >= 30 THEN f{h} - quantile_cont(f{h}, 0.5) {_over(60)} END AS x{h}" for h in hs
    ) + " FROM f0)"
    ranks = "f1 AS (SELECT *, " + ", ".join(
        f"CASE WHEN f{h} IS NOT NULL THEN list_filter(list(f{h}) {_over(60)}, lambda v: v IS NOT NULL) END AS w{h}" for h in hs
    ) + " FROM f0), f2 AS (SELECT *, " + ", ".join(
        f"CASE WHEN len(w{h}) >= 30 THEN (len(list_filter(w{h}, lambda v: v < f{h})) + (len(list_filter(w{h}, lambda v: v = f{h})) + 1)"
        f" / 2.0::DOUBLE) / len(w{h}) END AS r{h}" for h in hs
    ) + " FROM f1)"
    return {
        "targets_binary": _with([_bars(), forward], "SELECT ticker, date, " + ", ".join(
            f"CAST(c{h} > close AS DOUBLE) AS target_{h}d" for h in hs) + " FROM f0"),
        "targets_return": _with([_bars(), forward], "SELECT ticker, date, "
                                + _r({f"target_ret_{h}d": f"f{h}" for h in hs}) + " FROM f0"),
        "targets_excess": _with([_bars(), forward, exc], "SELECT ticker, date, " + ", ".join(
            f"CAST(x{h} > 0 AS DOUBLE) AS target_exc_bin_{h}d" for h in hs) + ", "
            + _r({f"target_exc_{h}d": f"x{h}" for h in hs}) + " FROM f1"),
        "targets_rank": _with([_bars(), forward, ranks], "SELECT ticker, date, " + ", ".join(
            f"CAST(r{h} > 0.5 AS DOUBLE) AS target_rank_bin_{h}d" for h in hs) + ", "
            + _r({f"target_rank_{h}d": f"r{h}" for h in hs}) + " FROM f2"),
    }


def _split_label(position: str, size: str, train: str = "0.7::DOUBLE", both: str = "0.85::DOUBLE") -> str:
    return (
        f"CASE WHEN {position} < CAST(floor({size} * {train}) AS BIGINT) THEN 'train'"
        f" WHEN {position} < CAST(floor({size} * {both}) AS BIGINT) THEN 'val' ELSE 'test' END"
    )


PANEL_CTES = [
    _bars(), SERIES,
    f"""feats AS (SELECT ticker, date, close / {_lag('close', 5)} - 1 AS ret_5d,
    close / ({_sma(20)} + {E}) - 1 AS price_vs_sma_20,
    (close - {_roll('avg', 'close', 20)}) / ({_roll('stddev_samp', 'close', 20)} + {E}) AS zscore_20,
    volume / ({_roll('avg', 'volume', 10)} + {E}) AS vol_ratio_10,
    CAST(lead(close) {_over()} > close AS DOUBLE) AS target_1d FROM s)""",
]
NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in PANEL)
LABELLED = [
    *PANEL_CTES,
    f"clean AS (SELECT * FROM feats WHERE {NOT_NULL} AND target_1d IS NOT NULL)",
    "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day, count(*) OVER () AS days"
    " FROM (SELECT DISTINCT date FROM clean))",
    f"panel AS (SELECT clean.*, {_split_label('day', 'days')} AS split FROM clean JOIN days USING (date))",
]
INNER_FOLD = (
    "CASE WHEN n < 2 * greatest(n // 6, 100) THEN fold = 0 ELSE pos < least(greatest(n // 6, 100) + (fold + 1) * (n // 6), n) END"
)
INNER = [
    *LABELLED,
    "tr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,"
    " count(*) OVER (PARTITION BY ticker) AS n FROM panel WHERE split = 'train')",
    f"folded AS (SELECT tr.*, fold FROM tr, range(5) r(fold) WHERE {INNER_FOLD})",
    "long AS (UNPIVOT (SELECT fold, target_1d, " + ", ".join(PANEL) + " FROM folded) ON " + ", ".join(PANEL)
    + " INTO NAME feature VALUE value)",
    "binned AS (SELECT fold, feature, target_1d AS y, count(*) OVER (PARTITION BY fold, feature) AS n,"
    " CAST(floor((rank() OVER (PARTITION BY fold, feature ORDER BY value) - 1) * 10"
    " / (count(*) OVER (PARTITION BY fold, feature))) AS INT) AS bin FROM long)",
    "cells AS (SELECT fold, feature, bin, y, count(*)::DOUBLE AS c, max(n) AS n FROM binned GROUP BY fold, feature, bin, y)",
    "mi AS (SELECT fold, feature, sum(c / n * ln(c * n / (rb * ry))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY fold,"
    " feature, bin) AS rb, sum(c) OVER (PARTITION BY fold, feature, y) AS ry FROM cells) GROUP BY fold, feature)",
]


def _panel_queries() -> dict[str, str]:
    queries = {}
    queries["split_position"] = _with(
        [_bars("region"), f"s AS (SELECT *, row_number() {_over()} - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars)",
         "v AS (SELECT *, (floor(n * 0.15::DOUBLE) < 300 OR floor(n * 0.15000000000000002::DOUBLE) < 300) AS short FROM s)",
         "e AS (SELECT *, floor(n * 0.7::DOUBLE) AS a, CASE WHEN short THEN floor(n * (0.7::DOUBLE"
         " + least(greatest((n - CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) // 2, 300) / n::DOUBLE, 0.15::DOUBLE)))"
         " ELSE floor(n * 0.85::DOUBLE) END AS b FROM v)"],
        "SELECT ticker, date, CASE WHEN pos < a THEN 'train' WHEN pos < b THEN 'val' ELSE 'test' END AS split FROM e",
    )
    queries["split_calendar"] = _with(
        [_bars(), "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day, count(*) OVER () AS days"
         " FROM (SELECT DISTINCT date FROM bars))"],
        f"SELECT ticker, date, {_split_label('day', 'days')} AS split FROM bars JOIN days USING (date)",
    )
    folds = [
        _bars(),
        "lens AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker)",
        "widths AS (SELECT *, greatest((n - 351) // 8, 20) AS w FROM lens)",
        "folds AS (SELECT ticker, k + 1 AS fold, 300 + k * w AS train_end, 351 + k * w AS test_start,"
        " 351 + (k + 1) * w AS test_end, 51 AS gap, true AS is_clean FROM widths, range(8) r(k) WHERE 351 + (k + 1) * w <= n)",
    ]
    queries["folds"] = _with(folds, "SELECT * FROM folds")
    queries["fold_members"] = _with(
        [*folds, f"p AS (SELECT ticker, date, row_number() {_over()} - 1 AS pos FROM bars)",
         "m AS (SELECT p.ticker, fold, date, CASE WHEN pos < train_end THEN 'train' WHEN pos < test_start THEN 'purge'"
         " ELSE 'test' END AS role FROM p JOIN folds ON p.ticker = folds.ticker AND pos < test_end)"],
        "SELECT ticker, fold, role, count(*) AS n, min(date) AS first, max(date) AS last FROM m GROUP BY ticker, fold, role",
    )
    queries["inner_folds"] = _with(
        [_bars(), f"p AS (SELECT ticker, date, row_number() {_over()} - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars)"],
        "SELECT ticker, fold, count(*) AS n, max(date) AS last FROM p, range(5) r(fold)"
        f" WHERE {INNER_FOLD} GROUP BY ticker, fold",
    )
    queries["class_weights"] = _with(
        LABELLED,
        "SELECT split, round(count(*) / (2.0::DOUBLE * count(*) FILTER (WHERE target_1d <> 1)), 6) AS weight_0,"
        " round(count(*) / (2.0::DOUBLE * count(*) FILTER (WHERE target_1d = 1)), 6) AS weight_1,"
        " round(count(*) FILTER (WHERE target_1d <> 1) / (count(*) FILTER (WHERE target_1d = 1))::DOUBLE, 6) AS pos_weight"
        " FROM panel GROUP BY split",
    )
    queries["class_balance"] = _with(
        LABELLED, "SELECT split, round(avg(target_1d) * 100, 6) AS up_pct, abs(avg(target_1d) * 100 - 50) > 5 AS imbalanced"
        " FROM panel GROUP BY split",
    )
    whole = [*PANEL_CTES, f"c AS (SELECT ticker, date, {', '.join(PANEL)} FROM feats)"]
    complete = [*PANEL_CTES, f"c AS (SELECT ticker, date, {', '.join(PANEL)} FROM feats WHERE {NOT_NULL})"]
    day = "OVER (PARTITION BY date)"
    queries["cs_zscore"] = _with(whole, "SELECT ticker, date, " + _r({
        c: f"CASE WHEN count(*) {day} < 3 THEN {c} ELSE ({c} - avg({c}) {day}) / (stddev_pop({c}) {day} + 1e-8) END" for c in PANEL
    }) + " FROM c")
    queries["cs_rank"] = _with(whole, "SELECT ticker, date, " + _r({
        c: f"CASE WHEN count(*) {day} < 3 THEN {c} WHEN {c} IS NULL OR count({c}) {day} < 2 THEN 0.5"
        f" ELSE (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE) / count({c}) {day} END" for c in PANEL
    }) + " FROM c")
    fit = "fit AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}" for c in PANEL
    ) + " FROM panel WHERE split = 'train')"
    queries["robust_scale"] = _with([*LABELLED, fit], "SELECT ticker, date, split, " + _r({
        c: f"CAST(CAST(({c} - m_{c}) / CASE WHEN i_{c} = 0 THEN 1 ELSE i_{c} END AS FLOAT) AS DOUBLE)" for c in PANEL
    }, 3) + " FROM panel, fit")
    before = "OVER (PARTITION BY ticker, split ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
    queries["sequences"] = _with(
        [*LABELLED, f"q AS (SELECT ticker, date, target_1d AS label, count(*) {before} AS length, "
         + ", ".join(f"list({c}) {before} AS l_{c}" for c in PANEL) + " FROM panel)"],
        "SELECT ticker, date, label, length, " + ", ".join(
            f"round(l_{c}[1], 6) AS oldest_{c}, round(l_{c}[50], 6) AS newest_{c},"
            f" round(list_sum(list_transform(l_{c}, lambda x, k: k * x)), 5) AS placed_{c}" for c in PANEL
        ) + " FROM q WHERE length = 50",
    )
    queries["last_sequence"] = _with(
        [*complete, "q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM c)"],
        "SELECT ticker, max(date) AS date, count(*) AS length, round(max(ret_5d) FILTER (WHERE back = 50), 6) AS oldest,"
        " round(max(ret_5d) FILTER (WHERE back = 1), 6) AS newest FROM q WHERE back <= 50 GROUP BY ticker HAVING count(*) = 50",
    )
    queries["mi_top"] = _with(
        INNER, "SELECT feature, round(avg(mi), 6) AS mi FROM mi GROUP BY feature ORDER BY avg(mi.mi) DESC, feature LIMIT 3"
    )
    queries["short_tickers"] = _with(complete, "SELECT ticker, count(*) AS rows FROM c GROUP BY ticker HAVING count(*) < 1500")
    queries["early_stop"] = _with(
        [_bars(), f"p AS (SELECT ticker, date, row_number() {_over()} - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars)"],
        "SELECT ticker, pos >= n - CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS is_validation, count(*) AS n, min(date) AS first"
        " FROM p GROUP BY ALL",
    )
    both = [f"wide AS ({_with([_bars('region')], 'SELECT ticker, date, open, high, low, close FROM bars')})",
            f"own AS ({_with([_bars()], 'SELECT ticker, date, open, high, low, close FROM bars')})"]
    queries["frames_stacked"] = _with(both, f"SELECT ticker, date, {_r(FIELDS[:4])} FROM (FROM wide UNION ALL FROM own)")
    queries["dates_shared"] = _with(both, "SELECT date FROM wide INTERSECT SELECT date FROM own")
    queries["dates_any"] = _with(both, "SELECT date FROM wide UNION SELECT date FROM own")
    queries["mi_scores"] = _with(INNER, "SELECT fold, feature, round(mi, 6) AS mi FROM mi")
    means = "SELECT feature, round(avg(abs(w * (value - m))), 6) AS importance FROM (SELECT feature, value, avg(value) OVER" \
        " (PARTITION BY feature) AS m, CASE feature WHEN 'ret_5d' THEN 0.5 WHEN 'price_vs_sma_20' THEN -0.25" \
        " WHEN 'zscore_20' THEN 0.125 ELSE 1.0 END AS w FROM melted) GROUP BY feature"
    queries["linear_attribution"] = _with(
        [*PANEL_CTES, "melted AS (UNPIVOT (SELECT " + ", ".join(PANEL) + " FROM feats) ON " + ", ".join(PANEL)
         + " INTO NAME feature VALUE value)"], means)
    return queries


def _unrounded(query: str) -> str:
    """A feature query up to its last projection, which rounds."""
    return query[: query.rindex("SELECT ticker, date, ")] + "SELECT * FROM f"


def _select_top(found: dict[str, str]) -> str:
    """All indicators, each scored on the bars that have it; ``found`` are the feature queries, families without a query of suppliers are built here."""
    parts = {
        name: _unrounded(found[name]) for name in ("feat_ema_macd", "feat_rsi", "feat_atr_keltner", "feat_obv_force", "feat_elder",
                                                   "feat_autocorr", "feat_oscillators", "feat_roc_acceleration")
    }
    parts |= {name: _unrounded(_feature(columns)) for name, columns in _plain_features().items()}
    ranks = found["feat_vol_rank"]
    parts["feat_vol_rank"] = ranks[: ranks.rindex("SELECT ticker, date, ")] + "SELECT ticker, date, " + ", ".join(
        f"r{k} AS vol_{k}d_rank" for k in (5, 10, 20, 60)
    ) + " FROM c"
    names = [f'"{c}"' for c in FEATURES]
    last = len(FEATURES) - 1
    return _with(
        [
            _bars(), *[f"{name} AS ({text})" for name, text in parts.items()],
            f"labels AS (SELECT ticker, date, CAST(lead(close) {_over()} > close AS DOUBLE) AS target_1d FROM bars)",
            "clean AS (SELECT * FROM labels " + " ".join(f"JOIN {name} USING (ticker, date)" for name in parts) + " WHERE target_1d IS NOT NULL)",
            "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day, count(*) OVER () AS days"
            " FROM (SELECT DISTINCT date FROM clean))",
            f"panel AS (SELECT clean.*, {_split_label('day', 'days')} AS split FROM clean JOIN days USING (date))",
            INNER[len(LABELLED)], INNER[len(LABELLED) + 1],
            "long AS (SELECT * FROM (UNPIVOT (SELECT fold, target_1d, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in names) + " FROM folded) ON "
            + ", ".join(names) + " INTO NAME feature VALUE value) WHERE isfinite(value))",
            *INNER[len(LABELLED) + 3 :],
            "tree AS (SELECT fold, feature, CASE WHEN min(value) < max(value) AND min(target_1d) < max(target_1d)"
            " THEN abs(corr(value, target_1d)) END AS tree FROM long GROUP BY fold, feature)",
            "grid AS (SELECT fold, feature, ordinal FROM (SELECT DISTINCT fold FROM folded), (SELECT unnest(["
            + ", ".join(f"'{c}'" for c in FEATURES) + f"]) AS feature, unnest(range({len(FEATURES)})) AS ordinal))",
            "whole AS (SELECT fold, feature, ordinal, "
            + ", ".join(f"coalesce({c}, CASE WHEN count({c}) OVER (PARTITION BY fold) > 0 THEN 0 ELSE 1 END) AS {c}" for c in ("mi", "tree"))
            + " FROM grid LEFT JOIN mi USING (fold, feature) LEFT JOIN tree USING (fold, feature))",
            "pair AS (SELECT feature, ordinal, round(avg(mi), 9) AS mi, round(avg(tree), 9) AS tree FROM whole GROUP BY feature, ordinal)",
            f"ranked AS (SELECT *, 0.4 * ((row_number() OVER (ORDER BY mi, ordinal) - 1) / {last}.0::DOUBLE)"
            f" + 0.6 * ((row_number() OVER (ORDER BY tree, ordinal) - 1) / {last}.0::DOUBLE) AS combined FROM pair)",
        ],
        f"SELECT ordinal, feature, round(combined, 6) AS combined FROM ranked ORDER BY ranked.combined DESC, ordinal DESC LIMIT {TOP_K}",
    )


#: Families whose twins are plain window expressions, in the order of the columns of the panel queries.
PANEL_FAMILIES = ("feat_returns", "feat_sma", "feat_bands", "feat_volatility", "feat_zscore", "feat_regime")


def panel_columns() -> list[str]:
    plain = _plain_features()
    return [c for name in PANEL_FAMILIES for c in plain[name]]


def _built_panel(isolated: bool) -> str:
    """Features and the next-day label per ticker, or per ticker and split; z-scores per date."""
    plain = {c: text for name in PANEL_FAMILIES for c, text in _plain_features()[name].items()}
    columns = list(plain)
    ctes = [_bars("region").replace("bars AS (", "daily AS (")]
    days = "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day, count(*) OVER () AS days FROM (SELECT DISTINCT date FROM {source}))"
    if isolated:
        ctes += [days.format(source="daily"), f"""bars AS (SELECT * REPLACE (ticker || '/' || {_split_label('day', 'days')} AS ticker)
    FROM daily JOIN days USING (date))"""]
    else:
        ctes.append("bars AS (SELECT * FROM daily)")
    whole = " AND ".join(f'"{c}" IS NOT NULL AND isfinite("{c}")' for c in columns)
    ctes += [
        SERIES,
        "f AS (SELECT ticker, date, " + ", ".join(f'{text} AS "{c}"' for c, text in plain.items())
        + f", CAST(lead(close) {_over()} > close AS DOUBLE) AS target_1d FROM s)",
        f"clean AS (SELECT * FROM f WHERE {whole} AND target_1d IS NOT NULL)",
    ]
    if isolated:
        ctes.append("panel AS (SELECT * REPLACE (split_part(ticker, '/', 1) AS ticker), split_part(ticker, '/', 2) AS split FROM clean)")
    else:
        ctes += [days.format(source="clean"), f"panel AS (SELECT clean.*, {_split_label('day', 'days')} AS split FROM clean JOIN days USING (date))"]
    day = "OVER (PARTITION BY date)"
    scaled = {
        c: f'CASE WHEN count(*) {day} < 3 THEN "{c}" ELSE ("{c}" - avg("{c}") {day}) / (stddev_pop("{c}") {day} + 1e-8) END' for c in columns
    }
    return _with(ctes, f"SELECT ticker, date, split, {_r(scaled, 5)}, target_1d FROM panel")


#: Columns without two that order the bars alike, so that no two splits of a tree part them alike.
STUMP_COLUMNS = (
    "ret_1d", "ret_5d", "ret_20d", "price_vs_sma_10", "price_vs_sma_50", "sma_cross_5_20", "sma_cross_20_50", "bb_width_20",
    "bb_pos_10", "vol_5d", "vol_20d", "vol_60d", "hv_ratio_5_20", "hv_ratio_10_60", "zscore_60", "zscore_120", "regime_trend", "regime_vol",
    "regime_mr", "ret_10d",
)


def _stumps() -> str:
    """One split per ticker and fold, the best of all features and thresholds, by running sums of gradients."""
    plain = {c: text for name in PANEL_FAMILIES for c, text in _plain_features()[name].items() if c in STUMP_COLUMNS}
    whole = " AND ".join(f'"{c}" IS NOT NULL AND isfinite("{c}")' for c in STUMP_COLUMNS)
    ordinal = "list_position([" + ", ".join(f"'{c}'" for c in STUMP_COLUMNS) + "], feature)"
    soft = "(sign({g}) * greatest(abs({g}) - 0.15, 0))"
    value = f"(pow({soft}, 2) / ({{h}} + 1.5))"
    gain = f"{value.format(g='g', h='h')} + {value.format(g='(gt - g)', h='(ht - h)')} - {value.format(g='gt', h='ht')}"
    leaf = f"(-0.02 * {soft} / ({{h}} + 1.5))"
    return _with([
        _bars("region"), SERIES,
        "f AS (SELECT ticker, date, " + ", ".join(f'{text} AS "{c}"' for c, text in plain.items())
        + f", CAST(lead(close) {_over()} > close AS DOUBLE) AS y FROM s)",
        f"clean AS (SELECT *, row_number() {_over()} - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM f WHERE {whole} AND y IS NOT NULL)",
        "widths AS (SELECT ticker, n, greatest((n - 351) // 8, 20) AS w FROM clean GROUP BY ticker, n)",
        "folds AS (SELECT ticker, k + 1 AS fold, 300 + k * w AS train_end, 351 + k * w AS a, 351 + (k + 1) * w AS b"
        " FROM widths, range(8) r(k) WHERE 351 + (k + 1) * w <= n)",
        "tr AS (SELECT fold, clean.* FROM clean JOIN folds ON clean.ticker = folds.ticker AND pos < train_end)",
        "pw AS (SELECT ticker, fold, CASE WHEN sum(y) > 0 THEN (count(*) - sum(y)) / sum(y) ELSE 1 END AS pw FROM tr GROUP BY ticker, fold)",
        "gr AS (SELECT tr.*, CASE WHEN y = 1 THEN pw ELSE 1 END AS w FROM tr JOIN pw USING (ticker, fold))",
        "lg AS (UNPIVOT (SELECT ticker, fold, w * (0.5 - y) AS g, w * 0.25 AS h, " + ", ".join(f'"{c}"' for c in STUMP_COLUMNS)
        + " FROM gr) ON " + ", ".join(f'"{c}"' for c in STUMP_COLUMNS) + " INTO NAME feature VALUE x)",
        "vs AS (SELECT ticker, fold, feature, x, sum(g) AS g, sum(h) AS h FROM lg GROUP BY ticker, fold, feature, x)",
        "cs AS (SELECT ticker, fold, feature, x, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(g) OVER k AS gt, sum(h) OVER k AS ht FROM vs"
        " WINDOW w AS (PARTITION BY ticker, fold, feature ORDER BY x), k AS (PARTITION BY ticker, fold, feature))",
        f"sp AS (SELECT *, {gain} AS gain FROM cs WHERE h >= 5 AND ht - h >= 5)",
        f"best AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY ticker, fold ORDER BY round(gain, 9) DESC, {ordinal}, x) = 1)",
        "whole AS (SELECT ticker, fold, sum(w * (0.5 - y)) AS gt, sum(w * 0.25) AS ht FROM gr GROUP BY ticker, fold)",
        "te AS (SELECT fold, clean.* FROM clean JOIN folds ON clean.ticker = folds.ticker AND pos >= a AND pos < b)",
        "tl AS (SELECT te.ticker, te.fold, te.date, CASE feature " + " ".join(f"WHEN '{c}' THEN \"{c}\"" for c in STUMP_COLUMNS)
        + " END AS v, b.x, b.g, b.h, b.gt, b.ht, b.gain, o.gt AS go, o.ht AS ho FROM te JOIN whole o USING (ticker, fold)"
        " LEFT JOIN best b ON te.ticker = b.ticker AND te.fold = b.fold)",
        f"z AS (SELECT *, CASE WHEN gain > 0.2 THEN CASE WHEN v <= x THEN {leaf.format(g='g', h='h')} ELSE {leaf.format(g='(gt - g)', h='(ht - h)')}"
        f" END ELSE {leaf.format(g='go', h='ho')} END AS z FROM tl)",
    ], "SELECT ticker, fold, date, round(1 / (1 + exp(-z)), 6) AS p FROM z")


def _panel_build_queries() -> dict[str, str]:
    return {"panel_shared": _built_panel(False), "panel_isolated": _built_panel(True), "boosted_stumps": _stumps()}


def _regime_cte() -> str:
    trend = (
        f"{_roll('avg', 'lr', 60, 30)} / ({_roll('stddev_samp', 'lr', 60, 30)} + {E}) * {ROOT_YEAR}"
    )
    ratio = f"{_roll('stddev_samp', 'lr', 20, 10)} / ({_roll('stddev_samp', 'lr', 120, 60)} + {E})"
    return f"""reg0 AS (SELECT ticker, date, {trend} AS trend, {ratio} AS ratio FROM s),
regimes AS (SELECT ticker, date, CASE WHEN ratio > 1.3 THEN 'high_vol' WHEN trend < -0.5 THEN 'trending_down'
    WHEN trend > 0.5 THEN 'trending_up' ELSE 'mean_reverting' END AS regime FROM reg0)"""


def _scores(ticker: str = "supplier") -> str:
    fast, slow = _roll("avg", "close", 5), _roll("avg", "close", 20)
    low, high = _roll("min", "low", 14), _roll("max", "high", 14)
    z = f"(close - {slow}) / ({_roll('stddev_samp', 'close', 20)} + {E})"
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS model, ticker, date, {m} AS p, y, pos, n FROM ruled" for m in MODELS
    )
    return f"""{_bars(ticker, damped=True)},
rules AS (SELECT ticker, date, row_number() {_over()} - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS nn,
    coalesce(CAST({fast} > {slow} AS DOUBLE), 0) AS ma_5_20, 1 - (close - {low}) / ({high} - {low} + {E}) AS mean_rev_14,
    1 / (1 + exp(-({z}))) AS momentum_20, CAST(lead(close) {_over()} > close AS INT) AS y FROM bars),
ruled AS (SELECT *, CASE WHEN rn % 10 <> 0 THEN momentum_20 END AS momentum_null, rn - 19 AS pos, nn - 20 AS n
    FROM rules WHERE rn >= 19 AND y IS NOT NULL),
scores AS ({rows})"""


MID = "(rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0::DOUBLE)"


def _auc(source: str, keys: str, name: str = "aucs") -> str:
    return (
        f"{name}_r AS (SELECT {keys}, y, {MID.format(k=keys, x='coalesce(p, 0.5)')} AS rk FROM {source}),"
        f"{name} AS (SELECT {keys}, coalesce((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1)"
        f" * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE y = 1)"
        f" * count(*) FILTER (WHERE y = 0), 0), 0.5) AS auc FROM {name}_r GROUP BY {keys})"
    )


PREDICTED = "pr AS (SELECT *, coalesce(p, 0.5) AS prob, CAST(coalesce(p, 0.5) >= 0.5 AS INT) AS pred FROM scores)"


def _classification_queries() -> dict[str, str]:
    sc = _scores()
    queries = {
        "clf_metrics": _with(
            [sc, PREDICTED, "c AS (SELECT model, count(*) AS n, avg(CAST(pred = y AS DOUBLE)) AS accuracy, count(*) FILTER"
             " (WHERE pred = 1 AND y = 1) AS tp, count(*) FILTER (WHERE pred = 0 AND y = 0) AS tn,"
             " count(*) FILTER (WHERE pred <> y) AS bad, avg(pow(prob - y, 2)) AS brier FROM pr GROUP BY model)"],
            "SELECT model, n, round(accuracy, 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + bad), 6) AS f1_up,"
            " round(2.0::DOUBLE * tn / (2 * tn + bad), 6) AS f1_down, round(brier, 6) AS brier FROM c",
        ),
        "confusion": _with([sc, PREDICTED], "SELECT model, y, pred, count(*) AS n FROM pr GROUP BY model, y, pred"),
        "class_report": _with(
            [sc, PREDICTED, "c AS (SELECT model, class, count(*) FILTER (WHERE pred = class AND y = class) AS hit,"
             " count(*) FILTER (WHERE pred = class) AS said, count(*) FILTER (WHERE y = class) AS support"
             " FROM pr, (VALUES (0), (1)) v(class) GROUP BY model, class)"],
            "SELECT model, class, round(hit / said::DOUBLE, 6) AS precision, round(hit / support::DOUBLE, 6) AS recall,"
            " support FROM c",
        ),
        "auc": _with([sc, _auc("scores", "model, ticker")], "SELECT model, ticker, round(auc, 6) AS auc FROM aucs"),
        "confidence_labels": _with(
            [sc],
            "SELECT model, ticker, date, round(p, 6) AS p, y, CASE WHEN p >= 0.5 THEN 'UP' WHEN p < 0.5 THEN 'DOWN' END AS direction,"
            " CASE WHEN abs(p - 0.5) > 0.2 THEN 'STRONG' WHEN abs(p - 0.5) > 0.1 THEN 'MODERATE' WHEN p IS NOT NULL THEN 'WEAK' END"
            " AS strength, 'TOMORROW' AS horizon FROM scores",
        ),
        "calibration": _with(
            [sc],
            "SELECT model, least(CAST(floor(p * 10) AS INT), 9) AS bin, round(avg(p), 6) AS mean_p,"
            " round(avg(y), 6) AS positive_share, count(*) AS n FROM scores WHERE p IS NOT NULL GROUP BY 1, 2",
        ),
        "regime_accuracy": _with(
            [sc, SERIES, _regime_cte(), PREDICTED],
            "SELECT model, regime, count(*) AS n, round(avg(CAST(pred = y AS DOUBLE)), 6) AS accuracy, round(avg(y) * 100, 6)"
            " AS up_pct FROM pr JOIN regimes USING (ticker, date) GROUP BY model, regime HAVING count(*) >= 10",
        ),
        "roc_points": _with(
            [_scores("region"), "d AS (SELECT model, ticker, coalesce(p, 0.5) AS p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scores"
             " GROUP BY model, ticker, coalesce(p, 0.5))",
             "c AS (SELECT model, ticker, p, sum(pos) OVER (w ORDER BY p DESC) / (sum(pos) OVER w)::DOUBLE AS tpr,"
             " sum(neg) OVER (w ORDER BY p DESC) / (sum(neg) OVER w)::DOUBLE AS fpr FROM d WINDOW w AS (PARTITION BY model, ticker))"],
            "SELECT model, ticker, round(p, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM c",
        ),
    }
    for name, value, figures in (
        ("deciles", "abs(p - 0.5)", "round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS DOUBLE)), 6) AS hit_rate"),
        ("up_deciles", "p", "round(avg(y), 6) AS up_rate, round(avg(p), 6) AS mean_p"),
    ):
        edges = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11))
        queries[name] = _with(
            [sc, f"x AS (SELECT *, {value} AS v FROM scores WHERE p IS NOT NULL)",
             f"edges AS (SELECT model, list_distinct([{edges}]) AS e FROM x GROUP BY model)",
             "b AS (SELECT x.*, greatest(len(list_filter(e, lambda q: q < v)) - 1, 0) AS decile FROM x JOIN edges USING (model))"],
            f"SELECT model, decile, {figures}, count(*) AS n FROM b GROUP BY model, decile",
        )
    return queries


def _sliced(part: str) -> str:
    return (
        "sliced AS (SELECT *, CASE WHEN pos < greatest(n // 2, 32) THEN 'stack' ELSE 'eval' END AS slice FROM scores),"
        f"part AS (SELECT * FROM sliced WHERE slice = '{part}')"
    )


def _weights() -> str:
    names = ", ".join(f"'{m}'" for m in MODELS)
    return f"""three AS (SELECT * FROM part WHERE model IN ({names})), {_auc('three', 'model')},
pairs AS (SELECT a.model, b.model AS rival, corr(a.p, b.p) AS c FROM three a JOIN three b ON a.ticker = b.ticker
    AND a.date = b.date AND a.model <> b.model GROUP BY a.model, b.model),
fines AS (SELECT x.model, sum(greatest(c - 0.5, 0)) * 0.1 AS fine FROM pairs JOIN aucs x ON x.model = pairs.model
    JOIN aucs z ON z.model = pairs.rival WHERE z.auc > x.auc GROUP BY x.model),
adj AS (SELECT aucs.model, auc, auc - coalesce(fine, 0) AS adjusted FROM aucs LEFT JOIN fines ON aucs.model = fines.model),
ex AS (SELECT *, exp(4.0 * (adjusted - (SELECT avg(adjusted) FROM adj))) AS raised FROM adj),
weights AS (SELECT model, auc, adjusted, raised / (SELECT sum(raised) FROM ex) AS weight FROM ex)"""


THIRDS = "sliced AS (SELECT *, CASE WHEN pos < n // 3 THEN 'fit' WHEN pos < 2 * n // 3 THEN 'weigh' ELSE 'predict' END AS slice FROM scores)"


def _part(name: str, slice_: str) -> str:
    return f"{name} AS (SELECT * FROM sliced WHERE slice = '{slice_}')"


def _newton(source: str, columns: Sequence[str], key: str, c: float, steps: int = 12) -> list[str]:
    """CTEs of Newton steps of a logistic fit per ``key``; ``fitted`` holds b0 (intercept), b1, ... The equations of each step
    are solved by elimination, one column a CTE."""
    x = ["1.0::DOUBLE", *columns]
    d = len(x)
    names = [f"b{i}" for i in range(d)]
    ctes = [f"fit0 AS MATERIALIZED (SELECT DISTINCT {key}, {', '.join(f'0.0::DOUBLE AS {b}' for b in names)} FROM {source})"]
    cells = [(i, j) for i in range(d) for j in range(d + 1)]
    for t in range(steps):
        z = " + ".join(f"{b} * {v}" for b, v in zip(names, x))
        ctes.append(f"z{t} AS (SELECT {source}.*, {', '.join(names)}, 1 / (1 + exp(-({z}))) AS s FROM {source} JOIN fit{t} USING ({key}))")
        entry = {}
        for i, j in cells:
            ridge = f" + {1 / c!r}::DOUBLE" if i else ""
            if j == d:
                entry[i, j] = f"sum((s - y) * {x[i]})" + (f"{ridge} * {names[i]}" if i else "")
            else:
                entry[i, j] = f"sum(s * (1 - s) * {x[i]} * {x[j]})" + (ridge if i == j else "")
        shown = ", ".join(f"{text} AS m{i}_{j}" for (i, j), text in entry.items())
        ctes.append(f"e{t}_0 AS MATERIALIZED (SELECT {key}, {', '.join(names)}, {shown} FROM z{t} GROUP BY {key}, {', '.join(names)})")
        for k in range(d):
            step = ", ".join(
                f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" for i, j in cells
            )
            ctes.append(f"e{t}_{k + 1} AS MATERIALIZED (SELECT {key}, {', '.join(names)}, {step} FROM e{t}_{k})")
        moved = ", ".join(f"{b} - m{i}_{d} AS {b}" for i, b in enumerate(names))
        ctes.append(f"fit{t + 1} AS MATERIALIZED (SELECT {key}, {moved} FROM e{t}_{d})")
    return [*ctes, f"fitted AS (SELECT * FROM fit{steps})"]


def _out_of_sample_queries() -> dict[str, str]:
    """Fitted on earlier thirds of each series, applied to the last."""
    sc = [_scores(), THIRDS]
    platt = [_part("part", "weigh"), "known AS (SELECT * FROM part WHERE p IS NOT NULL)", *_newton("known", ["p"], "model", 1.0)]
    wide = ", ".join(f"max(p) FILTER (WHERE model = '{m}') AS x{i}" for i, m in enumerate(MODELS))
    whole = " AND ".join(f"x{i} IS NOT NULL" for i in range(len(MODELS)))
    scaled = ", ".join(f"(x{i} - a{i}) / d{i} AS x{i}" for i in range(len(MODELS)))
    stack = [
        _part("part", "fit"), _part("later", "predict"),
        f"mx AS (SELECT ticker, date, max(y) AS y, {wide} FROM part GROUP BY ticker, date HAVING {whole})",
        "sc AS (SELECT " + ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS d{i}" for i in range(len(MODELS))) + " FROM mx)",
        f"st AS MATERIALIZED (SELECT 1 AS one, y, {scaled} FROM mx, sc)", *_newton("st", [f"x{i}" for i in range(len(MODELS))], "one", 0.5),
        f"nx AS (SELECT ticker, date, {wide} FROM later GROUP BY ticker, date)",
        f"ns AS (SELECT ticker, date, {whole} AS known, {scaled} FROM nx, sc)",
    ]
    total = " + ".join(["b0", *[f"b{i + 1} * x{i}" for i in range(len(MODELS))]])
    return {
        "ens_auc_weighted": _with(
            [*sc, _part("part", "weigh"), _part("later", "predict"), _weights()],
            "SELECT ticker, date, round(sum(weight * p) / sum(weight) FILTER (WHERE p IS NOT NULL), 6) AS p"
            " FROM later JOIN weights USING (model) GROUP BY ticker, date",
        ),
        "ens_calibration": _with([*sc, *platt], "SELECT model, round(b0, 6) AS intercept, round(b1, 6) AS slope FROM fitted"),
        "ens_calibrated": _with(
            [*sc, *platt, _part("later", "predict"), _weights(),
             "cal AS (SELECT ticker, date, model, 1 / (1 + exp(-(b0 + b1 * p))) AS p FROM later JOIN fitted USING (model))"],
            "SELECT ticker, date, round(sum(weight * p) / sum(weight) FILTER (WHERE p IS NOT NULL), 6) AS p"
            " FROM cal JOIN weights USING (model) GROUP BY ticker, date",
        ),
        "ens_stacking": _with(
            [*sc, *stack],
            f"SELECT ticker, date, round(CASE WHEN known THEN 1 / (1 + exp(-({total}))) END, 6) AS p, NOT known AS missing FROM ns, fitted",
        ),
    }


def _ensemble_queries() -> dict[str, str]:
    sc = _scores()
    edge = "abs(p - 0.5)"
    return {
        "probability_audit": _with(
            [sc, "known AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in (*MODELS, "absent")) + "]) AS model)"],
            "SELECT known.model, count(scores.model) AS rows, count(scores.model) FILTER (WHERE p IS NULL) AS missing,"
            " 0::BIGINT AS infinite, count(*) FILTER (WHERE p < 0 OR p > 1) AS out_of_range, true AS known"
            " FROM known LEFT JOIN scores ON known.model = scores.model GROUP BY known.model",
        ),
        "ens_equal": _with([sc], "SELECT ticker, date, round(avg(p), 6) AS p FROM scores GROUP BY ticker, date"),
        "ens_weights": _with([sc, _sliced("eval"), _weights()], f"SELECT model, {_r(('auc', 'adjusted', 'weight'))} FROM weights"),
        "latest_forecast": _with(
            [sc, "f AS (SELECT model, ticker, date, p FROM scores WHERE p IS NOT NULL QUALIFY row_number() OVER"
             " (PARTITION BY model, ticker ORDER BY date DESC) = 1)",
             "bar AS (SELECT model, ticker, max(date) AS newest FROM scores GROUP BY model, ticker)",
             "c AS (SELECT ticker, count(*) FILTER (WHERE p >= 0.5) AS models_up, count(*) FILTER (WHERE p < 0.5) AS models_down"
             " FROM f GROUP BY ticker)"],
            f"SELECT ticker, model, date, CAST(date_diff('day', date, newest) AS INT) AS age, round(p, 6) AS p,"
            f" CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction,"
            f" CASE WHEN {edge} > 0.2 THEN 'STRONG' WHEN {edge} > 0.1 THEN 'MODERATE' ELSE 'WEAK' END AS strength,"
            " models_up, models_down FROM f JOIN bar USING (model, ticker) JOIN c USING (ticker)",
        ),
        "ticker_ranking": _with(
            [sc, "eq AS (SELECT ticker, date, avg(p) AS p FROM scores GROUP BY ticker, date)",
             "top AS (SELECT ticker, max_by(p, date) AS p FROM eq GROUP BY ticker)",
             "r AS (SELECT *, rank() OVER (ORDER BY p DESC) AS rank, min(p) OVER () AS lowest FROM top)"],
            "SELECT ticker, round(p, 6) AS p, rank, CASE WHEN rank = 1 THEN 'top' WHEN p = lowest THEN 'avoid' ELSE '' END"
            " AS pick FROM r",
        ),
    }


KEY = "PARTITION BY model, ticker ORDER BY date"
RATE = repr((1.0 + 2.0 + 0.1 * math.sqrt(1000 / 10e6) * 1e4) / 1e4)
HURDLE = repr(0.05 / 252)


def _positions(parity: bool = False, stop: bool = True, kelly: bool = True, confidence: float = 0.0, long_only: bool = False) -> str:
    """Signals with the stop overlay as a recursive walk over each (model, ticker)."""
    gain = f"(o1 - open) / (open + {E})" if parity else f"(o2 - o1) / (o1 + {E})"
    edge = "(2 * p - 1)" if parity else "abs(2 * p - 1)"
    size = f"least(greatest({edge} / (1 + {E}) * 0.2::DOUBLE, 0), 1)" if kelly else "1.0::DOUBLE"
    short = "0" if long_only else "-size"
    head = f"""px AS (SELECT ticker, date, close, open, lead(open) {_over()} AS o1, lead(open, 2) {_over()} AS o2,
    lead(close) {_over()} AS c1 FROM bars),
ex AS (SELECT *, {gain} AS exec_ret FROM px WHERE {'o1' if parity else 'o2'} IS NOT NULL),
b0 AS (SELECT model, ticker, date, p, y, close, o1, c1, exec_ret, p IS NULL AS missing, CAST(p >= 0.5 AS INT) AS direction,
    coalesce(abs(p - 0.5) >= {confidence!r}::DOUBLE, false) AS confident, CASE WHEN p IS NULL THEN 0 ELSE {size} END AS size
    FROM scores JOIN ex USING (ticker, date)),
b1 AS (SELECT *, CASE WHEN NOT confident THEN 0 WHEN direction = 1 THEN size ELSE {short} END AS raw, row_number() OVER ({KEY}) - 1 AS k FROM b0)"""
    if not stop:
        return head + """, held AS (SELECT *, raw AS signal, false AS stopped FROM b1)"""
    hit = "sign(b1.raw) = w.side AND w.open_trade AND w.entry > 1e-9 AND sign(b1.raw) * (b1.o1 - w.entry) / w.entry < -0.05"
    return head + f""",
w(model, ticker, k, side, open_trade, entry, stopped) AS (
    SELECT model, ticker, k, sign(raw), raw <> 0, CASE WHEN raw <> 0 THEN o1 ELSE 0 END, false FROM b1 WHERE k = 0
    UNION ALL SELECT b1.model, b1.ticker, b1.k, CASE WHEN {hit} THEN 0 ELSE sign(b1.raw) END,
        b1.raw <> 0 AND NOT ({hit}),
        CASE WHEN b1.raw = 0 OR ({hit}) THEN 0 WHEN NOT w.open_trade OR sign(b1.raw) <> w.side THEN b1.o1 ELSE w.entry END,
        ({hit}) FROM w JOIN b1 ON b1.model = w.model AND b1.ticker = w.ticker AND b1.k = w.k + 1),
held AS (SELECT b1.*, CASE WHEN stopped THEN 0 ELSE raw END AS signal, stopped FROM b1 JOIN w USING (model, ticker, k))"""


def _book(parity: bool = False, **options) -> str:
    extra = "CASE WHEN sign(signal) * sign(prev0) < 0 THEN abs(prev0) ELSE 0 END" if parity else "0"
    return f"""{_positions(parity, **options)},
h1 AS (SELECT *, lag(signal) OVER ({KEY}) AS prev FROM held),
h2 AS (SELECT *, coalesce(prev, 0) AS prev0 FROM h1),
h3 AS (SELECT *, (abs(signal - prev0) + {extra}) * {RATE} AS cost FROM h2),
h4 AS (SELECT *, signal * exec_ret - cost AS net_ret FROM h3),
h5 AS (SELECT *, greatest(product(1 + net_ret) OVER ({KEY}), 1e-6) AS equity FROM h4),
h6 AS (SELECT *, max(equity) OVER ({KEY}) AS peak FROM h5),
book AS (SELECT *, (equity - peak) / peak AS underwater FROM h6)"""


def _ratio_select(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, CASE WHEN count(*) < 2 THEN 0
    ELSE {ROOT_YEAR} * avg(net_ret - {HURDLE}) / stddev_samp(net_ret - {HURDLE}) END AS sharpe,
    {ROOT_YEAR} * avg(net_ret - {HURDLE}) / (stddev_pop(net_ret - {HURDLE}) FILTER (WHERE net_ret < {HURDLE}) + {E}) AS sortino,
    sum(greatest(net_ret - {HURDLE}, 0)) / sum(greatest({HURDLE} - net_ret, 0)) AS omega"""


TRADES = f"""count(*) FILTER (WHERE signal <> prev0) AS n_trades, count(*) FILTER (WHERE stopped) AS n_stopped,
    coalesce(avg(abs(signal - prev)), 0) AS turnover, coalesce(count(*) FILTER (WHERE signal <> 0)::DOUBLE
    / nullif(count(*) FILTER (WHERE signal <> 0 AND prev0 = 0), 0), 0) AS avg_hold,
    coalesce(count(*) FILTER (WHERE signal <> 0 AND net_ret > 0)::DOUBLE / nullif(count(*) FILTER (WHERE signal <> 0), 0), 0)
    AS win_rate, sum(net_ret) FILTER (WHERE signal <> 0 AND net_ret > 0)
    / abs(sum(net_ret) FILTER (WHERE signal <> 0 AND net_ret < 0)) AS profit_factor, avg(CAST(confident AS DOUBLE)) AS pct_confident"""


def _ledger_queries() -> dict[str, str]:
    sc = _scores()
    keys = "model, ticker"
    queries = {}
    shown = "model, ticker, date, direction, round(size, 6) AS size, stopped, " + _r(
        ("signal", "exec_ret", "cost", "net_ret", "equity", "peak", "underwater")
    )
    for name, parity in (("ledger", False), ("ledger_parity", True)):
        queries[name] = _with([sc, _book(parity)], f"SELECT {shown} FROM book", recursive=True)
    frame = f"OVER ({KEY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    queries["kelly_history"] = _with(
        [sc, _positions(stop=False, kelly=False), f"k0 AS (SELECT *, lag(signal * exec_ret, 2) OVER ({KEY}) AS pnl FROM held)",
         "k1 AS (SELECT *, greatest(pnl, 0) AS win, abs(least(pnl, 0)) AS loss FROM k0)",
         f"k2 AS (SELECT *, coalesce(CASE WHEN count(pnl) {frame} >= 20 THEN avg(win) FILTER (WHERE pnl IS NOT NULL) {frame} END, 0.006) AS aw,"
         f" coalesce(CASE WHEN count(pnl) {frame} >= 20 THEN avg(loss) FILTER (WHERE pnl IS NOT NULL) {frame} END, 0.006) AS al FROM k1)",
         f"k3 AS (SELECT *, CASE WHEN aw / (al + {E}) < 0.1 THEN 1 ELSE aw / (al + {E}) END AS b, greatest(p, 1 - p) AS q FROM k2)",
         f"k4 AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE least(greatest((q * b - (1 - q)) / (b + {E}) * 0.2::DOUBLE, 0), 1) END AS sz FROM k3)"],
        "SELECT model, ticker, date, round(sz, 6) AS size, round(CASE WHEN p IS NULL THEN 0 WHEN direction = 1 THEN sz ELSE -sz END, 6) AS signal FROM k4",
    )
    queries["trade_stats"] = _with(
        [sc, _book(), f"t AS (SELECT model, ticker, {TRADES} FROM book GROUP BY model, ticker)"],
        "SELECT model, ticker, n_trades, n_stopped, "
        + _r(("turnover", "avg_hold", "win_rate", "profit_factor", "pct_confident")) + " FROM t", recursive=True,
    )
    queries["trade_stats_confident"] = _with(
        [sc, _book(confidence=0.1), f"t AS (SELECT model, ticker, {TRADES} FROM book GROUP BY model, ticker)"],
        "SELECT model, ticker, n_trades, n_stopped, " + _r({
            "turnover": "turnover", "avg_hold": "avg_hold", "win_rate": "win_rate", "pct_confident": "pct_confident",
            "profit_factor": "CASE WHEN profit_factor IS NOT NULL THEN profit_factor WHEN win_rate > 0 THEN 'Infinity'::DOUBLE ELSE 1 END",
        }) + " FROM t", recursive=True,
    )
    queries["ledger_long_only"] = _with(
        [sc, _book(confidence=0.1, long_only=True)],
        f"SELECT model, ticker, date, missing, confident, {_r(('signal', 'net_ret', 'equity'))} FROM book", recursive=True,
    )
    queries["ledger_audit"] = _with(
        [sc],
        "SELECT model, ticker, count(*) AS rows, count(*) FILTER (WHERE p IS NULL) AS missing,"
        " count(*) FILTER (WHERE p < 0 OR p > 1) AS out_of_range, count(p) >= 2 AS usable FROM scores GROUP BY model, ticker",
    )
    queries["risk_metrics"] = _with(
        [sc, _book(), f"r AS ({_ratio_select(keys)}, max_by(equity, date) AS last, min(underwater) AS dd FROM book GROUP BY {keys})",
         "a AS (SELECT *, pow(last, 252.0::DOUBLE / (n + 1)) - 1 AS ann FROM r)"],
        "SELECT model, ticker, n, " + _r({
            "sharpe": "sharpe", "sortino": "sortino", "omega": "omega", "total_ret": "last - 1", "ann_ret": "ann",
            "calmar": f"ann / (abs(dd) + {E})"}, 5) + " FROM a", recursive=True,
    )
    roll = f"OVER ({KEY} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    queries["rolling_sharpe"] = _with(
        [sc, _book()],
        f"SELECT model, ticker, date, round(CASE WHEN count(*) {roll} = 63 THEN {ROOT_YEAR} * avg(net_ret - {HURDLE}) {roll}"
        f" / stddev_samp(net_ret - {HURDLE}) {roll} END, 6) AS rolling_sharpe FROM book", recursive=True,
    )
    drawdown = [
        sc, _book(), f"z AS (SELECT *, row_number() OVER ({KEY}) - 1 AS pos FROM book)",
        "worst AS (SELECT model, ticker, underwater AS max_dd, pos AS trough, peak AS top FROM z QUALIFY row_number() OVER"
        " (PARTITION BY model, ticker ORDER BY underwater, pos) = 1)",
        "around AS (SELECT model, ticker, any_value(max_dd) AS max_dd, coalesce(avg(underwater) FILTER (WHERE underwater < 0), 0)"
        " AS avg_dd, any_value(trough) AS trough, max(pos) FILTER (WHERE pos <= trough AND equity >= top - 1e-10) AS a,"
        " min(pos) FILTER (WHERE pos > trough AND equity >= top - 1e-10) AS b FROM z JOIN worst USING (model, ticker)"
        " GROUP BY model, ticker)",
    ]
    queries["drawdown"] = _with(
        drawdown, "SELECT model, ticker, round(max_dd, 6) AS max_dd, round(avg_dd, 6) AS avg_dd,"
        " trough - coalesce(a, 0) AS max_dd_duration, b - trough AS max_dd_recovery FROM around", recursive=True,
    )
    queries["var_cvar"] = _with(
        [sc, _book(), "q AS (SELECT model, ticker, quantile_cont(net_ret, 0.050000000000000044) AS cut FROM book GROUP BY model, ticker)"],
        "SELECT model, ticker, round(-any_value(cut), 6) AS var_95, round(-avg(net_ret) FILTER (WHERE net_ret <= cut), 6) AS cvar_95"
        " FROM book JOIN q USING (model, ticker) GROUP BY model, ticker", recursive=True,
    )
    bench = f"""hb AS (SELECT *, (c1 - close) / (close + {E}) AS hold FROM book),
bm AS (SELECT model, ticker, count(*) AS n, max_by(c1, date) / min_by(close, date) AS g, avg(hold - {HURDLE}) AS hm,
    stddev_samp(hold - {HURDLE}) AS hs, covar_samp(net_ret, hold) AS cv, var_samp(hold) AS vr, avg(net_ret - hold) AS am,
    stddev_samp(net_ret - hold) AS sd, greatest(product(1 + net_ret), 1e-12) AS cap, product(1 + hold) AS hp
    FROM hb GROUP BY model, ticker),
bk AS (SELECT *, pow(g, 252.0::DOUBLE / (n + 1)) - 1 AS ba, CASE WHEN vr > 1e-12 THEN cv / vr ELSE 1 END AS beta FROM bm)"""
    bench_columns = {
        "bh_total_ret": "g - 1", "bh_ann_ret": "ba", "bh_sharpe": f"{ROOT_YEAR} * hm / hs", "beta": "beta",
        "alpha": "pow(cap, 252.0::DOUBLE / (n + 1)) - 1 - beta * ba", "information_ratio": f"{ROOT_YEAR} * am / sd",
        "excess_vs_bh": "cap - hp",
    }
    queries["benchmark"] = _with([sc, _book(), bench], f"SELECT model, ticker, {_r(bench_columns, 5)} FROM bk", recursive=True)

    realised = f"rr AS (SELECT model, p, (c1 - close) / (close + {E}) AS ret FROM book WHERE p IS NOT NULL)"
    queries["rank_ic"] = _with(
        [sc, _book(), realised,
         f"rk AS (SELECT model, {MID.format(k='model', x='p')} AS a, {MID.format(k='model', x='ret')} AS b FROM rr)"],
        "SELECT model, round(corr(a, b), 6) AS ic FROM rk GROUP BY model", recursive=True,
    )

    stress_rate = repr(0.1 * math.sqrt(1000 / 10e6) * 1e4)
    stress = f"""{_positions()},
g1 AS (SELECT *, lag(signal) OVER ({KEY}) AS prev FROM held),
g2 AS (SELECT g1.*, coalesce(prev, 0) AS prev0, bps::DOUBLE AS total_cost_bps FROM g1, (VALUES (1), (5), (10), (20), (50)) v(bps)),
g3 AS (SELECT *, signal * exec_ret - abs(signal - prev0) * (total_cost_bps + {stress_rate}) / 10000 AS net_ret FROM g2),
g4 AS (SELECT *, greatest(product(1 + net_ret) OVER (PARTITION BY total_cost_bps, model, ticker ORDER BY date), 1e-6) AS equity FROM g3),
book AS (SELECT *, equity / max(equity) OVER (PARTITION BY total_cost_bps, model, ticker ORDER BY date) - 1 AS underwater FROM g4)"""
    queries["cost_stress"] = _with(
        [sc, stress, f"""st AS ({_ratio_select('total_cost_bps, model, ticker')}, max_by(equity, date) AS last,
    min(underwater) AS max_dd, {TRADES} FROM book GROUP BY total_cost_bps, model, ticker)""",
         """ed AS (SELECT *, first_value(sharpe) OVER (PARTITION BY model, ticker ORDER BY total_cost_bps) AS base,
    max(total_cost_bps) FILTER (WHERE sharpe >= 0) OVER k AS c1, max_by(sharpe, total_cost_bps) FILTER (WHERE sharpe >= 0) OVER k AS s1,
    min(total_cost_bps) FILTER (WHERE sharpe < 0) OVER k AS c2, min_by(sharpe, total_cost_bps) FILTER (WHERE sharpe < 0) OVER k AS s2
    FROM st WINDOW k AS (PARTITION BY model, ticker))"""],
        "SELECT model, ticker, n_trades, " + _r({
            "total_cost_bps": "total_cost_bps", "commission_bps": "round(total_cost_bps / 3, 4)",
            "slippage_bps": "total_cost_bps - round(total_cost_bps / 3, 4)", "impact_bps": stress_rate,
            "effective_bps": f"total_cost_bps + {stress_rate}", "sharpe": "sharpe", "ann_ret": "pow(last, 252.0::DOUBLE / (n + 1)) - 1",
            "max_dd": "max_dd", "win_rate": "win_rate", "turnover": "turnover", "sharpe_vs_cheapest": "sharpe - base",
            "breakeven_bps": "c1 + (0 - s1) * (c2 - c1) / (s2 - s1)"}) + " FROM ed", recursive=True,
    )

    queries["diagnostics"] = _with(
        [sc, _book(), PREDICTED, _auc("scores", "model"),
         "c AS (SELECT model, avg(CAST(pred = y AS DOUBLE)) AS accuracy FROM pr GROUP BY model)",
         "t AS (SELECT model, count(*) FILTER (WHERE signal <> prev0) AS n_trades FROM book GROUP BY model)",
         f"m AS (SELECT min(n_trades) AS t, max(auc) AS a, max(accuracy) FILTER (WHERE model <> '{MODELS[0]}')"
         f" - max(accuracy) FILTER (WHERE model = '{MODELS[0]}') AS c FROM aucs JOIN c USING (model) JOIN t USING (model))",
         f"e AS (SELECT avg(vs_baseline) AS e FROM ({_with(_walk_ctes(), 'SELECT vs_baseline FROM wf')}) walk)",
         "f AS (SELECT 'every model trades' AS \"check\", t::DOUBLE AS value, t > 0 AS passed FROM m"
         " UNION ALL SELECT 'best auc', a, a >= 0.52 FROM m UNION ALL SELECT 'best accuracy above baseline', c, c > 0 FROM m"
         " UNION ALL SELECT 'walk-forward edge', e, e >= 0 FROM e)",
         "d AS (SELECT * FROM f UNION ALL SELECT 'issues', count(*) FILTER (WHERE NOT coalesce(passed, false))::DOUBLE,"
         " count(*) FILTER (WHERE NOT coalesce(passed, false)) = 0 FROM f)"],
        "SELECT \"check\", round(value, 6) AS value, passed FROM d", recursive=True,
    )

    report = [
        *drawdown, bench, PREDICTED, _auc("scores", keys),
        f"ra AS ({_ratio_select(keys)}, max_by(equity, date) AS last, min(underwater) AS dd FROM book GROUP BY {keys})",
        f"tr AS (SELECT model, ticker, {TRADES} FROM book GROUP BY model, ticker)",
        "cl AS (SELECT model, ticker, avg(CAST(pred = y AS DOUBLE)) AS accuracy, count(*) FILTER (WHERE pred = 1 AND y = 1) AS tp,"
        " count(*) FILTER (WHERE pred = 0 AND y = 0) AS tn, count(*) FILTER (WHERE pred <> y) AS bad, avg(pow(prob - y, 2)) AS brier"
        " FROM pr GROUP BY model, ticker)",
        f"rr AS (SELECT model, ticker, p, (c1 - close) / (close + {E}) AS ret FROM book WHERE p IS NOT NULL)",
        f"rk AS (SELECT model, ticker, {MID.format(k=keys, x='p')} AS a, {MID.format(k=keys, x='ret')} AS b FROM rr)",
        "ic AS (SELECT model, ticker, corr(a, b) AS ic FROM rk GROUP BY model, ticker)",
        "q AS (SELECT model, ticker, quantile_cont(net_ret, 0.050000000000000044) AS cut FROM book GROUP BY model, ticker)",
        "va AS (SELECT model, ticker, -any_value(cut) AS var_95, -avg(net_ret) FILTER (WHERE net_ret <= cut) AS cvar_95 FROM book"
        " JOIN q USING (model, ticker) GROUP BY model, ticker)",
    ]
    flat = {
        "accuracy": "accuracy", "f1_up": "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + bad, 0), 0)",
        "f1_down": "coalesce(2.0::DOUBLE * tn / nullif(2 * tn + bad, 0), 0)", "brier": "brier", "auc": "auc",
        "ic": "coalesce(ic, 0)", "sharpe": "sharpe", "sortino": "sortino", "total_ret": "last - 1",
        "ann_ret": "pow(last, 252.0::DOUBLE / (ra.n + 1)) - 1",
        "calmar": f"(pow(last, 252.0::DOUBLE / (ra.n + 1)) - 1) / (abs(dd) + {E})", "max_dd": "around.max_dd", "avg_dd": "avg_dd",
        "var_95": "var_95", "cvar_95": "cvar_95", "turnover": "turnover", "avg_hold": "avg_hold", "win_rate": "win_rate",
        "pct_confident": "pct_confident",
    } | {k: v.replace("(n + 1)", "(bk.n + 1)") for k, v in bench_columns.items()}
    queries["model_report"] = _with(
        report,
        f"SELECT model, ticker, ra.n AS n, CAST(round(omega, 6) AS VARCHAR) AS omega, CAST(round(profit_factor, 6) AS VARCHAR)"
        f" AS profit_factor, n_trades, n_stopped, trough - coalesce(a, 0) AS max_dd_duration, b - trough AS max_dd_recovery, {_r(flat)}"
        " FROM ra JOIN tr USING (model, ticker) JOIN cl USING (model, ticker) JOIN aucs USING (model, ticker)"
        " JOIN ic USING (model, ticker) JOIN va USING (model, ticker) JOIN around USING (model, ticker) JOIN bk USING (model, ticker)",
        recursive=True,
    )

    folio = "folio AS (SELECT model, date, avg(net_ret) AS net_ret FROM book GROUP BY model, date)"
    queries["compare_models"] = _with(
        [sc, _book(), folio, f"r AS ({_ratio_select('model')} FROM folio GROUP BY model)"],
        f"SELECT model, n, {_r(('sharpe', 'sortino', 'omega'), 5)} FROM r", recursive=True,
    )
    boot = [
        sc, _book(), folio,
        "po AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date) - 1 AS pos, lag(net_ret) OVER"
        " (PARTITION BY model ORDER BY date) AS prev FROM folio)",
        "le AS (SELECT model, count(*) AS n, least(greatest(1, CAST(round(1 / (1 - least(abs(coalesce(corr(prev, net_ret), 0)), 0.99)))"
        " AS INT)), greatest(count(*) // 4, 1)) AS len FROM po GROUP BY model)",
        f"da AS (SELECT model, n, len, rep, unnest(range(n)) AS t FROM le, range({REPLICATES}) a(rep))",
        "dr AS (SELECT *, t // len AS blk FROM da)",
        f"ix AS (SELECT model, rep, (('0x' || substr(md5('{SEED}-' || rep || '-' || blk), 1, 8))::BIGINT % n + t % len) % n AS pos FROM dr)",
        f"sh AS (SELECT model, rep, CASE WHEN stddev_samp(net_ret) > 1e-10 THEN {ROOT_YEAR} * avg(net_ret) / stddev_samp(net_ret)"
        " ELSE 0 END AS sharpe FROM ix JOIN po USING (model, pos) GROUP BY model, rep)",
        "ci AS (SELECT model, quantile_cont(sharpe, 0.025) AS ci_lower, quantile_cont(sharpe, 0.975) AS ci_upper FROM sh GROUP BY model)",
    ]
    queries["bootstrap_ci"] = _with(boot, f"SELECT model, {_r(('ci_lower', 'ci_upper'), 5)} FROM ci", recursive=True)
    t = "(1 / (1 + 0.2316419 * abs(z)))"
    poly = f"{t} * (0.31938153 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"(exp(-z * z / 2) / sqrt(2 * pi()) * ({poly}))"
    bench_z = repr(trial_benchmark(9))
    deflated = [
        f"d0 AS (SELECT model, count(*) AS n_obs, {ROOT_YEAR} * avg(net_ret) / stddev_samp(net_ret) AS sharpe, avg(pow(net_ret - m, 3))"
        " / pow(avg(pow(net_ret - m, 2)), 1.5) AS skewness, avg(pow(net_ret - m, 4)) / pow(avg(pow(net_ret - m, 2)), 2) - 3"
        " AS excess_kurtosis FROM (SELECT *, avg(net_ret) OVER (PARTITION BY model) AS m FROM folio) GROUP BY model)",
        f"d1 AS (SELECT *, (sharpe - {bench_z}) / sqrt(greatest((1 - skewness * sharpe / sqrt(252) + excess_kurtosis / 4 * sharpe * sharpe"
        " / 252) / greatest(n_obs - 1, 1) * 252, 1e-12)) AS z FROM d0)",
        f"d2 AS (SELECT *, CASE WHEN z >= 0 THEN 1 - {tail} ELSE {tail} END AS dsr, {bench_z}::DOUBLE AS sr_benchmark, 9 AS n_trials FROM d1)",
    ]
    queries["dsr_summary"] = _with(
        [sc, _book(), folio, *deflated],
        f"SELECT model, n_obs, n_trials, {_r(('sharpe', 'skewness', 'excess_kurtosis', 'dsr', 'sr_benchmark'), 5)} FROM d2", recursive=True,
    )
    queries["significance"] = _with(
        [*boot, *deflated],
        "SELECT model, round(ci_lower, 3) AS ci_lower, round(ci_upper, 3) AS ci_upper, round(ci_upper - ci_lower, 3) AS ci_width,"
        " round(dsr, 4) AS dsr, round(sr_benchmark, 3) AS sr_benchmark, dsr > 0.95 AS is_significant, n_obs, n_trials,"
        " round(skewness, 3) AS skewness, round(excess_kurtosis, 3) AS excess_kurtosis, CASE WHEN dsr < 0.5 THEN 'FAIL'"
        " WHEN dsr < 0.8 THEN 'WEAK' WHEN dsr < 0.95 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS verdict FROM d2 JOIN ci USING (model)",
        recursive=True,
    )
    return queries


def _walk_ctes() -> list[str]:
    fold_key = "model, ticker, fold"
    return [
        _scores("region"),
        "lens AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker)",
        "widths AS (SELECT *, greatest((n - 351) // 8, 20) AS w FROM lens)",
        "folds AS (SELECT ticker, k + 1 AS fold, 300 + k * w AS train_end, 351 + k * w AS a, 351 + (k + 1) * w AS b"
        " FROM widths, range(8) r(k) WHERE 351 + (k + 1) * w <= n)",
        f"pb AS (SELECT *, row_number() {_over()} - 1 AS pos, (lead(close) {_over()} - close) / (close + {E}) AS realised FROM bars)",
        "te AS (SELECT pb.*, fold, train_end FROM pb JOIN folds ON pb.ticker = folds.ticker AND pos >= a AND pos < b)",
        f"bl AS (SELECT *, CAST(coalesce({_roll('avg', 'close', 5, keys='ticker, fold')} > {_roll('avg', 'close', 20, keys='ticker, fold')},"
        " false) AS INT) AS baseline FROM te)",
        "tt AS (SELECT sc.model, bl.ticker, bl.date, fold, train_end, realised, baseline, coalesce(p, 0.5) AS p, y,"
        " CAST(coalesce(p, 0.5) >= 0.5 AS INT) AS pred, CASE WHEN coalesce(p, 0.5) >= 0.5 THEN realised ELSE -realised END AS pnl"
        " FROM bl JOIN scores sc ON bl.ticker = sc.ticker AND bl.date = sc.date WHERE realised IS NOT NULL)",
        _auc("tt", fold_key),
        f"rk AS (SELECT model, ticker, fold, {MID.format(k=fold_key, x='p')} AS ra, {MID.format(k=fold_key, x='realised')} AS rb FROM tt)",
        "ic AS (SELECT model, ticker, fold, CASE WHEN count(*) < 5 THEN 0 ELSE corr(ra, rb) END AS ic FROM rk GROUP BY model, ticker, fold)",
        "cu AS (SELECT *, product(1 + greatest(pnl, -0.99)) OVER (PARTITION BY model, ticker, fold ORDER BY date) AS cum FROM tt)",
        "pk AS (SELECT *, max(cum) OVER (PARTITION BY model, ticker, fold ORDER BY date) AS peak FROM cu)",
        f"dd AS (SELECT model, ticker, fold, min((cum - peak) / (peak + {E})) AS max_dd FROM pk GROUP BY model, ticker, fold)",
        f"""st AS (SELECT model, ticker, fold, max(train_end) AS tr_rows, min(date) AS test_start, max(date) AS test_end, 51 AS gap,
    true AS is_clean, count(*) AS te_rows, avg(CAST(pred = y AS DOUBLE)) AS acc, avg(pnl) / stddev_pop(pnl) * {ROOT_YEAR} AS sharpe,
    CASE WHEN count(*) FILTER (WHERE pnl < 0) < 2 THEN 0 ELSE avg(pnl) / stddev_pop(pnl) FILTER (WHERE pnl < 0) * {ROOT_YEAR} END AS sortino,
    avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, avg(CAST(baseline = y AS DOUBLE)) AS baseline_acc, avg(y) * 100 AS up_pct
    FROM tt GROUP BY model, ticker, fold)""",
        f"wf AS (SELECT *, acc - baseline_acc AS vs_baseline FROM st JOIN aucs USING ({fold_key}) JOIN ic USING ({fold_key})"
        f" JOIN dd USING ({fold_key}))",
    ]


def _walk_forward_queries() -> dict[str, str]:
    ctes = _walk_ctes()
    figures = ("acc", "auc", "ic", "sharpe", "sortino", "win_rate", "max_dd", "baseline_acc", "vs_baseline")
    summary = ", ".join(f"round(avg({f}), 6) AS {f}_mean, round(stddev_samp({f}), 6) AS {f}_std" for f in figures)
    return {
        "walk_forward": _with(
            ctes, f"SELECT model, ticker, fold, tr_rows, test_start, test_end, gap, is_clean, te_rows, {_r((*figures, 'up_pct'))} FROM wf"
        ),
        "walk_forward_summary": _with(
            ctes, f"SELECT model, count(*) AS folds, count(*) FILTER (WHERE is_clean) AS clean_folds, {summary},"
            " avg(vs_baseline) > 0 AS positive_edge FROM wf GROUP BY model"
        ),
    }


def _other_queries() -> dict[str, str]:
    region = _bars("region")
    queries = {
        "flagship": _with(
            [region, f"p AS (SELECT ticker, coalesce(CAST({_roll('avg', 'close', 5)} > {_roll('avg', 'close', 20)} AS DOUBLE), 0) AS p,"
             f" CAST(lead(close) {_over()} > close AS DOUBLE) AS y FROM bars)"],
            "SELECT ticker, count(*) AS bars, round(avg(CAST(p = y AS DOUBLE)), 6) AS accuracy, round(avg(y), 6) AS up_share"
            " FROM p WHERE y IS NOT NULL GROUP BY ticker",
        ),
        "ma_signal": _with(
            [_bars()], f"SELECT ticker, date, coalesce(CAST({_roll('avg', 'close', 5)} > {_roll('avg', 'close', 20)} AS DOUBLE), 0) AS p FROM bars"
        ),
        "regime": _with([_bars(damped=True), SERIES, _regime_cte()], "SELECT ticker, date, regime FROM regimes"),
        "feat_autocorr": _feature(
            {"autocorr_1": _autocorr(20, 1), "autocorr_5": _autocorr(30, 5)},
            extra=[f"sl AS (SELECT *, {_lag('lr', 1)} AS lr1, {_lag('lr', 5)} AS lr5 FROM s)"], source="sl",
        ),
        "feat_oscillators": _feature(
            {"stoch_k": "sk", "stoch_d": _roll("avg", "sk", 3), "williams_r": "wr",
             "cci": f"(tp - {_roll('avg', 'tp', 20)}) / (0.015 * {_roll('stddev_samp', 'tp', 20)} + {E})"},
            extra=[f"so AS (SELECT *, (close - {_roll('min', 'low', 14)}) / ({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)} + {E})"
                   f" * 100 AS sk, ({_roll('max', 'high', 14)} - close) / ({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)} + {E})"
                   " * -100 AS wr FROM s)"], source="so",
        ),
        "feat_roc_acceleration": _feature(
            {f"roc_{k}": f"close / ({_lag('close', k)} + {E}) - 1" for k in (5, 10, 20)}
            | {"price_accel": f"lr - {_lag('lr')}", "vol_accel": f"v10 - {_lag('v10')}"},
            extra=[f"sv AS (SELECT *, {_std(10)} AS v10 FROM s)"], source="sv",
        ),
        "feat_vol_rank": _with(
            [_bars(), SERIES, "v AS (SELECT ticker, date, rn, " + ", ".join(f"{_std(k)} AS v{k}" for k in (5, 10, 20, 60)) + " FROM s)",
             "c AS (SELECT a.ticker, a.date, " + ", ".join(
                 f"CASE WHEN any_value(a.v{k}) IS NOT NULL THEN (count(*) FILTER (WHERE b.v{k} < a.v{k})"
                 f" + (count(*) FILTER (WHERE b.v{k} = a.v{k}) + 1) / 2.0::DOUBLE) / count(b.v{k}) END AS r{k}" for k in (5, 10, 20, 60)
             ) + " FROM v a JOIN v b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY a.ticker, a.date)"],
            "SELECT ticker, date, " + _r({f"vol_{k}d_rank": f"r{k}" for k in (5, 10, 20, 60)}) + " FROM c",
        ),
        "price_overlay": _feature(
            {"close": "close", "sma_20": _sma(20), "sma_50": _sma(50), "sma_200": _sma(200), "volume": "volume"}
        ),
        "regime_timeline": _with(
            [_bars(damped=True), SERIES, f"g AS (SELECT ticker, date, close, {_roll('avg', 'lr', 60)} / ({_std(60)} + {E}) * sqrt(60) AS t FROM s)"],
            "SELECT ticker, date, round(close, 6) AS close, round(t, 6) AS regime_trend, CAST(sign(t) AS INT) AS trend_sign FROM g",
        ),
        "buy_hold_curve": _with(
            [_bars()], f"SELECT ticker, date, round(close / first_value(close) {_over()}, 6) AS growth FROM bars"
        ),
    }
    for name, columns in _plain_features().items():
        queries[name] = _feature(columns, "region" if name in ("feat_candle", "feat_gk") else "supplier")
    return queries


ORACLES: dict[str, str] = {
    **_quality_queries(), **_other_queries(), **_ema_queries(), **_targets_queries(), **_panel_queries(),
    **_classification_queries(), **_ensemble_queries(), **_out_of_sample_queries(), **_panel_build_queries(), **_ledger_queries(), **_walk_forward_queries(),
}
ORACLES["select_top_k"] = _select_top(ORACLES)
ORACLES["align_checked"] = f"SELECT * EXCLUDE (filled) FROM ({ORACLES['align_outer']})"
ORACLES["best_model"] = (
    f"SELECT model, accuracy FROM ({ORACLES['clf_metrics']}) WHERE model <> '{MODELS[0]}' ORDER BY accuracy DESC, model DESC LIMIT 1"
)
