"""From probabilities to positions, costs and equity, keyed by (model, ticker) and ordered by date.

By default a signal known at the close of bar t is filled at the next open and earns the move to the open
after that. ``parity=True`` earns the move into the fill instead, sizes shorts at zero and charges reversals
an extra leg, which is what published results of this method assume.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.windows import EPS, Axis, extend, in_segments, is_daily, num, running, with_position
from barloom.sources.bars import require_columns

KEYS = ("model", "ticker")
BAR = ("ticker", "date")
COMMISSION_BPS, SLIPPAGE_BPS, IMPACT = 1.0, 2.0, 0.1
DAILY_VOLUME, TRADE_SIZE = 10e6, 1000.0
RISK_FREE = 0.05
KELLY_FRACTION, MAX_POSITION, STOP_LOSS = 0.20, 1.0, 0.05
COST_SCENARIOS = (1, 5, 10, 20, 50)
EXECUTED = ("close", "next_open", "next_close", "exec_ret")


def with_execution(bars: DataFrame, parity: bool = False) -> DataFrame:
    """Bars with ``next_open``, ``next_close``, ``exec_ret`` (null where fill or exit are unknown) and their place ``pos``, ``n``.

    Scores made from such bars and keeping these columns need no join for their ledger.
    """
    require_columns(bars, ("open", "close"))

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        names = {"next_open": axis.lead("open"), "_exit": axis.lead("open", 2), "next_close": axis.lead("close")}
        return extend(panel, names)

    moved = in_segments(bars, stage, ahead=2, keep=True, blocks=False, by="date")
    gain = f"(next_open - open) / (open + {EPS})" if parity else f"(_exit - next_open) / (next_open + {EPS})"
    return extend(moved, {"exec_ret": gain}).drop("_exit", "seg")


def execution_prices(bars: DataFrame, parity: bool = False) -> DataFrame:
    """(ticker, date, close, next_open, next_close, exec_ret) for bars whose fill and exit are known."""
    moved = with_execution(bars.select("ticker", "date", "open", "close"), parity)
    return moved.select("ticker", "date", *EXECUTED).where("exec_ret IS NOT NULL")


def ledger_input_audit(scores: DataFrame) -> DataFrame:
    """Per (model, ticker): rows, missing or out-of-range probabilities, and whether a ledger can be built."""
    return scores.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr("count_if(p IS NULL OR isnan(p))").alias("missing"),
        F.expr("count_if(p < 0 OR p > 1)").alias("out_of_range"),
        F.expr("count(p) >= 2").alias("usable"),
    )


def signals(
    scores: DataFrame,
    threshold: float = 0.5,
    confidence: float = 0.0,
    long_only: bool = False,
    kelly: bool = True,
    fraction: float = KELLY_FRACTION,
    parity: bool = False,
) -> DataFrame:
    """Add ``missing``, ``direction``, ``confident``, ``size`` and the raw ``signal``.

    A bar without a probability is ``missing``: not confident and flat, so a position held before it is closed there.
    """
    edge = "(2 * p - 1)" if parity else "abs(2 * p - 1)"
    size = f"least(greatest({edge} / (1 + {EPS}) * {num(fraction)}, 0D), {num(MAX_POSITION)})" if kelly else "1D"
    known = extend(scores, {"missing": "p IS NULL OR isnan(p)"})
    sized = extend(
        known,
        {
            "direction": f"CASE WHEN NOT missing THEN int(p >= {num(threshold)}) END",
            "confident": f"NOT missing AND abs(p - 0.5D) >= {num(confidence)}",
            "size": f"CASE WHEN missing THEN 0D ELSE {size} END",
        },
    )
    return extend(sized, {"signal": _directed(long_only)})


def _directed(long_only: bool) -> str:
    short = "0D" if long_only else "-size"
    return f"CASE WHEN NOT confident THEN 0D WHEN direction = 1 THEN size ELSE {short} END"


def kelly_with_history(
    booked: DataFrame, rows: int = 60, min_rows: int = 20, fraction: float = KELLY_FRACTION, parity: bool = False
) -> DataFrame:
    """Replace ``size`` and ``signal`` using the rolling win/loss ratio of ``signal * exec_ret``.

    The outcome of a bar is known two bars later, so the ratio lags by two bars unless ``parity``.
    """

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        delay = 0 if parity else 2
        panel = extend(panel, {"_pnl": axis.lag("signal * exec_ret", delay) if delay else "signal * exec_ret"})
        panel = extend(panel, {"_win": "greatest(_pnl, 0D)", "_loss": "abs(least(_pnl, 0D))"})
        ratio = {
            name: f"coalesce(CASE WHEN count(_pnl) {axis.trailing(rows)} >= {min_rows}"
            f" THEN avg({name}) {axis.trailing(rows)} END, 0.006D)"
            for name in ("_win", "_loss")
        }
        panel = extend(panel, {"_ratio": f"{ratio['_win']} / ({ratio['_loss']} + {EPS})"})
        panel = extend(panel, {"_b": "CASE WHEN _ratio < 0.1D THEN 1D ELSE _ratio END"})
        chance = "p" if parity else "greatest(p, 1 - p)"
        share = f"({chance} * _b - (1 - {chance})) / (_b + {EPS})"
        return extend(
            panel, {"_size": f"CASE WHEN missing THEN 0D ELSE least(greatest({share} * {num(fraction)}, 0D), {num(MAX_POSITION)}) END"}
        )

    sized = in_segments(booked, stage, back=rows + 2, keys=KEYS)
    kept = [c for c in booked.columns if c not in ("size", "signal", "pos", "n", "seg")]
    return extend(sized.selectExpr(*kept, "_size AS size"), {"signal": _directed(False)})


def _stopping(limit: float):
    """Pass over runs in bar order that adds ``stopped``; only the open trade's price is kept from batch to batch."""
    least = float(EPS.rstrip("D"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = None
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("pos", "_run", "next_open", "_side")]
            stopped = []
            for pos, run, price, side in zip(*columns):
                if pos == run:
                    entry = None
                hit = (
                    entry is not None and entry > least and price is not None and side is not None
                    and side * (price - entry) / entry < -limit
                )
                stopped.append(hit)
                if hit:
                    entry = None
                elif entry is None:
                    entry = price
            yield batch.append_column("stopped", pa.array(stopped, pa.bool_()))

    return scan


def _stopped_in_series(booked: DataFrame, limit: float) -> DataFrame:
    """The same pass over daily series: one array each (at most 366 bars a year), so rows stay in the task that holds their series."""
    columns = [c for c in booked.columns if c not in (*KEYS, "pos")]
    gathered = booked.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("_rows"))
    state = "named_struct('side', double(null), 'entry', double(null), 'stops', cast(array() AS array<bigint>))"
    side = "signum(r.signal)"
    entry = f"CASE WHEN coalesce({side} <> coalesce(a.side, 2D), false) THEN double(null) ELSE a.entry END"
    hit = f"coalesce({{0}} > {EPS} AND try_divide({side} * (r.next_open - {{0}}), {{0}}) < {num(-limit)}, false)".format(f"({entry})")
    step = (
        f"CASE WHEN {hit} THEN named_struct('side', {side}, 'entry', double(null), 'stops', concat(a.stops, array(r.pos)))"
        f" ELSE named_struct('side', {side}, 'entry', coalesce({entry}, double(r.next_open)), 'stops', a.stops) END"
    )
    walked = gathered.selectExpr(*KEYS, "_rows", f"aggregate(_rows, {state}, (a, r) -> {step}).stops AS _stops")
    spread = walked.selectExpr(*KEYS, "_stops", "explode(_rows) AS _row")
    return spread.selectExpr(*KEYS, *[f"_row.`{c}` AS `{c}`" for c in ("pos", *columns)], "array_contains(_stops, _row.pos) AS stopped")


def _stopped_in_runs(booked: DataFrame, limit: float) -> DataFrame:
    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        changed = f"signum(signal) <> coalesce({axis.lag('signum(signal)')}, 2D)"
        return extend(panel, {"_start": f"CASE WHEN {changed} THEN pos END"})

    started = in_segments(booked, stage, back=1, keys=KEYS, keep=True)
    runs = extend(running(started, {"_run": ("max", "_start")}, KEYS), {"_side": "signum(signal)"})
    ordered = runs.select(*booked.columns, "_run", "_side").repartition(*KEYS, "_run").sortWithinPartitions(*KEYS, "_run", "pos")
    schema = T.StructType([*ordered.schema.fields, T.StructField("stopped", T.BooleanType(), False)])
    return ordered.mapInArrow(_stopping(limit), schema)


def stop_loss(booked: DataFrame, limit: float = STOP_LOSS) -> DataFrame:
    """Zero the ``signal`` on bars where the open trade is down more than ``limit`` at ``next_open``.

    Adds ``stopped`` and needs ``pos``/``n`` per (model, ticker). A trade ends with its run of equal signal
    signs and is passed over bar by bar: enter at the first bar, stop, re-enter on the next bar. Daily series are
    bounded and walked where they lie. Others are dealt to tasks by runs and sorted there; nothing of a run is held but the price of
    the open trade, whatever its length.
    """
    flat = _stopped_in_series(booked, limit) if is_daily(booked) else _stopped_in_runs(booked, limit)
    kept = [c for c in booked.columns if c != "signal"]
    return flat.selectExpr(*kept, "CASE WHEN stopped THEN 0D ELSE signal END AS signal", "stopped")


def cost_rate(
    commission_bps: float = COMMISSION_BPS,
    slippage_bps: float = SLIPPAGE_BPS,
    impact: float = IMPACT,
    daily_volume: float = DAILY_VOLUME,
    trade_size: float = TRADE_SIZE,
) -> float:
    """One-way cost as a fraction: fees, spread and square-root market impact (10 bps by default)."""
    return (commission_bps + slippage_bps) / 1e4 + impact_bps(impact, daily_volume, trade_size) / 1e4


def impact_bps(impact: float = IMPACT, daily_volume: float = DAILY_VOLUME, trade_size: float = TRADE_SIZE) -> float:
    if daily_volume <= 0 or trade_size <= 0:
        return 0.0
    return impact * math.sqrt(trade_size / daily_volume) * 1e4


def positions(
    scores: DataFrame, bars: DataFrame | None = None, stop: float = STOP_LOSS, parity: bool = False, **signal_options
) -> DataFrame:
    """Final signals with the previous signal and the return each one earns.

    ``bars`` may be left out where the scores carry the columns of ``with_execution`` (of the same ``parity``).
    """
    shown = [*KEYS, "date", "p", *[c for c in ("y",) if c in scores.columns]]
    if bars is None:
        require_columns(scores, EXECUTED)
        known = "ticker IS NOT NULL AND date IS NOT NULL AND exec_ret IS NOT NULL"
        scored = scores.select("ticker", "date", *[c for c in shown if c not in BAR], *EXECUTED).where(known)
    else:
        scored = scores.select(*shown).join(execution_prices(bars, parity), ["ticker", "date"])
    booked = signals(scored, parity=parity, **signal_options)
    booked = with_position(booked, KEYS)
    booked = stop_loss(booked, stop) if stop > 0 else extend(booked, {"stopped": "false"})

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        return extend(panel, {"prev_signal": axis.lag("signal")})

    return in_segments(booked, stage, back=1, keys=KEYS, keep=True, blocks=False)


def _fee(rate: str, extra_leg: float) -> str:
    before = "coalesce(prev_signal, 0D)"
    turn = f"CASE WHEN signum(signal) * signum({before}) < 0 THEN abs({before}) * {num(extra_leg)} ELSE 0D END"
    return f"(abs(signal - {before}) + {turn}) * {rate}"


def equity(
    held: DataFrame, rate: str | float, keys: Sequence[str] = KEYS, extra_leg: float = 0.0
) -> DataFrame:
    """Add ``cost``, ``net_ret``, ``equity``, ``peak`` and ``underwater``. ``rate`` is a number or a column.

    A reversal costs the whole change of position, plus ``extra_leg`` times the position it leaves.
    """
    charged = extend(held, {"cost": _fee(num(rate) if isinstance(rate, float) else rate, extra_leg)})
    netted = extend(charged, {"net_ret": "signal * exec_ret - cost"})
    grown = running(netted, {"_growth": ("product", "1 + net_ret")}, keys)
    floored = extend(grown, {"equity": "greatest(_growth, 1e-6D)"}).drop("_growth")
    peaked = running(floored, {"peak": ("max", "equity")}, keys)
    return extend(peaked, {"underwater": "(equity - peak) / peak"})


def ledger(scores: DataFrame, bars: DataFrame | None = None, rate: float | None = None, parity: bool = False, **options) -> DataFrame:
    """The whole chain from scores and bars to the equity curve; ``bars`` as in ``positions``."""
    held = positions(scores, bars, parity=parity, **options)
    return equity(held, cost_rate() if rate is None else rate, extra_leg=1.0 if parity else 0.0)


def scenario_ledgers(held: DataFrame, scenarios: Sequence[float] = COST_SCENARIOS, extra_leg: float = 0.0) -> DataFrame:
    """One ledger per total cost level in basis points, all in one job.

    The levels run side by side in the rows of one ledger and are parted at the end, so rows are sorted and held once, not once a level.
    """
    rates = {i: (float(level) + impact_bps()) / 10000 for i, level in enumerate(scenarios)}
    charged = extend(held, {f"_cost_{i}": _fee(num(rate), extra_leg) for i, rate in rates.items()})
    netted = extend(charged, {f"_net_{i}": f"signal * exec_ret - _cost_{i}" for i in rates})
    grown = running(netted, {f"_growth_{i}": ("product", f"1 + _net_{i}") for i in rates}, KEYS)
    floored = extend(grown, {f"_equity_{i}": f"greatest(_growth_{i}, 1e-6D)" for i in rates})
    peaked = running(floored, {f"_peak_{i}": ("max", f"_equity_{i}") for i in rates}, KEYS)
    shown = ("total_cost_bps", "_rate", "cost", "net_ret", "equity", "peak")
    values = [(num(scenarios[i]), num(rate), f"_cost_{i}", f"_net_{i}", f"_equity_{i}", f"_peak_{i}") for i, rate in rates.items()]
    cells = [f"struct({', '.join(f'{value} AS {name}' for value, name in zip(cell, shown))})" for cell in values]
    spread = peaked.selectExpr(*[f"`{c}`" for c in held.columns], f"inline(array({', '.join(cells)}))")
    return extend(spread, {"underwater": "(equity - peak) / peak"})


def trade_measures() -> tuple[dict[str, str], tuple[str, ...]]:
    """Aggregates of ``trade_stats`` and the figures made from them."""
    measures = {
        "_trades": "count_if(signal <> coalesce(prev_signal, 0))",
        "_stops": "count_if(stopped)",
        "_turnover": "avg(abs(signal - prev_signal))",
        "_held": "count_if(signal <> 0)",
        "_entries": "count_if(signal <> 0 AND coalesce(prev_signal, 0) = 0)",
        "_wins": "count_if(signal <> 0 AND net_ret > 0)",
        "_won": "coalesce(sum(net_ret) FILTER (WHERE signal <> 0 AND net_ret > 0), 0D)",
        "_lost": "coalesce(abs(sum(net_ret) FILTER (WHERE signal <> 0 AND net_ret < 0)), 0D)",
        "_confident": "avg(double(confident))",
    }
    shown = (
        "_trades AS n_trades",
        "_stops AS n_stopped",
        "coalesce(_turnover, 0D) AS turnover",
        "coalesce(try_divide(_held, _entries), 0D) AS avg_hold",
        "coalesce(try_divide(_wins, _held), 0D) AS win_rate",
        "CASE WHEN _lost > 1e-10D THEN _won / _lost WHEN _wins > 0 THEN double('Infinity') ELSE 1D END AS profit_factor",
        "_confident AS pct_confident",
    )
    return measures, shown


def trade_stats(booked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trades, holding time, turnover, stops, win rate and profit factor."""
    measures, shown = trade_measures()
    return booked.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in measures.items()]).selectExpr(*keys, *shown)
