"""Ordered-window building blocks that stay bounded however long one key's history is.

A window partitioned by ticker puts a whole series in one task. For daily bars that is bounded by the schema:
``date`` is a DATE and unique per key, so a series has at most 366 rows a year, whatever share of the raw trades
its ticker had. Such series run in plain windows, and chained stages share one shuffle.

Any other ordering column (timestamps) gives no such bound. Its series are cut in two exact ways:

* ``in_segments`` runs finite look-back / look-ahead windows on ``(key, segment)``. A segment is a fixed
  number of consecutive rows; the rows just before (and after) it are replicated into it as a halo, so
  every window sees what it would see on the uncut series.
* ``running`` computes unbounded running sums, products, maxima and last values with a two-level scan:
  scan inside each bucket, scan the per-bucket totals, combine.

Expressions are SQL text: one parsed projection per stage builds a plan of hundreds of columns far faster
than the same number of Column objects.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = "1e-9D"
SEGMENT_ROWS = 8192
EWM_BLOCK = 512
# Rows after which the slowest built-in smoothing (alpha = 1/21) weighs less than 1e-17.
EWM_HALO = 1280


def num(value: float) -> str:
    """Double literal (a bare ``1.0`` would be a decimal in SQL text)."""
    return f"{float(value)!r}D"


def extend(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns given as SQL text."""
    if not columns:
        return df
    return df.selectExpr("*", *[f"{text} AS `{name}`" for name, text in columns.items()])


def replace(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Redefine existing columns and append new ones, keeping the column order."""
    kept = [f"{columns[c]} AS `{c}`" if c in columns else f"`{c}`" for c in df.columns]
    return df.selectExpr(*kept, *[f"{text} AS `{c}`" for c, text in columns.items() if c not in df.columns])


class Axis(NamedTuple):
    """Partition keys and ordering shared by all windows of one stage."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def over(self, frame: str = "") -> str:
        return f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {', '.join(self.order)} {frame})"

    def trailing(self, rows: int) -> str:
        return self.over(f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW")

    def history(self) -> str:
        return self.over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

    def lag(self, value: str, rows: int = 1) -> str:
        return f"lag({value}, {rows}) {self.over()}"

    def lead(self, value: str, rows: int = 1) -> str:
        return f"lead({value}, {rows}) {self.over()}"

    def roll(self, aggregate: str, value: str, rows: int, min_rows: int | None = None) -> str:
        """Trailing aggregate that is null until ``min_rows`` (default ``rows``) non-null values are in."""
        needed = rows if min_rows is None else min_rows
        frame = self.trailing(rows)
        return f"CASE WHEN count({value}) {frame} >= {needed} THEN {aggregate}({value}) {frame} END"


def is_daily(df: DataFrame, order: str = "date") -> bool:
    """True when a series cannot have more rows than calendar days."""
    return dict(df.dtypes).get(order) == "date"


def with_position(
    df: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date", bucket: str = "year({order})"
) -> DataFrame:
    """Add ``pos`` (0-based rank in the series) and ``n`` (series length).

    Series that are not daily are ranked in two levels: inside a calendar bucket, then shifted by the row
    counts of earlier buckets, so no task holds more than one bucket of one key. The bucket table has one row
    per key and calendar year.
    """
    names = ", ".join(keys)
    if is_daily(df, order):
        rank = f"row_number() OVER (PARTITION BY {names} ORDER BY {order}) - 1"
        return extend(df, {"pos": f"bigint({rank})", "n": f"count(1) OVER (PARTITION BY {names})"})
    bucketed = extend(df, {"_bucket": bucket.format(order=order)})
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .count()
        .selectExpr(
            *keys,
            "_bucket",
            f"coalesce(sum(count) OVER (PARTITION BY {names} ORDER BY _bucket "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset",
            f"sum(count) OVER (PARTITION BY {names}) AS n",
        )
    )
    local = extend(bucketed, {"_local": f"row_number() OVER (PARTITION BY {names}, _bucket ORDER BY {order})"})
    return local.join(offsets, [*keys, "_bucket"]).selectExpr(*df.columns, "_offset + _local - 1 AS pos", "n")


def split_segments(positioned: DataFrame, back: int = 0, ahead: int = 0, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Assign ``seg``; replicate the last ``back`` rows before and first ``ahead`` rows after each segment.

    Replicas carry ``halo = true``. ``blk`` numbers blocks of ``EWM_BLOCK`` rows and leads the sort order so
    that block scans and row frames share one sort.
    """
    spread = positioned.selectExpr(
        "*",
        f"explode(sequence(greatest(pos - {ahead}, 0) div {rows}, least(pos + {back}, n - 1) div {rows})) AS seg",
    )
    return extend(spread, {"halo": f"seg <> pos div {rows}", "blk": f"pos div {EWM_BLOCK}"})


ROW_ORDER = ("blk", "pos")


def in_segments(
    df: DataFrame,
    stage: Callable[[DataFrame, Axis], DataFrame],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = ("ticker",),
    order: str = "date",
    rows: int | None = None,
    keep: bool = False,
    blocks: bool = True,
    by: str = "pos",
) -> DataFrame:
    """Apply ``stage(df, axis)`` to whole daily series or to halo-extended segments; returns the input's rows.

    ``rows`` forces segments of that length.

    ``keep`` leaves ``pos``, ``n`` and ``seg`` on the result; a frame that already has ``pos`` and ``n`` is
    not ranked again. Without ``blocks`` (no exponential means) a daily series is ordered by ``by`` alone: by ``pos`` as in
    ``running``, or by the date as in the ranking, so that both share one sort.
    """
    positioned = df if {"pos", "n"} <= set(df.columns) else with_position(df, keys, order)
    if rows is None and is_daily(df, order):
        whole = extend(positioned, {"blk": f"pos div {EWM_BLOCK}"}) if blocks else positioned
        kept = stage(whole, Axis(tuple(keys), ROW_ORDER if blocks else (by,))).drop("blk")
        return extend(kept, {"seg": "0L"}) if keep else kept.drop("pos", "n")
    segments = split_segments(positioned, back, ahead, rows or SEGMENT_ROWS)
    staged = stage(segments, Axis((*keys, "seg"), ROW_ORDER))
    kept = staged.where("NOT halo").drop("halo", "blk")
    return kept if keep else kept.drop("pos", "n", "seg")


def _scan(kind: str, column: str) -> Column:
    if kind == "product":
        return F.product(F.col(column))
    return F.expr(f"last({column}, true)" if kind == "last" else f"{kind}({column})")


def _bucket_total(kind: str, column: str, sequence: str) -> Column:
    if kind == "last":
        return F.expr(f"max_by({column}, CASE WHEN {column} IS NOT NULL THEN struct({sequence}) END)")
    return _scan(kind, column)


# How the value inside a bucket and the value carried into it combine.
_COMBINE = {
    "sum": "coalesce({here} + {carry}, {here}, {carry}, 0)",
    "product": "coalesce({here} * {carry}, {here}, {carry}, 1)",
    "max": "greatest({here}, {carry})",
    "min": "least({here}, {carry})",
    "last": "coalesce({here}, {carry})",
}


def running(
    df: DataFrame,
    specs: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = ("ticker",),
    bucket: str = "seg",
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Running aggregates over whole series: ``specs`` maps output name to ``(kind, input)``.

    ``kind`` is sum, product, max, min or last (the last non-null value). ``bucket`` must be non-decreasing
    along ``order``; daily series need no buckets.
    """
    if is_daily(df):
        prepared = extend(df, {f"_x_{name}": source for name, (_, source) in specs.items()})
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        scans = {name: _scan(kind, f"_x_{name}").over(whole) for name, (kind, _) in specs.items()}
        return prepared.withColumns(scans).drop(*[f"_x_{name}" for name in specs])
    sequence = ", ".join(order)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    prepared = extend(df, {f"_x_{name}": source for name, (_, source) in specs.items()})
    totals = prepared.groupBy(*keys, bucket).agg(
        *[_bucket_total(kind, f"_x_{name}", sequence).alias(f"_t_{name}") for name, (kind, _) in specs.items()]
    )
    carried = totals.select(
        *keys, bucket, *[_scan(kind, f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in specs.items()]
    )
    local = prepared.withColumns(
        {f"_l_{name}": _scan(kind, f"_x_{name}").over(inside) for name, (kind, _) in specs.items()}
    )
    outputs = [
        f"{_COMBINE[kind].format(here=f'_l_{name}', carry=f'_c_{name}')} AS `{name}`"
        for name, (kind, _) in specs.items()
    ]
    return local.join(carried, [*keys, bucket]).selectExpr(*[f"`{c}`" for c in df.columns], *outputs)


def ewm_columns(axis: Axis, specs: Mapping[str, tuple[str, float, int]]) -> dict[str, str]:
    """Recursive exponential means ``y = (1-alpha) y[-1] + alpha x`` without a recursion.

    ``specs`` maps output name to ``(x, alpha, first)``; ``first`` is the position of the first non-null x,
    which enters with weight 1. Rows are cut in blocks: a running sum of rescaled x gives the part inside the
    block, and the totals of the preceding blocks, decayed by whole blocks, give the rest. Blocks beyond the
    point where the decay falls under double precision are left out. Needs ``pos`` and ``blk``.
    """
    names = ", ".join(axis.keys)
    inside = f"OVER (PARTITION BY {names}, blk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    offset = f"(pos % {EWM_BLOCK})"
    columns = {}
    for name, (value, alpha, first) in specs.items():
        decay = 1.0 - alpha
        if decay <= 10.0 ** (-290.0 / EWM_BLOCK):
            raise ValueError(f"alpha={alpha} decays too fast for blocks of {EWM_BLOCK} rows")
        q = num(decay)
        weighted = f"CASE WHEN pos = {first} THEN {value} WHEN pos > {first} THEN {value} * {num(alpha)} END"
        local = f"sum(({weighted}) * pow({q}, -{offset})) {inside} * pow({q}, {offset})"
        carried = []
        for m in range(1, math.ceil(37.0 / (-EWM_BLOCK * math.log(decay))) + 1):
            block = f"OVER (PARTITION BY {names} ORDER BY blk RANGE BETWEEN {m} PRECEDING AND {m} PRECEDING)"
            total = f"sum(({weighted}) * pow({q}, {EWM_BLOCK - 1} - {offset})) {block}"
            carried.append(f"coalesce({total}, 0D) * {num(decay ** (EWM_BLOCK * (m - 1)))}")
        columns[name] = (
            f"CASE WHEN pos >= {first} THEN {local} + pow({q}, {offset} + 1) * ({' + '.join(carried)}) END"
        )
    return columns


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def period_alpha(period: int) -> float:
    """Smoothing of a centre of mass ``period - 1``."""
    return 1.0 / period
