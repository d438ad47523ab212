"""Rolling sums, deviations, extrema and co-moments in a logarithmic number of steps.

A framed window aggregate visits every row of its frame again for every output row. Here a window of 2^(j+1)
rows is put together from two windows of 2^j rows with one ``lag`` each, and a window of k rows from the
windows in k's binary expansion. Nothing is ever subtracted, so sums and deviations keep full precision, and full
constant windows have a deviation of exactly zero.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame

from barloom.functions.windows import Axis, extend


class Roll(NamedTuple):
    """One rolling statistic. ``first`` is the position of the first non-null value of ``series``.

    ``stat`` is sum, m2 (sum of squared deviations), max, min or co (co-moment of ``series`` and ``other``).
    """

    stat: str
    series: str
    rows: int
    first: int = 0
    other: str = ""

    @property
    def name(self) -> str:
        return f"_{self.stat}_{self.series}_{self.other}_{self.rows}"


def roll_count(request: Roll) -> str:
    """Non-null values in the window."""
    return f"greatest(least(pos + {1 - request.first}, {request.rows}), 0)"


def roll_mean(request: Roll) -> str:
    return f"try_divide({request.name}, {roll_count(request)})"


def roll_std(request: Roll) -> str:
    """Sample standard deviation; null with fewer than two values."""
    return f"sqrt(try_divide({request.name}, nullif({roll_count(request)}, 0) - 1))"


def roll_when_full(request: Roll, value: str, min_rows: int | None = None) -> str:
    needed = request.rows if min_rows is None else min_rows
    return f"CASE WHEN pos >= {needed + request.first - 1} THEN {value} END"


def _available(first: int, used: int, size: int) -> str:
    """Values in a window of ``size`` rows that ends ``used`` rows back."""
    return f"greatest(least(pos + {1 - first - used}, {size}), 0)"


def _between(sum_a: str, count_a: str, sum_b: str, count_b: str) -> str:
    """Squared gap between the means of two windows, weighted; null when one of them is empty."""
    gap = f"(try_divide({sum_a}, {count_a}) - try_divide({sum_b}, {count_b}))"
    return f"coalesce({gap} * {gap} * try_divide({count_a} * {count_b}, {count_a} + {count_b}), 0D)"


def _parts(rows: int) -> list[tuple[int, int]]:
    """(level, offset) of the power-of-two windows that tile ``rows`` rows, newest first."""
    tiles, offset = [], 0
    for level in reversed(range(rows.bit_length())):
        if rows >> level & 1:
            tiles.append((level, offset))
            offset += 1 << level
    return tiles


def rolling(panel: DataFrame, axis: Axis, requests: Iterable[Roll]) -> DataFrame:
    """Add one column per request (named ``request.name``); needs ``pos``."""
    requests = sorted(set(requests))
    if not requests:
        return panel
    original = [f"`{c}`" for c in panel.columns]
    firsts: dict[str, int] = {}
    tops: dict[tuple[str, str, str], int] = {}
    for request in requests:
        level = request.rows.bit_length() - 1
        parts = [(request.stat, request.series, request.other)]
        if request.stat in ("m2", "co"):
            parts.append(("sum", request.series, ""))
        if request.stat == "co":
            parts.append(("sum", request.other, ""))
        for part in parts:
            tops[part] = max(tops.get(part, 0), level)
        firsts[request.series] = request.first

    def at(key: tuple[str, str, str], level: int) -> str:
        return f"_{level}{''.join(key)}"

    def back(key: tuple[str, str, str], level: int, rows: int) -> str:
        value = axis.lag(at(key, level), rows) if rows else at(key, level)
        return value if key[0] in ("max", "min") else f"coalesce({value}, 0D)"

    start = {"sum": "coalesce(double({0}), 0D)", "m2": "0D", "co": "0D", "max": "{0}", "min": "{0}"}
    panel = extend(panel, {at(key, 0): start[key[0]].format(key[1]) for key in tops})

    for level in range(max(tops.values())):
        half = 1 << level
        growing = [key for key, top in tops.items() if top > level]
        lagged = {f"_b{level}{''.join(key)}": back(key, level, half) for key in growing}
        panel = extend(panel, lagged)
        grown = {}
        for key in growing:
            stat, series, other = key
            a, b = at(key, level), f"_b{level}{''.join(key)}"
            own, mate = ("sum", series, ""), ("sum", other, "")
            if stat in ("max", "min"):
                value = f"{'greatest' if stat == 'max' else 'least'}({a}, {b})"
            else:
                value = f"{a} + {b}"
            if stat == "m2":
                first = firsts[series]
                value += " + " + _between(
                    at(own, level), _available(first, 0, half),
                    f"_b{level}{''.join(own)}", _available(first, half, half),
                )
            if stat == "co":
                gaps = [f"({at(x, level)} - _b{level}{''.join(x)}) / {half}D" for x in (own, mate)]
                value += f" + {gaps[0]} * {gaps[1]} * {half / 2}D"
            grown[at(key, level + 1)] = value
        panel = extend(panel, grown)

    tiles: dict[str, str] = {}
    outputs: dict[str, str] = {}

    def tile(key: tuple[str, str, str], level: int, offset: int) -> str:
        if offset == 0:
            return at(key, level)
        name = f"_t{level}_{offset}{''.join(key)}"
        tiles[name] = back(key, level, offset)
        return name

    for request in requests:
        key = (request.stat, request.series, request.other)
        if request.stat in ("max", "min"):
            level = request.rows.bit_length() - 1
            pick = "greatest" if request.stat == "max" else "least"
            rest = request.rows - (1 << level)
            newest = at(key, level)
            outputs[request.name] = f"{pick}({newest}, {tile(key, level, rest)})" if rest else newest
            continue
        own, mate = ("sum", request.series, ""), ("sum", request.other, "")
        terms, done, sums, mates = [], 0, [], []
        for level, offset in _parts(request.rows):
            size = 1 << level
            terms.append(tile(key, level, offset))
            if request.stat == "m2":
                added = tile(own, level, offset)
                if sums:
                    terms.append(
                        _between(
                            f"({' + '.join(sums)})", _available(request.first, 0, done),
                            added, _available(request.first, done, size),
                        )
                    )
                sums.append(added)
            if request.stat == "co":
                added, other = tile(own, level, offset), tile(mate, level, offset)
                if sums:
                    terms.append(
                        f"(({' + '.join(sums)}) / {done}D - {added} / {size}D)"
                        f" * (({' + '.join(mates)}) / {done}D - {other} / {size}D)"
                        f" * {done * size / (done + size)!r}D"
                    )
                sums.append(added)
                mates.append(other)
            done += size
        outputs[request.name] = " + ".join(terms)
    panel = extend(panel, tiles)
    return panel.selectExpr(*original, *[f"{text} AS {name}" for name, text in outputs.items()])
