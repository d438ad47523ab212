"""Forward-looking labels per horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.functions.windows import Axis, extend, in_segments, num

HORIZONS = (1, 5, 21)
LABEL_ROWS = 60


def target_columns(mode: str, horizons: Sequence[int] = HORIZONS) -> list[str]:
    """Names a mode adds, per horizon with the classifier label first. The first name is the primary label."""
    stems = {
        "binary": ("target",),
        "return": ("target_ret",),
        "excess_return": ("target_exc_bin", "target_exc"),
        "rank": ("target_rank_bin", "target_rank"),
    }
    if mode not in stems:
        raise ValueError(f"unknown target mode {mode!r}, expected one of {sorted(stems)}")
    return [f"{stem}_{h}d" for h in horizons for stem in stems[mode]]


def add_targets(
    bars: DataFrame,
    mode: str = "binary",
    horizons: Sequence[int] = HORIZONS,
    threshold: float = 0.0,
    rows: int = LABEL_ROWS,
    parity: bool = False,
    keys: Sequence[str] = ("ticker",),
) -> DataFrame:
    """Add the labels of ``mode``. Bars whose outcome is not known yet get null.

    ``parity=True`` labels such bars 0 in the binary columns instead.
    """
    names = target_columns(mode, horizons)
    least = max(rows // 2, 5)

    def stage(panel: DataFrame, axis: Axis) -> DataFrame:
        forward = {f"_f{h}": f"ln(try_divide({axis.lead('close', h)}, nullif(close, 0D)))" for h in horizons}
        if mode == "binary":
            return extend(panel, {f"target_{h}d": f"double({axis.lead('close', h)} > close)" for h in horizons})
        panel = extend(panel, forward)
        if mode == "return":
            return extend(panel, {f"target_ret_{h}d": f"_f{h}" for h in horizons})
        frame = axis.trailing(rows)
        if mode == "excess_return":
            panel = extend(panel, {f"_w{h}": f"sort_array(collect_list(_f{h}) {frame})" for h in horizons})
            panel = extend(
                panel,
                {
                    f"target_exc_{h}d": f"CASE WHEN size(_w{h}) >= {least} THEN"
                    f" _f{h} - (_w{h}[(size(_w{h}) - 1) div 2] + _w{h}[size(_w{h}) div 2]) / 2 END"
                    for h in horizons
                },
            )
            return extend(
                panel, {f"target_exc_bin_{h}d": f"double(target_exc_{h}d > {num(threshold)})" for h in horizons}
            )
        panel = extend(
            panel,
            {f"_w{h}": f"CASE WHEN _f{h} IS NOT NULL THEN collect_list(_f{h}) {frame} END" for h in horizons},
        )
        panel = extend(
            panel,
            {
                f"target_rank_{h}d": f"CASE WHEN size(_w{h}) >= {least} THEN (size(filter(_w{h}, x -> x < _f{h}))"
                f" + (size(filter(_w{h}, x -> x = _f{h})) + 1) / 2D) / size(_w{h}) END"
                for h in horizons
            },
        )
        return extend(panel, {f"target_rank_bin_{h}d": f"double(target_rank_{h}d > 0.5D)" for h in horizons})

    labelled = in_segments(bars, stage, back=rows, ahead=max(horizons), keys=keys)
    shown = [f"coalesce({c}, 0D) AS {c}" if parity and ("_bin_" in c or mode == "binary") else c for c in names]
    return labelled.selectExpr(*[f"`{c}`" for c in bars.columns], *shown)
