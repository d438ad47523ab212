"""Panel build: features and labels per series by hooks, split on the shared calendar, cross-sectional normalisation.

A hook takes (rows, keys) and returns the rows with more columns; series are told apart by ``keys``. Hooks written in
DataFrame operations run in the plan like everything else. ``by_series`` makes a hook of a pandas function; each call sees
one series of daily bars, sorted by date, whose size the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from barloom.operators.cross_section import normalise
from barloom.operators.features import FEATURES, build_features
from barloom.operators.quality import drop_non_finite
from barloom.operators.splits import TRAIN, VAL, calendar_split
from barloom.operators.targets import add_targets
from barloom.session import cut_lineage

Hook = Callable[[DataFrame, Sequence[str]], DataFrame]


def feature_hook(columns: Sequence[str] = FEATURES) -> Hook:
    return lambda rows, keys: build_features(rows, columns, keys)


def target_hook(mode: str = "binary", horizons: Sequence[int] = (1, 5, 21)) -> Hook:
    return lambda rows, keys: add_targets(rows, mode, horizons, keys=keys)


def by_series(function: Callable[[pd.DataFrame], pd.DataFrame], columns: Mapping[str, str], skip_failed: bool = False) -> Hook:
    """Hook of a pandas function that adds ``columns`` (name to type) to one series; with ``skip_failed`` a series on which
    it fails is left out (``missing_series`` names it), else the job fails."""

    def hook(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        schema = ", ".join(f"`{c}` {kind}" for c, kind in [*rows.dtypes, *columns.items()])
        names = [*rows.columns, *columns]

        def one(series: pd.DataFrame) -> pd.DataFrame:
            try:
                return function(series.sort_values("date").reset_index(drop=True))[names]
            except Exception:
                if not skip_failed:
                    raise
                return pd.DataFrame(columns=names)

        return rows.groupBy(*keys).applyInPandas(one, schema)

    return hook


def build_panel(
    bars: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    feature_fn: Hook | None = None,
    target_fn: Hook | None = None,
    isolate_splits: bool = False,
    normalisation: str = "zscore",
    min_tickers: int = 3,
    train: float = TRAIN,
    val: float = VAL,
) -> DataFrame:
    """Bars with ``features`` and ``targets`` and their ``split``; rows lacking any of them drop.

    By default windows run over a ticker's whole past and the calendar of the complete rows is split. ``isolate_splits``
    splits the calendar of the bars first and builds features and labels within (ticker, split), so that neither a window
    nor a label crosses a border. Features are normalised per date, hence within a split, among the tickers of that date.
    """
    feature_fn = feature_fn or feature_hook(features)
    target_fn = target_fn or target_hook("binary", [int(t.rsplit("_", 1)[1][:-1]) for t in targets])
    rows, keys = (calendar_split(bars, train, val), ("ticker", "split")) if isolate_splits else (bars, ("ticker",))
    built = target_fn(feature_fn(rows, keys), keys)
    absent = [c for c in [*features, *targets] if c not in built.columns]
    if absent:
        raise ValueError(f"the hooks did not make {absent}")
    base = [c for c in bars.columns if c not in (*features, *targets)]
    clean = drop_non_finite(built.select(*base, *([] if not isolate_splits else ["split"]), *features, *targets), [*features, *targets])
    # the calendar, the per-date figures and the rows all read the built features
    clean = cut_lineage(clean)
    panel = clean if isolate_splits else calendar_split(clean, train, val)
    return normalise(panel, list(features), normalisation, min_tickers).select(*base, "split", *features, *targets)


def missing_series(bars: DataFrame, panel: DataFrame) -> DataFrame:
    """Tickers of ``bars`` without a row in ``panel``: too short, never complete, or failed in a hook."""
    return bars.select("ticker").distinct().join(panel.select("ticker").distinct(), "ticker", "left_anti")
