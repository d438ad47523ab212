"""Temporal splits, purged walk-forward folds, label weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import extend, num, with_position
from barloom.operators.alignment import calendar

TRAIN, VAL = 0.70, 0.15
FALLBACK = (0.60, 0.80)
INNER_FOLDS = 5
SPLITS = ("train", "val", "test")


def _positioned(df: DataFrame) -> DataFrame:
    return df if {"pos", "n"} <= set(df.columns) else with_position(df)


def position_split(bars: DataFrame, train: float = TRAIN, val: float = VAL, min_rows: int = 300) -> DataFrame:
    """Add ``split`` by each ticker's own bar positions.

    Short histories (validation or test under ``min_rows``) shift to 70 % training and a validation part of at
    most 15 %.
    """
    short = f"int(n * {num(val)}) < {min_rows} OR int(n * {num(1.0 - train - val)}) < {min_rows}"
    squeezed = f"least(greatest((n - int(n * 0.7D)) div 2, {min_rows}) / double(n), 0.15D)"
    ends = extend(
        _positioned(bars),
        {
            "_train_end": f"CASE WHEN {short} THEN int(n * 0.7D) ELSE int(n * {num(train)}) END",
            "_val_end": f"CASE WHEN {short} THEN int(n * (0.7D + {squeezed})) ELSE int(n * {num(train + val)}) END",
        },
    )
    return _labelled(ends, bars.columns)


def _labelled(ends: DataFrame, columns: Sequence[str]) -> DataFrame:
    label = "CASE WHEN pos < _train_end THEN 'train' WHEN pos < _val_end THEN 'val' ELSE 'test' END AS split"
    return ends.selectExpr(*columns, label)


def fallback_split(bars: DataFrame) -> DataFrame:
    """60/20/20 by position."""
    ends = {"_train_end": f"int(n * {num(FALLBACK[0])})", "_val_end": f"int(n * {num(FALLBACK[1])})"}
    return _labelled(extend(_positioned(bars), ends), bars.columns)


def split_cleaned(bars: DataFrame, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Split, ``prepare`` (features, labels, null drop), and redo tickers with an empty part at 60/20/20.

    Tickers still lacking a part are left out.
    """
    first = prepare(position_split(bars))
    whole = _complete(first)
    second = prepare(fallback_split(bars.join(whole, "ticker", "left_anti")))
    return first.join(whole, "ticker", "left_semi").unionByName(second.join(_complete(second), "ticker", "left_semi"))


def _complete(df: DataFrame) -> DataFrame:
    counted = df.groupBy("ticker").agg(F.countDistinct("split").alias("_parts"))
    return counted.where(F.col("_parts") == len(SPLITS)).select("ticker")


def calendar_split(panel: DataFrame, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """Add ``split`` by the calendar shared by all tickers, so the parts are disjoint in time."""
    days = calendar(panel)
    numbered = extend(days.withColumn("_days", days.select(F.count(F.lit(1))).scalar()), {
        "split": f"CASE WHEN day < int(_days * {num(train)}) THEN 'train'"
        f" WHEN day < int(_days * {num(train + val)}) THEN 'val' ELSE 'test' END"
    })
    return panel.join(numbered.select("date", "split"), "date")


def expanding_folds(
    bars: DataFrame, walks: int = 8, purge: int = 5, seq_len: int = 50, horizon: int = 1
) -> DataFrame:
    """Per ticker: fold bounds as bar positions. Train is [0, train_end), test [test_start, test_end)."""
    lengths = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return _fold_bounds(lengths, ["ticker"], walks, purge, seq_len, horizon)


def _fold_bounds(
    lengths: DataFrame, keep: Sequence[str], walks: int, purge: int, seq_len: int, horizon: int
) -> DataFrame:
    """Arithmetic on the series length; short series get no fold."""
    gap, base = max(purge, seq_len + horizon), max(300, 4 * seq_len)
    sized = extend(lengths, {"_width": f"greatest((n - {base + gap}) div {walks}, 20)"})
    last = f"least({walks} - 1, (n - {base + gap} - _width) div _width)"
    return (
        sized.where(f"n >= {base + gap} + _width")
        .selectExpr(*keep, "_width", f"explode(sequence(0, int({last}))) AS fold")
        .selectExpr(
            *keep,
            "fold + 1 AS fold",
            f"{base} + fold * _width AS train_end",
            f"{base + gap} + fold * _width AS test_start",
            f"{base + gap} + (fold + 1) * _width AS test_end",
            f"{gap} AS gap",
            f"{gap >= seq_len + horizon} AS is_clean",
        )
    )


def fold_members(
    bars: DataFrame, walks: int = 8, purge: int = 5, seq_len: int = 50, horizon: int = 1, min_test: int = 10
) -> DataFrame:
    """Bars with ``fold`` and ``role`` (train, purge, test); a bar trains every later fold.

    Bounds follow from the series length each row already carries, so no range join is needed.
    """
    positioned = _positioned(bars)
    placed = _fold_bounds(positioned, [*bars.columns, "pos"], walks, purge, seq_len, horizon)
    role = "CASE WHEN pos < train_end THEN 'train' WHEN pos < test_start THEN 'purge' ELSE 'test' END"
    return placed.where(f"pos < test_end AND test_end - test_start >= {min_test}").selectExpr(
        *bars.columns, "pos", "fold", f"{role} AS role", "is_clean"
    )


def inner_folds(train: DataFrame, folds: int = INNER_FOLDS) -> DataFrame:
    """Expanding prefixes for feature scoring: each row with every ``fold`` whose prefix contains it.

    A series shorter than two least prefixes is scored once, whole, as fold 0.
    """
    size = f"(n div {folds + 1})"
    single = f"({folds} <= 1 OR n < 2 * greatest({size}, 100))"
    positioned = _positioned(train)
    many = positioned.selectExpr("*", f"explode(sequence(0, CASE WHEN {single} THEN 0 ELSE {folds - 1} END)) AS fold")
    cut = f"CASE WHEN {single} THEN n ELSE least(greatest({size}, 100) + (fold + 1) * {size}, n) END"
    return many.where(f"pos < {cut}").select(*train.columns, "fold")


def early_stop_rows(train: DataFrame, share: float = 0.15) -> DataFrame:
    """Add ``is_validation``: the last ``share`` of each ticker's training rows."""
    return _positioned(train).selectExpr(*train.columns, f"pos >= n - int(n * {num(share)}) AS is_validation")


def stack_slices(scored: DataFrame) -> DataFrame:
    """Add ``slice``: the first half (at least 32 rows) fits the stack, the rest evaluates it."""
    return extend(scored, {"slice": "CASE WHEN pos < greatest(n div 2, 32) THEN 'stack' ELSE 'eval' END"})


def time_slices(scored: DataFrame) -> DataFrame:
    """Add ``slice`` by thirds of each series: ``fit`` for a meta-model, ``weigh`` for weights and calibration, ``predict``
    for what they are applied to, so that nothing is applied to bars it was fitted on or that came before those."""
    return extend(
        scored, {"slice": "CASE WHEN pos < n div 3 THEN 'fit' WHEN pos < 2 * n div 3 THEN 'weigh' ELSE 'predict' END"}
    )


def class_weights(labels: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Balanced weights per class; 1 for both when a class is missing."""
    counted = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    both = "n_pos > 0 AND n_pos < n"
    return counted.selectExpr(
        *keys,
        f"CASE WHEN {both} THEN n / (2D * (n - n_pos)) ELSE 1D END AS weight_0",
        f"CASE WHEN {both} THEN n / (2D * n_pos) ELSE 1D END AS weight_1",
    )


def positive_weight(labels: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive. Labels other than 0/1 count as positive above 0."""
    counted = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) > 0).alias("n_pos"),
    )
    return counted.selectExpr(*keys, "CASE WHEN n_pos > 0 THEN (n - n_pos) / double(n_pos) ELSE 1D END AS pos_weight")


def class_balance(labels: DataFrame, label: str, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Share of positive labels in per cent and whether it is off balance by more than five points."""
    share = labels.groupBy(*keys).agg(F.avg(label).alias("_share"))
    return share.selectExpr(*keys, "_share * 100 AS up_pct", "abs(_share * 100 - 50) > 5 AS imbalanced")
