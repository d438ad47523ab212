"""Bar cleaning: names, types, duplicates, gaps, consistency rules, minimum history, audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import extend, in_segments, running
from barloom.sources.bars import FIELDS, PRICES

# Accepted spellings per canonical field, compared after trimming and lower-casing.
ALIASES: Mapping[str, tuple[str, ...]] = {
    "open": ("open",),
    "high": ("high",),
    "low": ("low",),
    "close": ("close", "adj close", "adj_close"),
    "volume": ("volume", "vol"),
}
MAX_GAP = 5
JUMP_LIMIT = 0.40
MIN_BARS = 252


def normalise_columns(df: DataFrame, keep: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Project to the key columns and the five canonical fields; two sources for one field are an error."""
    chosen = {}
    for field, spellings in ALIASES.items():
        matches = [c for c in df.columns if c.strip().lower() in spellings]
        if len(matches) != 1:
            raise ValueError(f"field {field!r} needs exactly one source column, found {matches}")
        chosen[field] = matches[0]
    return df.select(*keep, *[F.col(f"`{source}`").alias(field) for field, source in chosen.items()])


def enforce_dtypes(df: DataFrame) -> DataFrame:
    """Cast the fields to double; tokens that are no number (and NaN) become null."""
    return df.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in FIELDS})


def bad_token_audit(df: DataFrame) -> DataFrame:
    """Per ticker and field: values that were present but are not numbers."""
    counts = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in FIELDS]
    return df.groupBy("ticker").agg(*counts)


def dedupe_keep_last(df: DataFrame, arrival: str = "ingest_seq") -> DataFrame:
    """One row per (ticker, date): the one that arrived last. Aggregates, so a hot key combines map-side."""
    payload = [c for c in df.columns if c not in ("ticker", "date")]
    newest = F.max_by(F.struct(*payload), F.col(arrival)).alias("row")
    return df.groupBy("ticker", "date").agg(newest).select("ticker", "date", "row.*")


def null_audit(df: DataFrame) -> DataFrame:
    """Per ticker: null count of each field, and rows with all or only some fields null."""
    flags = [F.col(c).isNull() for c in FIELDS]
    every, some = reduce(Column.__and__, flags), reduce(Column.__or__, flags)
    return df.groupBy("ticker").agg(
        *[F.count_if(flag).alias(f"null_{c}") for c, flag in zip(FIELDS, flags)],
        F.count_if(every).alias("rows_all_null"),
        F.count_if(some & ~every).alias("rows_some_null"),
    )


def flag_long_gaps(df: DataFrame, max_fill: int = MAX_GAP) -> DataFrame:
    """Add ``long_gap``: the row lies in a run of more than ``max_fill`` nulls of some field.

    A row is in such a run exactly when some window of ``max_fill + 1`` rows around it is all null, so a
    bounded frame decides it and no run has to be collected.
    """
    size = max_fill + 1

    def stage(panel: DataFrame, axis) -> DataFrame:
        frame = axis.trailing(size)
        following = axis.over(f"ROWS BETWEEN CURRENT ROW AND {max_fill} FOLLOWING")
        full = {f"_full_{c}": f"count({c}) {frame} = 0 AND count(1) {frame} = {size}" for c in FIELDS}
        hit = " OR ".join(f"max({name}) {following}" for name in full)
        return extend(extend(panel, full), {"long_gap": hit}).drop(*full)

    return in_segments(df, stage, back=max_fill, ahead=max_fill)


def drop_long_gaps(df: DataFrame, max_fill: int = MAX_GAP) -> DataFrame:
    return flag_long_gaps(df, max_fill).where(~F.col("long_gap")).drop("long_gap")


def ffill_then_bfill(df: DataFrame) -> DataFrame:
    """Fill each field from the previous bar, the head from the first value; drop rows still incomplete.

    The head fill looks ahead in time, but only before a ticker's first complete bar.
    """
    filled = running(
        df.withColumn("_year", F.year("date")),
        {f"_f_{c}": ("last", c) for c in FIELDS},
        bucket="_year",
        order=("date",),
    )
    heads = {c: f"min_by({c}, CASE WHEN {c} IS NOT NULL THEN date END) OVER (PARTITION BY ticker)" for c in FIELDS}
    filled = extend(filled, {f"_h_{c}": text for c, text in heads.items()})
    return filled.selectExpr(
        *[c for c in df.columns if c not in FIELDS], *[f"coalesce(_f_{c}, _h_{c}) AS {c}" for c in FIELDS]
    ).dropna(subset=list(FIELDS))


def rejection_reason() -> Column:
    """First consistency rule a bar breaks, or null. Order matters for the audit."""
    o, h, l, c, v = (F.col(name) for name in FIELDS)
    return (
        F.when(F.least(o, h, l, c) <= 0, "non_positive_price")
        .when(h < l, "inverted_range")
        .when(~o.between(l, h), "open_outside_range")
        .when(~c.between(l, h), "close_outside_range")
        .when(v < 0, "negative_volume")
        .when(v == 0, "zero_volume")
    )


def drop_inconsistent(df: DataFrame) -> DataFrame:
    return df.where(rejection_reason().isNull())


def flag_jumps(df: DataFrame, limit: float = JUMP_LIMIT) -> DataFrame:
    """Add ``jump``: the close moved by more than ``limit`` from the previous surviving bar. Nothing drops."""

    def stage(panel: DataFrame, axis) -> DataFrame:
        move = f"abs(try_divide(close, {axis.lag('close')}) - 1)"
        return extend(panel, {"jump": f"coalesce({move} > {limit}, false)"})

    return in_segments(df, stage, back=1)


def jump_report(flagged: DataFrame, first: int = 5) -> DataFrame:
    """Per ticker: number of jumps and the earliest dates.

    Dates are first cut to the earliest per calendar year, so the collected list stays small.
    """
    jumps = flagged.where("jump").withColumn("_year", F.year("date"))
    counts = jumps.groupBy("ticker").agg(F.count(F.lit(1)).alias("jumps"))
    per_year = jumps.groupBy("ticker", "_year").agg(
        F.slice(F.array_sort(F.collect_list("date")), 1, first).alias("dates")
    )
    heads = per_year.groupBy("ticker").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("dates"))), 1, first).alias("first_dates")
    )
    return counts.join(heads, "ticker")


def drop_short_histories(df: DataFrame, min_rows: int = MIN_BARS) -> DataFrame:
    counted = extend(df, {"_n": "count(1) OVER (PARTITION BY ticker)"})
    return counted.where(F.col("_n") >= min_rows).drop("_n")


def drop_non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` are all there: null, NaN and infinite values count as missing.

    One condition per column: a single condition over all columns would be rewritten by the optimizer once for every subset
    of renamed columns.
    """
    kinds = dict(df.dtypes)
    for c in columns:
        fine = f"abs(`{c}`) < double('Infinity')" if kinds[c] in ("double", "float") else f"`{c}` IS NOT NULL"
        df = df.where(fine)
    return df


def complete_bars(raw: DataFrame, arrival: str = "ingest_seq") -> DataFrame:
    """Names, types, duplicates and gaps: everything before the consistency rules."""
    named = normalise_columns(raw, keep=("ticker", "date", arrival))
    unique = dedupe_keep_last(enforce_dtypes(named), arrival).drop(arrival)
    return ffill_then_bfill(drop_long_gaps(unique))


def validate_bars(raw: DataFrame, arrival: str = "ingest_seq", min_rows: int = MIN_BARS) -> DataFrame:
    """The whole cleaning chain, whatever source ``raw`` came from."""
    return drop_short_histories(drop_inconsistent(complete_bars(raw, arrival)), min_rows)


def quality_audit(complete: DataFrame, min_rows: int = MIN_BARS) -> DataFrame:
    """(ticker, reason, n) over bars that passed ``complete_bars``; reason ``kept`` counts clean bars.

    Tickers with fewer clean bars than ``min_rows`` get a ``short_history`` row instead of ``kept``.
    """
    counted = (
        complete.withColumn("reason", F.coalesce(rejection_reason(), F.lit("kept")))
        .groupBy("ticker", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    short = (F.col("reason") == "kept") & (F.col("n") < min_rows)
    return counted.withColumn("reason", F.when(short, "short_history").otherwise(F.col("reason")))


def run_audit(raw: DataFrame, arrival: str = "ingest_seq", min_rows: int = MIN_BARS) -> DataFrame:
    """One row per ticker that accounts for every raw row.

    ``raw_rows`` = ``duplicates`` + ``long_gap`` + ``unfilled`` (a field without any value to fill it) + ``inconsistent`` +
    ``clean``; ``kept`` is ``clean``, or 0 for a history under ``min_rows``. ``jumps`` counts suspicious moves among
    clean bars, which stay. Each step is counted by an aggregation with one row per ticker.
    """
    named = enforce_dtypes(normalise_columns(raw, keep=("ticker", "date", arrival)))
    flagged = flag_long_gaps(dedupe_keep_last(named, arrival).drop(arrival))
    complete = ffill_then_bfill(flagged.where(~F.col("long_gap")).drop("long_gap"))
    clean = flag_jumps(drop_inconsistent(complete))
    one, none = F.lit(1), F.lit(0)
    steps = (
        (named, {"raw_rows": one}),
        (flagged, {"_unique": one, "long_gap": F.col("long_gap").cast("int")}),
        (complete, {"_complete": one}),
        (clean, {"clean": one, "jumps": F.col("jump").cast("int")}),
    )
    counts = [name for _, measures in steps for name in measures]
    parts = [
        step.groupBy("ticker").agg(*[F.sum(measures.get(name, none)).alias(name) for name in counts])
        for step, measures in steps
    ]
    totals = reduce(DataFrame.unionByName, parts).groupBy("ticker").agg(*[F.sum(name).alias(name) for name in counts])
    return totals.selectExpr(
        "ticker", "raw_rows", "raw_rows - _unique AS duplicates", "long_gap", "_unique - long_gap - _complete AS unfilled",
        "_complete - clean AS inconsistent", "clean", f"CASE WHEN clean < {min_rows} THEN 0L ELSE clean END AS kept", "jumps",
    )
