"""Exact ranks, quantiles and area statistics without sorting a whole group in one task.

``rank_table`` collapses equal values first (with map-side partial counts), ranks the distinct values inside
value buckets and shifts them by the counts of lower buckets. Bucket limits come from the number itself
(sign, octave, 1/1024 of an octave), so they are the same whenever and wherever they are computed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 1024


def value_bucket(value: Column) -> Column:
    """Monotone integer bucket of a double."""
    magnitude = F.floor((F.log2(F.abs(value)) + 1100) * BUCKETS_PER_OCTAVE)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * magnitude).cast("long")


def rank_table(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None, bounded: bool = False
) -> DataFrame:
    """One row per key and distinct non-null value with ``cnt``, ``below`` and ``n``.

    ``below`` is the number of rows with a smaller value. Every ``sums`` entry adds its total for the value
    (``name``), the total over smaller values (``below_name``) and over the key (``all_name``).

    ``bounded`` is for keys whose rows are few by the schema (daily series): each is ranked by one window where it lies, without
    buckets, joins or a second reading of the input.
    """
    keys = list(keys)
    measures = {"cnt": F.count(F.lit(1))}
    measures.update({name: F.sum(column) for name, column in (sums or {}).items()})
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value)
        .agg(*[agg.alias(name) for name, agg in measures.items()])
    )
    if bounded:
        counted = counted.where(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))  # as in the join below
        smaller = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        names = {name: ("below", "n") if name == "cnt" else (f"below_{name}", f"all_{name}") for name in measures}
        return counted.withColumns(
            {below: F.coalesce(F.sum(name).over(smaller), F.lit(0)) for name, (below, _) in names.items()}
        ).withColumns({every: F.sum(name).over(Window.partitionBy(*keys)) for name, (_, every) in names.items()})
    distinct = counted.withColumn("_vb", value_bucket(F.col(value)))
    inside = (
        Window.partitionBy(*keys, "_vb").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    lower = Window.partitionBy(*keys).orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = distinct.groupBy(*keys, "_vb").agg(*[F.sum(name).alias(f"_t_{name}") for name in measures])
    carried = totals.select(
        *keys,
        "_vb",
        *[F.sum(f"_t_{name}").over(lower).alias(f"_c_{name}") for name in measures],
        *[F.sum(f"_t_{name}").over(whole).alias("n" if name == "cnt" else f"all_{name}") for name in measures],
    )
    ranked = distinct.withColumns({f"_l_{name}": F.sum(name).over(inside) for name in measures}).join(
        carried, [*keys, "_vb"]
    )
    below = {
        ("below" if name == "cnt" else f"below_{name}"):
            F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        for name in measures
    }
    helpers = [f"_{mark}_{name}" for mark in "lc" for name in measures]
    return ranked.withColumns(below).drop("_vb", *helpers)


def bucket_ranks(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], inside: str,
    tasks: int | None = None, dealt: Sequence[str] = (),
) -> DataFrame:
    """One row per key, value bucket ``_vb`` and distinct non-null value with its ``sums`` and, as ``inside``, the total of the sum of
    that name over the smaller values of its bucket. Callers add up buckets; those of a key are few.

    Rows cross one shuffle, by key and bucket, in ``tasks`` tasks (by default as many as the session says, which adaptive execution
    may merge). Equal values that lie together by the columns ``dealt`` are added up before it.
    """
    keys, names = list(keys), list(sums)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).where(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))
    added = known.groupBy(*dealt, *keys, value).agg(*[F.sum(column).alias(name) for name, column in sums.items()])
    bucketed = added.select(*keys, value_bucket(F.col(value)).alias("_vb"), value, *names)
    where = [*keys, "_vb"]
    spread = bucketed.repartition(tasks, *where) if tasks else bucketed.repartition(*where)
    distinct = spread.groupBy(*where, value).agg(*[F.sum(name).alias(name) for name in names])
    smaller = Window.partitionBy(*where).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return distinct.withColumn("inside", F.coalesce(F.sum(inside).over(smaller), F.lit(0)))


def over_lower(buckets: DataFrame, keys: Sequence[str], total: str, bucket: str = "_vb") -> DataFrame:
    """Bucket totals with ``lower``, the sum of ``total`` over the key's lower buckets, and ``whole``, that over the key."""
    lower = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    below = buckets.withColumn("lower", F.coalesce(F.sum(total).over(lower), F.lit(0)))
    return below.withColumn("whole", F.sum(total).over(Window.partitionBy(*keys)))


def mid_rank(below: Column, ties: Column) -> Column:
    """Average rank (1-based) of ``ties`` equal values with ``below`` smaller ones."""
    return below + (ties + 1) / 2.0


def order_statistic(value: str, position: Column, over: WindowSpec | None = None) -> Column:
    """Aggregate over a rank table (or window function ``over`` its keys): the value at a 0-based sorted position."""
    here = (F.col("below") <= position) & (position < F.col("below") + F.col("cnt"))
    found = F.max(F.when(here, F.col(value)))
    return found.over(over) if over else found


def linear_quantile(value: str, prob: float, over: WindowSpec | None = None) -> Column:
    """Aggregate over a rank table (or window function): quantile with linear interpolation between order statistics."""
    position = (F.col("n") - 1) * F.lit(prob)
    low = F.floor(position)
    high = F.least(low + 1, F.col("n") - 1)
    share = F.max(position - low)
    below, above = order_statistic(value, low, over), order_statistic(value, high, over)
    return below + (above - below) * (share.over(over) if over else share)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key; one column per entry of ``probs``."""
    table = rank_table(df, keys, value)
    return table.groupBy(*keys).agg(*[linear_quantile(value, p).alias(name) for name, p in probs.items()])


def with_mid_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, bounded: bool = False, centred: bool = False) -> DataFrame:
    """Attach the average rank of ``value`` within ``keys``; null values get a null rank.

    The rank table joins back on the value. A value shared by very many rows is one row there, and the
    adaptive skew join splits its partition on the other side. ``bounded`` as in ``rank_table``. ``centred`` takes the mean
    rank off, so that equal values all give exactly 0.
    """
    keys = list(keys)
    if bounded:
        known = F.col(value).isNotNull() & ~F.isnan(value)
        below = F.rank().over(Window.partitionBy(*keys, known).orderBy(value)) - 1
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, known, value))
        middle = (F.count(F.lit(1)).over(Window.partitionBy(*keys, known)) + 1) / 2.0
        rank = mid_rank(below, ties)
        return df.withColumn(name, F.when(known, rank - middle if centred else rank))
    rank = mid_rank(F.col("below"), F.col("cnt"))
    ranks = rank_table(df, keys, value).select(
        *[F.col(key).alias(f"_k_{key}") for key in keys], F.col(value).alias("_value"),
        (rank - (F.col("n") + 1) / 2.0 if centred else rank).alias(name),
    )
    # keys under other names: those of rows without a rank must stay
    same = [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys] + [F.col(value) == F.col("_value")]
    return df.join(ranks, same, "left").drop(*[f"_k_{key}" for key in keys], "_value")
