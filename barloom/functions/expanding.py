"""Percentile rank of each value among its own history."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import rank_table
from barloom.functions.windows import is_daily

RANK_ROWS, TASK_ROWS = 128, 1 << 14


def _mid_count(past: Column, value: Column) -> Column:
    """Smaller elements plus half of the equal ones; ``value`` is one of the elements.

    The first place of a value in the sorted list tells how many are smaller, in the reversed list how many
    are larger. Both run as primitive loops, unlike a lambda.
    """
    ascending = F.sort_array(past)
    smaller, larger = F.array_position(ascending, value), F.array_position(F.reverse(ascending), value)
    return (F.size(past) + smaller - larger) / 2.0


def _halves(positioned: DataFrame, columns: Mapping[str, str], keys: Sequence[str], rows: int) -> DataFrame:
    """(keys, pos, name, value, level, pair, old): each value once per level of a binary tree over positions.

    At level ``l`` blocks of ``rows * 2^l`` positions form pairs; ``old`` is 1 in the earlier block of a pair. Any two
    positions of different lowest blocks meet in exactly one pair, so a value is listed log2(n / rows) times.
    """
    cells = F.array(*[F.struct(F.lit(out).alias("name"), F.col(x).alias("value")) for out, x in columns.items()])
    long = positioned.where(F.col("n") > rows).select(*keys, "pos", "n", F.explode(cells).alias("cell"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") / rows)).cast("int"))
    spread = long.where("cell.value IS NOT NULL").select(
        *keys, "pos", "n", "cell.name", "cell.value", F.explode(levels).alias("level")
    )
    size = f"shiftleft({rows}L, level)"
    met = f"(pos div {size}) % 2 = 1 OR (pos div {size} + 1) * {size} < n"
    return spread.where(met).selectExpr(
        *keys, "pos", "name", "value", "level", f"pos div {size} div 2 AS pair", f"int(1 - (pos div {size}) % 2) AS old"
    )


def _counted_in_windows(halves: DataFrame, group: Sequence[str]) -> DataFrame:
    """Later rows with the earlier block's values below them (ties half) and in all, from one sort by value."""
    pairs = Window.partitionBy(*group).orderBy("value")
    first, last, here = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    counted = halves.select(
        "*",
        F.sum("old").over(pairs.rangeBetween(first, here)).alias("_upto"),
        F.sum("old").over(pairs.rangeBetween(here, here)).alias("_tied"),
        F.sum("old").over(pairs.rangeBetween(first, last)).alias("_seen"),
    )
    return counted.where("old = 0").withColumn("_score", F.col("_upto") - F.col("_tied") / 2.0)


def _counted_in_tables(halves: DataFrame, group: Sequence[str]) -> DataFrame:
    """The same for pairs of any size: rank tables part them into value buckets."""
    table = rank_table(halves, group, "value", {"old": F.col("old")}).select(
        *[F.col(c).alias(f"_t_{c}") for c in (*group, "value")],
        (F.col("below_old") + F.col("old") / 2.0).alias("_score"), F.col("all_old").alias("_seen"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in (*group, "value")]
    return halves.where("old = 0").join(table, same)


def _walking(width: int):
    """Function that reads series after series, each by position, with the sorted values to date of one series kept."""

    def walked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from bisect import bisect_left, bisect_right

        past, nans, due = [], [], 0
        for positions, *columns in batches:
            places, ranks = positions.to_pylist(), [[] for _ in range(width)]
            values = [column.to_pylist() for column in columns]
            begins = [i for i, place in enumerate(places) if place == 0]
            for first, last in zip([0, *begins], [*begins, len(places)]):
                if first == last:
                    continue
                if places[first] == 0:
                    past, nans, due = [[] for _ in range(width)], [0] * width, 0
                if places[first:last] != list(range(due, due + last - first)):
                    raise ValueError("a series does not lie in one task in the order of its positions")
                due += last - first
                for k in range(width):
                    history, found = past[k], ranks[k].append
                    for value in values[k][first:last]:
                        if value is None:
                            found(None)
                            continue
                        if value != value:  # NaN, above all numbers and equal to itself
                            lower, upper = len(history), len(history) + nans[k]
                            nans[k] += 1
                        else:
                            lower = upper = bisect_right(history, value)
                            if upper and history[upper - 1] == value:
                                lower = bisect_left(history, value, 0, upper)
                            history.insert(upper, value)
                        found(((lower + upper) / 2 + 1) / (len(history) + nans[k]))
            yield pa.StructArray.from_arrays([pa.array(found, pa.float64()) for found in ranks], [f"r{k}" for k in range(width)])

    return walked


def _ranked_in_series(positioned: DataFrame, columns: Mapping[str, str], keys: Sequence[str], in_order: bool) -> DataFrame:
    """Ranks of daily series, each read once where it lies; without ``in_order`` a window deals and sorts rows that are not yet.

    The function counts as not deterministic, so that no filter of a caller is moved below it.
    """
    fields = ", ".join(f"r{k} double" for k in range(len(columns)))
    walk = F.arrow_udf(_walking(len(columns)), fields).asNondeterministic()
    place = F.col("pos") if in_order else F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    walked = positioned.withColumn("_place", place).withColumn("_ranks", walk("_place", *columns.values()))
    return walked.withColumns({out: F.col(f"_ranks.r{k}") for k, out in enumerate(columns)}).drop("_place", "_ranks", "pos", "n", "seg")


def expanding_rank(
    positioned: DataFrame,
    columns: Mapping[str, str],
    keys: Sequence[str] = ("ticker",),
    rows: int = RANK_ROWS,
    task_rows: int = TASK_ROWS,
    in_order: bool = False,
) -> DataFrame:
    """Average-tie percentile rank of the current value in the history to date.

    ``columns`` maps output to input names; the frame needs ``pos`` and ``n`` and loses them. A daily series is bounded by the
    schema and read once, bar by bar, with its sorted history kept; ``in_order`` tells that the last window had the keys and the order of ``pos``, which is
    checked. Elsewhere a row compares
    itself with its own block of ``rows`` rows directly. Earlier blocks are counted by merging: the later block of
    each pair counts the values of the earlier one in value order, level by level. Pairs of up to ``task_rows`` rows are
    sorted in one window each; larger ones go through rank tables, so no task holds a whole history. Null values have no rank and are in no history.
    """
    keys = list(keys)
    if is_daily(positioned) and task_rows >= TASK_ROWS:
        return _ranked_in_series(positioned, columns, keys, in_order)
    group = [*keys, "name", "level", "pair"]
    halves = _halves(positioned, columns, keys, rows)
    small = f"shiftleft({2 * rows}L, level) <= {task_rows}"
    counted = ["_score", "_seen"]
    earlier = _counted_in_windows(halves.where(small), group).select(*keys, "pos", "name", *counted)
    large = _counted_in_tables(halves.where(f"NOT {small}"), group)
    earlier = earlier.unionByName(large.select(*keys, "pos", "name", *counted))
    totals = {f"{part}_{out}": F.sum(F.when(F.col("name") == out, F.col(part))) for out in columns for part in counted}
    carried = earlier.groupBy(*keys, "pos").agg(*[total.alias(name) for name, total in totals.items()])
    blocks = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = positioned.withColumn("_block", F.expr(f"pos div {rows}"))
    local = local.withColumns({f"_past_{out}": F.collect_list(x).over(blocks) for out, x in columns.items()})
    own = {f"_own_{out}": _mid_count(F.col(f"_past_{out}"), F.col(x)) for out, x in columns.items()}
    sizes = {f"_size_{out}": F.size(f"_past_{out}") for out in columns}
    local = local.withColumns(own | sizes).drop(*[f"_past_{out}" for out in columns], "_block")
    # both parts lie where their series lies: a window brings them together, null keys included, and no history is shuffled
    here = Window.partitionBy(*keys, "pos")
    both = local.withColumn("_own_row", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    joined = both.withColumns({name: F.max(name).over(here) for name in totals}).where("_own_row")
    outputs = {}
    for out, x in columns.items():
        smaller = F.col(f"_own_{out}") + F.coalesce(f"_score_{out}", F.lit(0.0))
        seen = F.col(f"_size_{out}") + F.coalesce(f"_seen_{out}", F.lit(0))
        outputs[out] = F.when(F.col(x).isNotNull(), (smaller + 0.5) / seen)
    return joined.withColumns(outputs).drop(*own, *sizes, *totals, "_own_row", "pos", "n", "seg")
