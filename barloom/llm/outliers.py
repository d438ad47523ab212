"""Quality rules (7): base counts, then robust multivariate outliers per language and source.

The location and scatter of each group are minimum-covariance-determinant estimates: concentration steps start from
median-like centres and keep the rows nearest to the current centre until the subset holds ``SUPPORT`` of the group.
Each step is one aggregation with map-side combine over (group, distance bucket), so a group that holds a third of all
rows costs no more than others, and the number of groups is not bounded by anything held on the driver.

Results in odd cases: a null or empty text has no words and fails the base rule; a null language or source is a group
of its own; groups under ``LEAST`` rows share one pooled group, and nothing is rejected where that is small as well;
equal rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WHITE, discard, stage

SUPPORT = 0.75
STEPS = 5
LEAST = 60
CUTOFF = 60.0
BROADCAST_GROUPS = 100_000
#: Least standard deviation of each statistic: differences far below it are no sign of bad text.
FLOORS = (0.12, 0.08, 0.25, 0.25, 1.0)
#: Median of chi-square with five degrees of freedom, for the scale of the estimate.
CHI_MEDIAN = 4.351
SYMBOLS = r"[#*$%&|<>]"
P = len(FLOORS)
X = [f"_x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _n_lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(whole, WHITE), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.expr("aggregate(_words, 0L, (a, w) -> a + length(w))"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_runs": F.expr(
            "CASE WHEN size(_words) > 3 THEN transform(sequence(0, size(_words) - 3),"
            " i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) END"
        ),
    })
    out = out.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(_runs) > size(array_distinct(_runs))"
            " THEN sort_array(transform(_runs, (h, i) -> struct(h AS h, i AS i))) END"
        ),
    ).withColumn(
        "_at",
        F.expr(
            "CASE WHEN _sorted IS NOT NULL THEN sort_array(filter(transform(_sorted, (s, j) ->"
            " IF(s.h <=> get(_sorted, j - 1).h OR s.h <=> get(_sorted, j + 1).h, s.i, NULL)), p -> p IS NOT NULL)) END"
        ),
    )
    out = out.withColumn(
        "n_repeat_words",
        F.expr(
            "CASE WHEN _at IS NULL THEN 0L ELSE aggregate(_at, struct(0 AS e, 0L AS n),"
            " (a, p) -> struct(p + 3 AS e, a.n + (p + 3 - greatest(p, a.e)) AS n), a -> a.n) END"
        ),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines", "_runs", "_sorted", "_at")


def _vector() -> dict[str, Column]:
    """Transformed statistics: log word length, arcsine roots of shares, log length."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def root(part: str, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / whole)))

    return dict(zip(X, (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        root("n_symbols", F.greatest(F.col("word_chars"), F.lit(1))),
        root("n_dup_lines", F.greatest(F.col("_n_lines"), F.lit(1))),
        root("n_repeat_words", words),
        F.log(words),
    )))


def _distance() -> Column:
    """Squared Mahalanobis distance from the stored centre and Cholesky factor, by forward substitution."""
    z: list[str] = []
    for i in range(P):
        inner = f"({X[i]} - m{i})" + "".join(f" - l{i}{j} * ({z[j]})" for j in range(i))
        z.append(f"(({inner}) / l{i}{i})")
    return F.expr(" + ".join(f"pow({v}, 2)" for v in z))


def _factor(sums: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of the floored covariance from counts, sums and sums of products."""
    out = sums.withColumns({f"m{i}": F.expr(f"s{i} / n") for i in range(P)})
    out = out.withColumns({
        f"c{i}{j}": F.expr(f"p{i}{j} / n - m{i} * m{j}" + (f" + {FLOORS[i] ** 2}" if i == j else "")) for i, j in PAIRS
    })
    for i in range(P):
        for j in range(i + 1):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt(greatest(c{i}{j}{rest}, {FLOORS[i] ** 2}))" if i == j else f"(c{i}{j}{rest}) / l{j}{j}"
            out = out.withColumn(f"l{i}{j}", F.expr(value))
    return out.select("_g", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], "f")


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), *[F.sum(X[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(F.expr(f"{X[i]} * {X[j]}")).alias(f"p{i}{j}") for i, j in PAIRS],
    ]


def _held(small: DataFrame) -> DataFrame:
    """A table with one row per group, sent to all tasks where its counted rows allow it."""
    return F.broadcast(small) if small.count() <= BROADCAST_GROUPS else small


def _concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: sums per (group, distance bucket), then the nearest buckets that hold the support."""
    bucket = F.floor(8 * F.log2(F.greatest(_distance(), F.lit(1e-3)))).cast("int")
    per = rows.join(_held(model), "_g").withColumn("_b", bucket).groupBy("_g", "_b").agg(*_sums())
    names = [f"s{i}" for i in range(P)] + [f"p{i}{j}" for i, j in PAIRS]
    near = per.selectExpr(
        "*", "sum(n) OVER (PARTITION BY _g ORDER BY _b) - n AS _before", "sum(n) OVER (PARTITION BY _g) AS _all"
    )
    kept = f"_before < {SUPPORT} * _all"
    summed = near.groupBy("_g").agg(
        *[F.expr(f"sum({c}) FILTER (WHERE {kept})").alias(c) for c in ("n", *names)],
        F.expr("min(_b) FILTER (WHERE _before + n >= 0.5 * _all)").alias("_mid"),
    )
    return _factor(summed.withColumn("f", F.pow(F.lit(2.0), (F.col("_mid") + 0.5) / 8) / CHI_MEDIAN))


def _start(rows: DataFrame) -> DataFrame:
    """Centres by the medians of each statistic on a fixed grid, spread from its floor."""
    cells = rows.select("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * 64).alias("v")) for i, x in enumerate(X)])).alias("c"))
    counts = cells.groupBy("_g", "c.i", "c.v").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.selectExpr(
        "_g", "i", "v", "n", "sum(n) OVER (PARTITION BY _g, i ORDER BY v) AS _upto", "sum(n) OVER (PARTITION BY _g, i) AS _all"
    )
    medians = ranked.where("2 * _upto >= _all").groupBy("_g", "i").agg(((F.min("v") + 0.5) / 64).alias("m"))
    spread = {f"l{i}{j}": F.lit(4 * FLOORS[i] if i == j else 0.0) for i, j in PAIRS}
    wide = medians.groupBy("_g").agg(*[F.max(F.expr(f"CASE WHEN i = {i} THEN m END")).alias(f"m{i}") for i in range(P)])
    return wide.withColumns(spread | {"f": F.lit(1.0)})


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``keep`` columns, the base counts, base_failed, kept and distance (null for base failures), one row per document."""
    judged, names = _judged(docs, keep, text)
    return judged.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _kept(cutoff).alias("kept"), "distance",
    )


def keep_documents(docs: DataFrame, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` that pass, columns as they were."""
    judged, names = _judged(docs, tuple(docs.columns), text)
    return judged.where(_kept(cutoff)).select(*[F.col(n).alias(c) for c, n in names.items()])


def _kept(cutoff: float) -> Column:
    return ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)


def _judged(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` columns under names of their own, the base counts and the distance."""
    names = {c: f"_k{i}" for i, c in enumerate(keep)}
    has = set(docs.columns)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c in has else F.lit("\x00")
    counted = base_counts(docs.select(
        *[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("_text"),
        F.concat_ws("\x01", part("lang"), part("source")).alias("_own"),
    ), "_text").drop("_text").withColumns(_vector())
    staged = stage(counted, "quality-counts")
    sizes = staged.where("NOT base_failed").groupBy("_own").agg(F.count(F.lit(1)).alias("_rows"))
    groups = stage(sizes.select("_own", F.when(F.col("_rows") >= LEAST, F.col("_own")).otherwise("\x02").alias("_g")), "quality-groups")
    rows = stage(staged.where("NOT base_failed").join(_held(groups), "_own").select("_g", *X), "quality-vectors")
    model = stage(_start(rows), "quality-start")
    for _ in range(STEPS):
        last, model = model, stage(_concentrate(rows, model), "quality-step")
        discard(last)
    big = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= LEAST).select("_g")
    usable = stage(groups.join(model.join(big, "_g"), "_g").drop("_g"), "quality-model")
    discard(rows, model, groups)
    joined = staged.join(_held(usable), "_own", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), _distance() / F.greatest(F.col("f"), F.lit(0.25)))
    )
    return joined, names
