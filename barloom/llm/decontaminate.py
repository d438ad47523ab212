"""Benchmark decontamination (6): windows of benchmark words found in documents, in DataFrame functions only.

Windows of 13 words (a shorter item is one window) are hashed by doubling: hashes of 1, 2, 4 and 8 neighbouring words
combine into one per position. A bitmap of fixed size, built from the benchmark, picks positions inside each row; only
those carry their window's text into a join that compares the words themselves. The set of windows is broadcast up to
``BROADCAST_ROWS`` windows and left to Spark's join choice beyond.

Results in odd cases: a null or empty text has no words and no hits; an item without words has no window; an empty
benchmark hits nothing; equal items each count; rows with the same doc_id and text each give a row. Items without an id
hit like others; together they count as one item, whose id is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, UPPER, small_side, stage

WINDOW = 13
#: Word characters before lower-casing: digits, letters A-Z and a-z, and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
BITMAP_BITS = 20


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_w", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)))


def _hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns _h1, _h2, ... by doubling, then _r<k>: the hash of the window of k words at each position.

    Hashes fold case by ``lower``, which is coarser than A-Z alone; the join on the text decides.
    """
    df = df.withColumn("_h1", F.expr("transform(_w, w -> xxhash64(lower(w)))"))
    step = 1
    while 2 * step <= max(lengths, default=1):
        df = df.withColumn(f"_h{2 * step}", F.expr(f"transform(_h{step}, (x, i) -> xxhash64(x, get(_h{step}, i + {step})))"))
        step *= 2
    for k in lengths:
        left, at, parts = k, 0, []
        while left:
            power = 1 << (left.bit_length() - 1)
            parts.append((power, at))
            at, left = at + power, left - power
        rest = "".join(f", get(_h{p}, i + {a})" for p, a in parts[1:])
        df = df.withColumn(f"_r{k}", F.expr(f"transform(_h{parts[0][0]}, (x, i) -> xxhash64(x{rest}, {k}))"))
    return df


def _window_text(at: str, length: str) -> str:
    return f"translate(array_join(slice(_w, {at} + 1, {length}), ' '), '{UPPER}', '{LOWER}')"


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (item_id, _k, _window) of a benchmark table; _k is the window's number of words."""
    words = _words(benchmark.select("item_id", "text"), "text").where("size(_w) > 0")
    sized = words.withColumn("_k", F.least(F.size("_w"), F.lit(width)))
    placed = sized.select("item_id", "_k", "_w", F.explode(F.expr("sequence(0, size(_w) - _k)")).alias("_i"))
    return placed.select("item_id", "_k", F.expr(_window_text("_i", "_k")).alias("_window")).distinct()


def _bitmap(windows: DataFrame, lengths: list[int]) -> Column:
    """Bits of the windows' hashes as a constant array of 2^BITMAP_BITS / 64 numbers, whatever the benchmark's size."""
    split = windows.select("_k", F.split("_window", " ").alias("_w"))
    hashed = _hashes(split, lengths).select(
        F.expr("CASE _k " + " ".join(f"WHEN {k} THEN get(_r{k}, 0)" for k in lengths) + " END").alias("h")
    )
    cell = F.expr(f"shiftright(h & {(1 << BITMAP_BITS) - 1}L, 6)")
    bits = dict(hashed.groupBy(cell.alias("c")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("b")).collect())
    cells = ",".join(str(bits.get(c, 0)) for c in range(1 << (BITMAP_BITS - 6)))
    return F.split(F.lit(cells), ",").cast("array<bigint>")


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, _text_hash, n_words, hits (array of struct i, k: first word and length) items (item_ids) and n_rows, one row per distinct document."""
    windows = benchmark_windows(benchmark, width)
    counted = {r["_k"]: r["n"] for r in windows.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = sorted(counted)
    base = _words(docs.select("doc_id", F.col("text").alias("_t")), "_t").select(
        "doc_id", F.xxhash64("_t").alias("_text_hash"), F.size("_w").cast("long").alias("n_words"), "_w"
    )
    if not lengths:
        return base.select(
            "doc_id", "_text_hash", "n_words",
            F.expr("CAST(array() AS array<struct<i: int, k: int>>)").alias("hits"), F.expr("CAST(array() AS array<string>)").alias("items"),
        ).groupBy("doc_id", "_text_hash", "n_words", "hits", "items").agg(F.count(F.lit(1)).alias("n_rows"))
    base = _hashes(base, lengths).withColumn("_bits", _bitmap(windows, lengths))
    tests = [
        f"transform(filter(transform(_r{k}, (x, i) -> IF(i <= n_words - {k} AND getbit(get(_bits, CAST(shiftright(x & {(1 << BITMAP_BITS) - 1}L, 6) AS INT)),"
        f" CAST(x & 63 AS INT)) = 1, i, NULL)), i -> i IS NOT NULL), i -> struct(i AS i, {k} AS k, {_window_text('i', str(k))} AS t))"
        for k in lengths
    ]
    found = base.select("doc_id", "_text_hash", "n_words", F.posexplode_outer(F.expr(f"concat({', '.join(tests)})")).alias("_at", "_c"))
    keyed = found.select(
        "doc_id", "_text_hash", "n_words", F.struct("_c.i", "_c.k").alias("_hit"), F.expr("int(coalesce(_at, 0) = 0)").alias("_first"),
        F.coalesce(F.col("_c.t"), F.concat(F.lit("\x00"), F.col("doc_id").cast("string"), F.lit("\x00"))).alias("_window"),
    )
    items = windows.groupBy("_window").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("_items"))
    small = sum(counted.values()) <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(items) if small else items, "_window", "left")
    return joined.groupBy("doc_id", "_text_hash", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("_items").isNotNull(), F.col("_hit")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"), F.sum("_first").alias("n_rows"),
    )


def judge(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, repeat: bool = True) -> DataFrame:
    """doc_id, _text_hash, n_words, n_hit, n_items, items_sha256, contaminated, hits; one row per document.

    Without ``repeat`` rows of the same doc_id and text give one row.
    """
    covered = (
        "aggregate(hits, struct(0 AS e, 0L AS n), (a, h) -> struct(greatest(a.e, h.i + h.k) AS e,"
        " a.n + greatest(0, h.i + h.k - greatest(h.i, a.e)) AS n), a -> a.n)"
    )
    out = find(docs, benchmark, width).withColumn("n_hit", F.expr(covered))
    if repeat:
        out = out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return out.select(
        "doc_id", "_text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits",
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, columns as they were."""
    bad = judge(docs, benchmark, width, repeat=False).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("_text_hash").alias("_bad_hash"))
    bad = small_side(stage(bad, "contaminated"))
    same = docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id and text without the words of any hit and what follows each of them up to the next word; one row per document."""
    hits = judge(docs, benchmark, width, repeat=False).select("doc_id", F.col("_text_hash").alias("_hash"), "hits")
    own = docs.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_own"))
    joined = own.join(hits, own["_id"].eqNullSafe(hits["doc_id"]) & (own["_own"] == hits["_hash"]), "left")
    pieces = joined.withColumns({
        "_head": F.regexp_extract(F.col("text"), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0),
        "_p": F.regexp_extract_all(F.col("text"), F.lit(TOKEN + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0)),
    })
    keep = "filter(_p, (p, j) -> NOT exists(hits, h -> j >= h.i AND j < h.i + h.k))"
    cut = F.when(F.size("hits") > 0, F.concat("_head", F.expr(f"array_join({keep}, '')"))).otherwise(F.col("text"))
    return pieces.select(F.col("_id").alias("doc_id"), cut.alias("text"))


