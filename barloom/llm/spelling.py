"""Spelling variant grouping (11): words one edit apart, found by dense tiles of code points.

Words are counted over whole texts. Two words are one edit apart exactly if their common prefix and their common suffix
together reach the longer length minus one. Words that can be so are brought together first: for the length m of the longer
word, the places 0 .. m - 1 are cut into segments of two, and words that agree before and after a segment share a group.
Each group is a tile: its words lie in two padded matrices, one aligned left and one right, and all pairs of the tile are
compared along its diagonals, a whole diagonal at once. A pair is reported only in the segment in which its common prefix
ends, so each pair comes out once.

A group differs in two places only, so it holds at most some eight thousand words, whatever the number of words in all
(words of more than ``LONG`` letters have wider segments, so that a word is in at most about ``LONG`` groups). No group is cut.

Results in odd cases: null and empty texts have no words; a null doc_id counts as empty text in the hash that picks runs;
repeated rows count each time; of equally frequent near words the first in code-point order is the form; an empty table or
one without frequent words gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map
from barloom.llm.common import discard, python_map, stage

#: Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
SEGMENT = 2
LONG = 128
_HELD_WORDS = 1 << 18
_CELLS = 1 << 22
_SLICE = 1 << 22


def runs_of(text: str) -> Iterator[list[bytes]]:
    """Runs of letters, lower-cased, as Latin-1 bytes (one byte a code point), in slices of a few megabytes."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + _SLICE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def misspell(run: bytes, crc: int, divisor: int) -> bytes:
    """The run, less one code point where ``divisor`` divides the hash of its place; ``crc`` is that of what precedes it."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, divisor: int | None):
    def rows(total: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                crc = crc32(f"{'' if doc is None else doc}:".encode())
                for runs in runs_of(text.as_py() or ""):
                    for run, n in Counter(runs).items():
                        word = misspell(run, crc, divisor) if divisor else run
                        if len(word) >= least:
                            total[word] = total.get(word, 0) + n
                    if len(total) > _HELD_WORDS:
                        yield rows(total)
                        total = {}
        yield rows(total)

    return make


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, divisor: int | None = None) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) that are long and frequent enough.

    With ``divisor``, a run loses one code point wherever ``divisor`` divides the hash of its document and itself.
    """
    counted = arrow_map(docs.select("doc_id", "text"), _counted(least_length, divisor), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _segments(words: DataFrame) -> DataFrame:
    """(m, a, b, key, word, n): the groups a word is in, as the longer or equal word (m its length) and as the shorter one."""
    sides = words.withColumn("m", F.explode(F.expr("array(length(word), length(word) + 1)")))
    wide = F.greatest(F.lit(SEGMENT), F.ceil(F.col("m") * SEGMENT / LONG).cast("int"))
    cut = sides.withColumn("_wide", wide).withColumn("a", F.explode(F.expr("sequence(0, m - 1, _wide)")))
    cut = cut.withColumn("b", F.least("m", F.col("a") + F.col("_wide")))
    key = F.expr("xxhash64(m, a, left(word, a), right(word, m - b))")
    return cut.select("m", "a", "b", key.alias("key"), "word", "n")


def tile_pairs(words: list[bytes], m: int, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) one edit apart whose longer word has ``m`` letters and whose common prefix ends in [a, b).

    Row i belongs to the group that ends before row ``ends[i]``; groups lie one after another.
    """
    size = np.array([len(w) for w in words])
    left = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(-1, m)
    tail = np.frombuffer(b"".join(w.rjust(m, b"\0")[::-1] for w in words), np.uint8).reshape(-1, m)
    firsts, seconds = [], []
    rows, d, step = np.arange(len(words)), 1, max(1, _CELLS // m)
    while len(rows := rows[rows + d < ends[rows]]):
        for start in range(0, len(rows), step):
            i = rows[start : start + step]
            i = i[np.maximum(size[i], size[i + d]) == m]
            prefix = (left[i] == left[i + d]).argmin(axis=1)
            suffix = (tail[i] == tail[i + d]).argmin(axis=1)
            near = (prefix + suffix >= m - 1) & (prefix >= a[i]) & (prefix < b[i])
            firsts.append(i[near])
            seconds.append(i[near] + d)
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *seconds])


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def tiles(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for m, rows in frame.groupby("m", sort=False):
            key, place = rows["key"].to_numpy(), rows["a"].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]) | (place[1:] != place[:-1])) + 1
            ends = np.repeat(np.append(new, len(rows)), np.diff(np.concatenate([[0], new, [len(rows)]])))
            i, j = tile_pairs([w.encode("latin-1") for w in rows["word"]], int(m), ends, place, rows["b"].to_numpy())
            word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
            yield pd.DataFrame({"word": np.append(word[i], word[j]), "near": np.append(word[j], word[i]), "near_n": np.append(n[j], n[i])})

    rest = None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (frame[["m", "a", "key"]] == frame[["m", "a", "key"]].iloc[-1]).all(axis=1).to_numpy()
        at = int(last.argmax())  # rows are sorted, so the last group starts here; it may go on in the next batch
        rest = frame.iloc[at:]
        if at:
            yield from tiles(frame.iloc[:at])
    if rest is not None:
        yield from tiles(rest)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words exactly one edit apart, once."""
    keys = ["m", "a", "key"]
    placed = _segments(words).repartition(*keys).sortWithinPartitions(*keys)
    return python_map(placed, _links, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form), by doubling: a form is at least twice as frequent as its word,
    so chains are short and the rounds few."""
    step = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = step.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        jumped = step.join(up, step["root"] == up["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        last, step = step, stage(jumped, "spelling-roots")
        discard(last)
        moved = step.where("moved").limit(1).count()
        located, step = step.staged_at, step.drop("moved")
        step.staged_at = located
        if not moved:
            return step


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, divisor: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per frequent word of ``docs`` (doc_id, text).

    ``form`` is the most frequent near word if it is at least ``ratio`` (2 or more) times as frequent; ``root`` follows forms to the last.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms cannot lead back")
    words = stage(count_words(docs, least_length, least_count, divisor), "spelling-words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_less"), F.col("near").alias("_near"))).alias("_best")
    )
    full = words.join(best.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    taken = -F.col("_best._less") >= ratio * F.col("n")
    judged = stage(
        full.select(
            "word", F.when(taken, F.col("_best._near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(taken, -F.col("_best._less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(judged.where("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    out = judged.join(roots, judged["word"] == roots["_word"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
