"""Best-fit packing (3): pieces of at most 2048 tokens into as few sequences as possible.

Only the lengths decide, and there are at most ``LIMIT`` different ones, so the plan is made from their histogram, whatever
the number of pieces: sets that dominate all alternatives are fixed first (full pieces, pairs that fill a sequence, and
pairs or single pieces beside which nothing better fits), then best-fit decreasing packs what remains. A plan row says which
ranks of a length go to which run of sequences. Pieces are ranked within their length by counts per part, so a length that
a third of all pieces share is ranked in many tasks.

Results in odd cases: a null or empty text is one piece, the end id; rows with the same doc_id are packed one by one; a
tokenised document longer than the limit is cut into full pieces and a rest; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map, encoder, vocabulary_path
from barloom.llm.common import python_map, stage

LIMIT = 2048
#: Chunks that a worker remembers, fewer than in op1: later stages of a pipeline need the memory.
_MEMO = 700_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int"
#: Fixed rows of a plan: ranks [first, last) of a length; ``each`` of them go to each sequence from ``base`` on, from ``offset`` on.
PLAN = ("length", "first", "last", "each", "base", "offset")


class _Lengths:
    """Counts by length that still have to be packed, with their lengths in order."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: v for k, v in histogram.items() if v}
        self.order = sorted(self.left)

    def take(self, length: int, count: int) -> None:
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.order.pop(bisect_left(self.order, length))

    def largest_upto(self, bound: int) -> int | None:
        at = bisect_left(self.order, bound + 1)
        return self.order[at - 1] if at else None

    def smallest_beside(self, length: int, most: int) -> list[int]:
        """The ``most`` smallest pieces, without one piece of ``length``."""
        found: list[int] = []
        for k in self.order:
            found += [k] * min(most, self.left[k] - (k == length))
            if len(found) >= most:
                break
        return found[:most]


def reduce(lengths: _Lengths, limit: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Fix dominating sets of up to three pieces: (number of sequences, ((length, pieces in each), ...))."""
    fixed = []

    def fix(count: int, *content: tuple[int, int]) -> None:
        fixed.append((count, content))
        for length, each in content:
            lengths.take(length, count * each)

    for big in reversed(list(lengths.order)):
        while big in lengths.left:
            count, room = lengths.left[big], limit - big
            partner = lengths.largest_upto(room)
            if partner == big and count == 1:
                partner = lengths.largest_upto(big - 1)
            if partner is None:
                fix(count, (big, 1))
                break
            small = lengths.smallest_beside(big, 3)
            pair_only = partner == room or len(small) < 2 or small[0] + small[1] > room
            if not pair_only:
                three_fit = len(small) == 3 and sum(small) <= room
                pair_only = not three_fit and partner >= _best_pair(lengths, room)
            if not pair_only:
                break
            if partner == big:
                fix(count // 2, (big, 2))
            else:
                fix(min(count, lengths.left[partner]), (big, 1), (partner, 1))
    return fixed


def _best_pair(lengths: _Lengths, room: int) -> int:
    """Largest sum of two remaining lengths that is not over ``room``."""
    best, lo, hi = 0, 0, bisect_left(lengths.order, room + 1) - 1
    while lo <= hi:
        a, b = lengths.order[lo], lengths.order[hi]
        if a + b > room or (lo == hi and lengths.left[a] < 2):
            hi -= 1
            continue
        best = max(best, a + b)
        lo += 1
    return best


def best_fit(lengths: _Lengths, limit: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing on counts: equal sequences are filled together."""
    groups: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def add(room: int, count: int, content: tuple) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((count, content))

    for length in reversed(list(lengths.order)):
        left = lengths.left[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                whole, rest = divmod(left, each)
                if whole:
                    add(limit - each * length, whole, ((length, each),))
                if rest:
                    add(limit - rest * length, 1, ((length, rest),))
                break
            room = rooms[at]
            count, content = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length
            whole, rest = divmod(left, each)
            full = min(count, whole)
            if full:
                add(room - each * length, full, (*content, (length, each)))
            left -= full * each
            if full < count and left:
                add(room - left * length, 1, (*content, (length, left)))
                full, left = full + 1, 0
            if full < count:
                add(room, count - full, content)
    return [g for found in groups.values() for g in found]


def plan(histogram: dict[int, int], limit: int = LIMIT) -> pd.DataFrame:
    """Plan rows (``PLAN``) for a histogram of lengths."""
    lengths = _Lengths(histogram)
    patterns = reduce(lengths, limit)
    patterns += best_fit(lengths, limit)
    used: dict[int, int] = {}
    rows, base = [], 0
    for count, content in patterns:
        offset = 0
        for length, each in content:
            first = used.get(length, 0)
            used[length] = first + count * each
            rows.append((length, first, used[length], each, base, offset))
            offset += each * length
        base += count
    return pd.DataFrame(rows, columns=list(PLAN), dtype="int64")


def _cut(path: str, limit: int, end_id: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, _MEMO)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            for doc, part, found in zip(ids, parts, code.encode_texts(batch.column("text"))):
                whole = np.append(found.astype("<u4"), end)
                for piece, at in enumerate(range(0, len(whole), limit)):
                    own = whole[at : at + limit]
                    for column, value in zip(out, (doc, piece, at, len(own), zlib.crc32(own.tobytes()), part)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part"]
            )

    return make


def pieces(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """Pieces of documents (doc_id, text): doc_id, piece, start, length, ids_crc32 and the part of the input they lie in."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    placed = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return arrow_map(placed, _cut(path, limit, end_id), PIECES)


def _seated(table: pd.DataFrame):
    table = table.sort_values(["length", "first"])
    keys = table["length"].to_numpy() * (1 << 44) + table["first"].to_numpy()
    columns = {c: table[c].to_numpy() for c in PLAN}

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            over = rank - columns["first"][at]
            each = columns["each"][at]
            yield batch.drop(columns="rank").assign(
                sequence_id=columns["base"][at] + over // each, offset=columns["offset"][at] + over % each * length
            )

    return make


def pack(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece."""
    staged = stage(pieces(docs, vocabulary, limit), "pieces")
    counts = stage(staged.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    table = plan(histogram, limit)
    before = counts.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS _before")
    own = staged.selectExpr(
        "*", "row_number() OVER (PARTITION BY length, part ORDER BY doc_id, piece, start, ids_crc32) - 1 AS _in"
    )
    ranked = own.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_in")).alias("rank")
    )
    return python_map(
        ranked, _seated(table),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
