"""Centroid clustering (13): exact Lloyd rounds with heap-ordered bounds.

Vectors are packed into blocks. In a block, each cluster keeps a heap of its vectors by the gap between the distance to the
next-best centroid and to their own. When centroids move, a gap shrinks by the drift of the own centroid plus the largest
drift of the others at most; that sum is accumulated per cluster and heap keys are offset by it when they are pushed, so no
key is ever rewritten. In a round only vectors whose key the offset has reached are popped and compared with all centroids
again, exactly; all others keep their cluster without a look at their components.

A round reads the blocks, writes them with their new heaps, and adds up what the vectors that moved changed in the sums.
The driver sees one sum per cluster and component in a round, whatever the number of vectors. Nothing is shuffled but those sums.

Components are integers, so distances, sums and floors are exact; float bounds carry a margin that only pops more.

Results in odd cases: vectors that are null, of another length, or with null or non-finite components are not kept; rows
with the same vec_id are vectors of their own; a null vec_id can be clustered but comes last as a start; with fewer kept
vectors than centroids each is a start; of equal vec_ids the smaller vector starts first; an empty table gives no rows.
Components of 2**27 or more after scaling have no distance in a long, so the job fails and says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map
from barloom.llm.common import discard, stage

LIMIT = 1 << 27
BLOCK = 2048
_SCHEMA = (
    "vec_ids array<bigint>, width int, matrix binary, cluster binary, heap_sizes binary, heap_keys binary, heap_rows binary,"
    " popped bigint, moved_n binary, moved_sum binary"
)
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def kept_vectors(vectors: DataFrame, dims: int, scale: int, column: str) -> DataFrame:
    """(vec_id, v): integer components of the vectors that can be clustered."""
    c = F.col(column)
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(c.isNotNull() & (F.size(c) == dims) & whole)
    floors = F.transform(c, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(c, lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    too_large = F.raise_error(F.lit(f"a component is {LIMIT} or more after scaling: squared distances would not fit a long")).cast("array<bigint>")
    return good.select("vec_id", F.when(fits, floors).otherwise(too_large).alias("v"))


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances [point, center] of integer vectors; in floats where all partial sums stay whole."""
    high = max(np.abs(points).max(initial=0), np.abs(centers).max(initial=0))
    exact = np.float64 if 4.0 * points.shape[1] * float(high) ** 2 < 2.0**53 else np.int64
    p, c = points.astype(exact), centers.astype(exact)
    return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and the gap to the second-best distance (infinite where there is none)."""
    d = squared(points, centers)
    best = d.argmin(axis=1)
    if len(centers) == 1:
        return best, np.full(len(points), np.inf)
    two = np.partition(d, 1, axis=1)[:, :2]
    return best, np.sqrt(two[:, 1].astype(np.float64)) - np.sqrt(two[:, 0].astype(np.float64))


def _bytes(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _row(ids: list, matrix: np.ndarray, cluster: np.ndarray, heaps: list[list], popped: int, n: np.ndarray, sums: np.ndarray) -> tuple:
    high = int(np.abs(matrix).max(initial=0))
    width = 2 if high < 1 << 15 else 4
    keys = [key for heap in heaps for key, _ in heap]
    rows = [row for heap in heaps for _, row in heap]
    return (
        ids, width, _bytes(matrix, f"<i{width}"), _bytes(cluster, "<i4"), _bytes(np.array([len(h) for h in heaps]), "<i4"),
        _bytes(np.array(keys), "<f8"), _bytes(np.array(rows), "<i4"), popped, _bytes(n, "<i8"), _bytes(sums, "<i8"),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 5, pa.int64(), *[pa.binary()] * 2]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=_NAMES)


def _changes(matrix: np.ndarray, old: np.ndarray | None, new: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of counts and sums per cluster when ``rows`` go from cluster ``old`` (None: from nowhere) to ``new``."""
    n, sums = np.zeros(k, np.int64), np.zeros((k, matrix.shape[1]), np.int64)
    for clusters, sign in ((new, 1), (old, -1)):
        if clusters is not None:
            np.add.at(n, clusters, sign)
            np.add.at(sums, clusters, sign * matrix[rows])
    return n, sums


def _first(centers: np.ndarray):
    """Blocks of vectors with their first clusters and heaps."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                matrix = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                cluster, gap = nearest(matrix, centers)
                heaps: list[list] = [[] for _ in centers]
                for row, (c, g) in enumerate(zip(cluster.tolist(), gap.tolist())):
                    heaps[c].append((g, row))
                for heap in heaps:
                    heapify(heap)
                n, sums = _changes(matrix, None, cluster, np.arange(len(matrix)), len(centers))
                yield _batch([_row(part.column("vec_id").to_pylist(), matrix, cluster, heaps, len(matrix), n, sums)])

    return make


def expired(heaps: list[list], offset: np.ndarray) -> list[int]:
    """Rows popped from the heaps: those whose key the cluster's offset has reached."""
    out = []
    for heap, reached in zip(heaps, (offset + 1e-5 + 1e-9 * offset).tolist()):
        while heap and heap[0][0] <= reached:
            out.append(heappop(heap)[1])
    return out


def _unpacked(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["matrix"], f"<i{row['width']}").reshape(-1, dims), np.frombuffer(row["cluster"], "<i4")


def _heaps(row: dict) -> list[list]:
    ends = np.cumsum(np.frombuffer(row["heap_sizes"], "<i4")).tolist()
    pairs = list(zip(np.frombuffer(row["heap_keys"], "<f8").tolist(), np.frombuffer(row["heap_rows"], "<i4").tolist()))
    return [pairs[a:b] for a, b in zip([0, *ends], ends)]


def _next(centers: np.ndarray, offset: np.ndarray):
    """Blocks after a move of the centroids: expired vectors are compared again and pushed with new keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                matrix, cluster = _unpacked(row, centers.shape[1])
                heaps = _heaps(row)
                rows = np.array(expired(heaps, offset), np.int64)
                popped = matrix[rows].astype(np.int64)
                new, gap = nearest(popped, centers) if len(rows) else (rows, rows)
                for r, c, key in zip(rows.tolist(), new.tolist(), (gap + offset[new]).tolist()):
                    heappush(heaps[c], (key, r))
                moved = new != cluster[rows]
                n, sums = _changes(matrix.astype(np.int64), cluster[rows[moved]], new[moved], rows[moved], len(centers))
                after = cluster.copy()
                after[rows] = new
                yield _batch([_row(row["vec_ids"], matrix, after, heaps, len(rows), n, sums)])

    return make


def _moved(k: int, dims: int):
    """Changes of counts and sums of a whole partition, one row per cluster."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for a, b in zip(batch.column("moved_n").to_pylist(), batch.column("moved_sum").to_pylist()):
                n += np.frombuffer(a, "<i8")
                sums += np.frombuffer(b, "<i8").reshape(k, dims)
        values = np.column_stack([n, sums])
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(values.tolist(), pa.list_(pa.int64()))], names=["c", "s"])

    return make


def _add(state: DataFrame, totals: np.ndarray) -> np.ndarray:
    """Counts and sums [cluster, 1 + component] after the moves of a round; k x (dims + 1) numbers come to the driver."""
    k, columns = totals.shape
    parts = arrow_map(state.select("moved_n", "moved_sum"), _moved(k, columns - 1), "c int, s array<bigint>")
    sums = parts.select("c", F.posexplode("s").alias("i", "s")).groupBy("c", "i").agg(F.sum("s").alias("s"))
    out = totals.copy()
    for r in sums.collect():
        out[r["c"], r["i"]] += r["s"]
    return out


def _measured(centers: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix, cluster = _unpacked(row, centers.shape[1])
                away = matrix.astype(np.int64) - centers[cluster]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["vec_ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array((away * away).sum(axis=1), pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    return make


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector of ``vectors`` (vec_id, ``column``).

    The ``k`` kept vectors with the smallest sha256 of ``seed:vec_id`` start; ``rounds`` times centroids become the floor of
    their vectors' mean; clusters are those nearest to the last centroids. ``k`` is small: k x dims numbers are held by the driver.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, scale, column)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return kept.select("vec_id").selectExpr(
            "vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"
        )
    centers = np.array([r["v"] for r in starts], np.int64)
    totals, offset = np.zeros((len(centers), dims + 1), np.int64), np.zeros(len(centers))
    state = stage(arrow_map(kept, _first(centers), _SCHEMA), "clusters")
    for _ in range(rounds):
        totals = _add(state, totals)
        filled = totals[:, 0] > 0
        moved = centers.copy()
        moved[filled] = totals[filled, 1:] // totals[filled, :1]
        drift = np.sqrt(((moved - centers).astype(np.float64) ** 2).sum(axis=1))
        others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(len(drift))])
        centers, offset = moved, offset + drift + others
        last, state = state, stage(arrow_map(state.drop("popped", "moved_n", "moved_sum"), _next(centers, offset), _SCHEMA), "clusters")
        discard(last)
    found = stage(arrow_map(state.select("vec_ids", "width", "matrix", "cluster"), _measured(centers), "vec_id bigint, cluster int, distance bigint"), "distances")
    discard(state)
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [
        (c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest())
        for c, d in inertia.items()
    ]
    named = spark.createDataFrame(rows, "_c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row per cluster, at most k
    return found.join(F.broadcast(named), F.col("cluster") == F.col("_c")).drop("_c")
