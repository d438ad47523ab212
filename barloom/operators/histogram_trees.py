"""Boosted trees over all rows of a table: a Spark job for each level of a tree, or for two levels where columns are few.

Rows with the same bins, label and part (fitted or held out) are one cell: every tree gives them the same sum. Cells are dealt over
the executors in blocks, with their sum of the trees so far and the keys of their rows. A job returns sums of weights and residuals by
node, feature and bin, a few KB a block, from which the driver takes the splits. Loss, weights, first tree and stopping are those of
MLlib's ``GBTClassifier``, whose jobs spend over ten times as long on a row.

Which rows a tree sees follows from the hash of a row's key, so the model does not depend on how rows are dealt. The rows that some
trees see are counted by cell for these trees at once; only that reads rows, all other jobs read cells, of which there are at most
as many as rows and, for few columns, far fewer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

#: Rows of a block: a task holds one block at a time, some tens of bytes a row.
BLOCK_ROWS, LEAST_ROWS = 1_000_000, 40_000
#: Trees whose rows are counted by cell in one reading of the keys.
COUNTED_TREES = 20
#: Up to so many columns, sums by pairs of columns cost less than a second pass and give two levels at once.
PAIRED_COLUMNS = 5


def _routing():
    """Function that leads coded rows to their nodes; made here, as tasks need not have this package."""

    def nodes_of(codes, feature, cut):
        """Node of every row: children of node k are 2k + 1 (code up to ``cut``) and 2k + 2."""
        node = np.zeros(codes.shape[1], np.uint8 if len(feature) < 256 else np.int32)
        for k in np.flatnonzero(feature >= 0):
            step = (codes[feature[k]] > cut[k]).astype(node.dtype)
            step += node.dtype.type(k + 1)
            step *= node == k
            node += step
        return node

    return nodes_of


@dataclass(frozen=True)
class BoostedTrees:
    """Thresholds of each column, and trees as (feature, cut, value) over the nodes of a full tree, rate included."""

    columns: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]

    def probability(self) -> Column:
        """Probability of label 1, for rows with all columns present."""
        edges, trees, nodes_of = self.edges, self.trees, _routing()

        @F.pandas_udf("double")
        def scored(*values: pd.Series) -> pd.Series:
            codes = np.stack([np.searchsorted(e, v.to_numpy(np.float64)) for e, v in zip(edges, values)]).astype(np.int16)
            z = np.zeros(codes.shape[1])
            for feature, cut, value in trees:
                z += value[nodes_of(codes, feature, cut)]
            return pd.Series(1 / (1 + np.exp(-2 * z)))

        return scored(*self.columns)


def thresholds(rows: DataFrame, columns: Sequence[str], bins: int) -> tuple[int, list[np.ndarray]]:
    """Number of rows, and at most ``bins`` - 1 thresholds a column from quantiles over all rows not held out; the largest value parts nothing."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    fitted = {c: F.when(~F.col("is_validation"), F.col(c)) for c in columns}
    found = rows.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.percentile_approx(v, shares, 10_000).alias(f"_q_{c}") for c, v in fitted.items()],
        *[F.max(v).alias(f"_top_{c}") for c, v in fitted.items()],
    ).first()
    edges = [np.unique([v for v in found[f"_q_{c}"] or () if v < found[f"_top_{c}"]]).astype(np.float64) for c in columns]
    return found["_rows"], edges


def _blocks(rows: DataFrame, columns: Sequence[str], label: str, edges: Sequence[np.ndarray], n: int):
    """RDD of blocks of cells: (codes by feature and cell, label 1, held out, rows, keys of the rows not held out, sum of trees)."""
    names, most = list(columns), BLOCK_ROWS

    def coded(batches):
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
            flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("_up", "is_validation")]
            cells = np.stack([*[np.searchsorted(e, v).astype(np.uint8) for e, v in zip(edges, values)], *flags], axis=1)
            ends = pa.py_buffer(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(cells), [None, ends, pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([packed, batch.column("_key")], names=["cell", "_key"])

    def block(parts):
        cells, key = (np.concatenate(p) for p in zip(*parts))
        first = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
        of, codes = np.diff(np.append(first, len(cells))), cells[first]
        fitted = key[cells[:, -1] == 0]
        data = [np.ascontiguousarray(codes[:, :-2].T), codes[:, -2], codes[:, -1], of.astype(np.int32), fitted.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in data], names=["codes", "up", "held", "n", "key"])

    def packed(batches):
        parts, held = [], 0
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(batch.num_rows, len(names) + 2)
            parts.append((cells, batch.column("_key").to_numpy(zero_copy_only=False)))
            held += batch.num_rows
            if held >= most:
                yield block(parts)
                parts, held = [], 0
        if held:
            yield block(parts)

    def unpacked(row):
        n = np.frombuffer(row.n, np.int32)
        codes, key = np.frombuffer(row.codes, np.uint8).reshape(len(names), len(n)), np.frombuffer(row.key, np.int64).view(np.uint64)
        return codes, np.frombuffer(row.up, bool), np.frombuffer(row.held, bool), n, key, np.zeros(len(n))

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, n // BLOCK_ROWS, min(n // LEAST_ROWS, cores))
    narrow = rows.select(*names, (F.col(label) > 0).alias("_up"), "is_validation", "_key")
    dealt = narrow.mapInArrow(coded, "cell binary, _key long").repartition(parts, "cell").sortWithinPartitions("cell", "_key")
    return cut_lineage(dealt.mapInArrow(packed, "codes binary, up binary, held binary, n binary, key binary")).rdd.map(unpacked)


def boosted_trees(
    rows: DataFrame, columns: Sequence[str], label: str, weight: float, trees: int, depth: int, rate: float, subsample: float,
    column_share: float, min_child: int, min_gain: float, bins: int = 32, seed: int = 42,
) -> BoostedTrees:
    """Trees fitted to ``rows`` with ``label`` 0 or 1, ``is_validation`` and a 64-bit ``_key``; label 1 weighs ``weight``.

    The first tree takes the labels (-1 and 1), later ones, shrunk by ``rate``, the residuals of the logistic loss. Every node
    chooses among a random share of the columns. Training ends when the loss of the rows held out rises.
    """
    n, edges = thresholds(rows, columns, bins)
    nodes_of, d = _routing(), len(columns)
    pairs = [(a, b) for a in range(d) for b in range(a + 1, d)] if 2 <= d <= PAIRED_COLUMNS else []
    width, size = max(map(len, edges), default=0) + 1, 2 ** (depth + 1) - 1
    chosen, rng = max(1, int(np.ceil(column_share * d))), np.random.default_rng(seed)

    def drawn(block, number, count):
        """A block with the rows that each of ``count`` trees sees in a cell, in the place of their keys."""
        codes, up, held, n, key, z = block
        seen = np.zeros((count, len(n)), np.min_scalar_type(int(n.max())))
        ours = np.flatnonzero(~held)
        starts = np.cumsum(n[ours]) - n[ours]
        for k in range(count):
            if subsample < 1 and len(ours):
                mixed = (key + np.uint64(seed * 1_000_003 + number + k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                used = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(32)) < np.uint64(int(subsample * 2**32))
                seen[k, ours] = used if len(ours) == len(key) else np.add.reduceat(used, starts, dtype=np.int32)
            else:
                seen[k, ours] = n[ours]
        return codes, up, held, n, seen, z

    def sums(block, number, feature, cut, level, paired):
        """Counts by label and sums of weighted residuals by column (or pair of columns), node, label and bin; loss and weight of rows held out."""
        codes, up, held, n, seen, z = block
        y, w = np.where(up, 1.0, -1.0), np.where(up, weight, 1.0)
        first, count = 2**level - 1, 2**level
        node = nodes_of(codes, feature, cut)
        here = np.flatnonzero((seen[0] > 0) & (node >= first))
        yh, rows_here = y[here], seen[0][here].astype(np.float64)
        residual = yh if number == 0 else 4 * yh / (1 + np.exp(2 * yh * z[here]))
        pull, base = rows_here * (w[here] * residual), ((node[here].astype(np.int64) - first) * 2 + up[here]) * width
        wide = (width, width) if paired else (width,)
        cells, shape, own = count * 2 * int(np.prod(wide)), (-1, count, 2, *wide), [c[here] for c in codes]
        places = [(base + own[a]) * width + own[b] for a, b in pairs] if paired else [base + c for c in own]
        counts = np.stack([np.bincount(at, rows_here, cells) for at in places]).astype(np.int32)
        pulls = np.stack([np.bincount(at, pull, cells) for at in places])
        out = w[held] * n[held]
        loss = 0.0 if level else float(np.sum(out * 2 * np.logaddexp(0.0, -2 * y[held] * z[held])))
        return counts.reshape(shape), pulls.reshape(shape).sum(axis=2, keepdims=True), loss, float(out.sum())

    def gathered(state, *given):
        found = state.map(lambda block: sums(block, *given)).collect()  # some KB for each block
        if not found:
            raise ValueError("no row to fit trees to")
        return [sum(np.asarray(x, np.float64) for x in part) for part in zip(*found)]

    def alone(cells):
        """Sums by column from those by pairs of columns."""
        return np.stack([cells[pairs.index((f, f + 1))].sum(axis=-1) if f + 1 < d else cells[pairs.index((f - 1, f))].sum(axis=-2) for f in range(d)])

    def children(cells, level, feature, cut):
        """Sums by column in the nodes of the next level, from those by pairs of columns in this one."""
        own = alone(cells)
        out = np.zeros((d, 2 ** (level + 1), *own.shape[2:]))
        for k in range(2**level):
            f, c = feature[2**level - 1 + k], cut[2**level - 1 + k]
            for b in range(d) if f >= 0 else ():
                if b == f:
                    out[b, 2 * k, :, : c + 1], out[b, 2 * k + 1, :, c + 1 :] = own[b, k, :, : c + 1], own[b, k, :, c + 1 :]
                else:
                    both = cells[pairs.index((f, b))][k] if f < b else cells[pairs.index((b, f))][k].swapaxes(-1, -2)
                    out[b, 2 * k], out[b, 2 * k + 1] = both[:, : c + 1].sum(axis=-2), both[:, c + 1 :].sum(axis=-2)
        return out

    def added(block, grown):
        """A block with its sums after some more trees, and without the rows of those it has been through."""
        codes, up, held, n, rest, z = block
        for feature, cut, value in grown:
            z = z + value[nodes_of(codes, feature, cut)]
        return codes, up, held, n, rest if rest.ndim == 1 else rest[len(grown) :], z

    def split(level, counts, pulls, feature, cut, value):
        """Best split of each node of a level: written into the tree with the values of the children."""
        first = 2**level - 1
        n, w = counts.sum(axis=2).cumsum(axis=2), (counts[:, :, 0] + weight * counts[:, :, 1]).cumsum(axis=2)
        s = pulls[:, :, 0].cumsum(axis=2)
        for k in range(2**level):
            every, total, whole = n[0, k, -1], w[0, k, -1], s[0, k, -1]
            if not every:
                continue
            if not level:
                value[0] = whole / total
            own = np.sort(rng.permutation(d)[:chosen])
            left, wl, sl = n[own, k, :-1], w[own, k, :-1], s[own, k, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (sl**2 / wl + (whole - sl) ** 2 / (total - wl) - whole**2 / total) / total
            gain = np.where((left < max(min_child, 1)) | (every - left < max(min_child, 1)), -np.inf, gain)
            best = int(gain.argmax()) if gain.size else -1
            if best < 0 or not (gain.flat[best] >= min_gain and gain.flat[best] > 1e-15):
                continue
            f, c = own[best // (width - 1)], best % (width - 1)
            node = first + k
            feature[node], cut[node] = f, c
            value[2 * node + 1] = s[f, k, c] / w[f, k, c]
            value[2 * node + 2] = (whole - s[f, k, c]) / (total - w[f, k, c])

    kept = StorageLevel.MEMORY_AND_DISK
    base = _blocks(rows, columns, label, edges, n).persist(kept)
    state, old, fitted, best, least = None, [], [], 0, np.inf
    try:
        for number in range(trees + 1):
            if number % COUNTED_TREES == 0:
                if number:
                    old.append(base)
                    base = base.map(lambda block, grown=tuple(fitted[-COUNTED_TREES:]): added(block, grown)).persist(kept)
                count = min(COUNTED_TREES, trees + 1 - number)
                state = base.map(lambda block, at=number, count=count: drawn(block, at, count)).persist(kept)
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            ahead = None
            for level in range(depth):
                if level and not (feature[2 ** (level - 1) - 1 : 2**level - 1] >= 0).any():
                    break
                if ahead is None:
                    paired = bool(pairs) and level + 1 < depth
                    counts, pulls, loss, held = gathered(state, number, feature, cut, level, paired)
                    if paired:
                        ahead, counts, pulls = (counts, pulls), alone(counts), alone(pulls)
                else:
                    (counts, pulls), ahead = (children(cells, level - 1, feature, cut) for cells in ahead), None
                if not level:
                    while old:
                        old.pop().unpersist()
                    if number and held and loss / held < least:
                        best, least = number, loss / held
                    elif number and held and loss / held > least:
                        return BoostedTrees(tuple(columns), tuple(edges), tuple(fitted[:best]))
                    if number == trees:
                        break
                split(level, counts, pulls, feature, cut, value)
            if number < trees:
                fitted.append((feature, cut, value if number == 0 else rate * value))
                old.append(state)
                if (number + 1) % COUNTED_TREES:
                    state = state.map(lambda block, tree=fitted[-1]: added(block, (tree,))).persist(kept)
    finally:
        for blocks in (*old, state, base):
            if blocks is not None:
                blocks.unpersist()
    return BoostedTrees(tuple(columns), tuple(edges), tuple(fitted[: best or trees]))
