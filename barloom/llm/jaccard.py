"""N-gram Jaccard join (2): documents linked by their sets of word shingles, through pages of a count-vector R-tree.

A set's shingles are hashed into groups; the counts of the groups are a point, and the sum of the coordinate minima of two
points bounds their overlap from above. Pages of the tree are R-trees over such points: leaves hold bounding boxes, a box
whose bound is under the overlap that a link needs is passed over, then single points, then the sets are compared.

One tree over all points would visit every leaf, as counts of unlike texts differ little from each other. So points are first
dealt to pages by an exact rule. A link allows at most t shingles in which the sets differ. Sets of like size are parted into
more than t groups by ranges of the hash; a differing shingle touches one group, so linked sets share the whole content of a
group. Pages are these (size band, group, content) triples, and only pages with at least two different sets matter. No shared
passage or frequent word makes a page large: only sets that agree in a whole group meet.

Within pages: equal sets are one point. Each page's best connected member is compared with all others first; that joins
nearly all groups of copies with one comparison per member. Pages that still hold several components are searched by the
R-tree, a large page in pairs of blocks, so no task holds a whole page; the pairs that its bounds leave form clusters, in
which the sets themselves are compared. Links inside a component are not looked for: what is returned is the component.
Nothing is dropped, capped or sampled.

Results in odd cases: a text without words has an empty set and is its own component; fewer than three words are one shingle;
rows with a null doc_id get their set's size and a null component; rows with the same doc_id are linked like others and share
the least id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map
from barloom.llm.common import WordHasher, discard, mix, python_map, shingle_hashes, ship, stage
from barloom.llm.components import components

WIDTH = 3
#: A link: OVER * shared >= UNDER * union.
OVER, UNDER = 100, 90
RATIO = 1.5
LEAF = 16
BLOCK = 1200
BITMAP_BITS = 22


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap by which sets of sizes a and b are linked."""
    return -(-UNDER * (a + b) // (OVER + UNDER))


class Pages:
    """Page keys of a set: hashes of the contents of its groups, for its own size band and the one below if a link can reach it."""

    def __init__(self):
        self.edges = [1]
        self.groups: list[int] = []

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size:
            high = max(self.edges[-1] + 1, int(self.edges[-1] * RATIO))
            self.edges.append(high)
            most = (high - 1) * OVER // UNDER
            differ = (high - 1 + most) * (OVER - UNDER) // (OVER + UNDER)  # grows with the sizes
            self.groups.append(differ + 1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Keys for sorted distinct hashes."""
        n = len(hashes)
        self._grow(n)
        band = int(np.searchsorted(self.edges, n, "right")) - 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
        out = [self._band(hashes, total, band)]
        if band and -(-n * UNDER // OVER) < self.edges[band]:
            out.append(self._band(hashes, total, band - 1))
        return np.concatenate(out)

    def _band(self, hashes: np.ndarray, total: np.ndarray, band: int) -> np.ndarray:
        least = self.groups[band]
        if least < 2:
            return np.zeros(0, np.uint64)
        groups = least + max(1, least // 10)
        cuts = np.array([(g << 64) // groups for g in range(1, groups)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])
        content = total[at[1:]] - total[at[:-1]]
        filled = at[1:] > at[:-1]
        number = mix(np.arange(groups, dtype=np.uint64) + np.uint64(band << 40))
        keys = mix(number + mix(content + (at[1:] - at[:-1]).astype(np.uint64)))
        return keys[filled] if int(filled.sum()) >= least else keys


def shingle_set(hasher: WordHasher, text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(hasher(text), WIDTH))


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit id of a set."""
    with np.errstate(over="ignore"):
        value = mix(np.array([np.sum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(hashes))]))[0]
    return int(value.astype(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, pages, seen = WordHasher(), Pages(), set()
    for batch in batches:
        sizes, ids, keys = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            hashes = shingle_set(hasher, text.as_py())
            own = set_id(hashes) if len(hashes) else None
            sizes.append(len(hashes))
            ids.append(own)
            if own is None or doc is None or own in seen:
                keys.append(None)
            else:
                seen.add(own)
                keys.append(pages.keys(hashes).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "sid", "keys"],
        )


def _picked(bitmap: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            wanted = batch.filter(pa.array((bitmap[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1))
            sets = [shingle_set(hasher, t.as_py()) for t in wanted.column("text")]
            ids = [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [wanted.column("doc_id").cast(pa.int64()), pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "sid", "hashes"],
            )

    return make


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, hashes) of the sets in ``wanted`` (sid, doc_id), from texts. A bitmap of fixed size keeps most other texts out early."""
    mask = (1 << BITMAP_BITS) - 1
    cell = F.expr(f"xxhash64(doc_id) & {mask}L")
    bits = wanted.select(cell.alias("c")).groupBy(F.expr("shiftright(c, 6)").alias("k")).agg(F.expr("bit_or(shiftleft(1L, CAST(c & 63 AS INT)))").alias("b"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for k, b in bits.collect():
        bitmap[k] = b
    placed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("cell", cell)
    found = arrow_map(placed, _picked(bitmap.view(np.uint64)), "doc_id bigint, sid bigint, hashes binary")
    return found.join(wanted, ["doc_id", "sid"]).groupBy("sid").agg(F.first("hashes").alias("hashes"))


def overlap(a: bytes, b: bytes) -> bool:
    """Whether two sets of hashes are linked."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    need = int(needed(np.int64(len(x)), np.int64(len(y))))
    if min(len(x), len(y)) < need:
        return False
    return len(x) + len(y) - len(np.union1d(x, y)) >= need


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        linked = [overlap(a, b) for a, b in zip(batch["hashes_a"], batch["hashes_b"])]
        yield batch.loc[linked, ["a", "b"]]


def resolution(size: int) -> int:
    """Groups of a set's point as a power of two: about three shingles in each."""
    return min(13, max(5, (size // 3).bit_length()))


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """Point of a set: counts of its groups. Groups of a lower resolution are sums of neighbours."""
    bits = resolution(len(hashes))
    return np.bincount((mix(hashes) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2" if len(hashes) < 1 << 16 else "<u4")


def points_of(vectors: list[np.ndarray]) -> np.ndarray:
    """Points at the lowest resolution among them."""
    least = min(map(len, vectors))
    return np.stack([v.astype(np.int32).reshape(least, -1).sum(axis=1) for v in vectors]).astype(np.int32)


class PageTree:
    """R-tree over points: leaves by recursive halving along the widest coordinate, with upper corners and least sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.leaves = self._split(np.arange(len(points)))
        self.upper = np.stack([points[leaf].max(axis=0) for leaf in self.leaves])
        self.least = np.array([sizes[leaf].min() for leaf in self.leaves])

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= LEAF:
            return [rows]
        own = self.points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = rows[np.argsort(own[:, axis], kind="stable")]
        half = len(order) // 2
        return self._split(order[:half]) + self._split(order[half:])

    def candidates(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose bound on the overlap with a point reaches what a link needs."""
        open_ = np.flatnonzero(np.minimum(self.upper, point).sum(axis=1) >= needed(np.int64(size), self.least))
        if not len(open_):
            return open_
        rows = np.concatenate([self.leaves[k] for k in open_])
        bound = np.minimum(self.points[rows], point).sum(axis=1)
        return rows[bound >= needed(np.int64(size), self.sizes[rows])]


class _Roots:
    """Union-find."""

    def __init__(self, names):
        self.parent = {int(x): int(x) for x in names}

    def __call__(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self(a), self(b)
        self.parent[a] = b
        return a != b


def tree_pairs(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of members of different labels that the R-tree's bounds leave; with two sides, only pairs across."""
    two = sides.min() != sides.max()
    tree = PageTree(points, sizes) if len(sizes) > LEAF else None  # a page of one leaf needs no boxes
    for i in range(len(sizes)):
        if tree:
            near = tree.candidates(points[i], int(sizes[i]))
            near = near[near > i]
        else:
            near = np.arange(i + 1, len(sizes))
            near = near[np.minimum(points[i + 1 :], points[i]).sum(axis=1) >= needed(sizes[i], sizes[i + 1 :])]
        near = near[labels[near] != labels[i]]
        for j in near[sides[near] != sides[i]] if two else near:
            yield i, int(j)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that lie together, without repeated members; one group is held at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        values = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip(cuts, cuts[1:]):
            part = batch.iloc[a:b]
            if held and (held[0][keys].iloc[0].to_numpy() != values[a]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _by_group(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """``function`` over the groups of ``keys``; many small groups share a batch."""
    placed = df.repartition(*keys).sortWithinPartitions(*keys)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, keys):
            rows = function(group)
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return python_map(placed, make, schema)


def _near(group: pd.DataFrame) -> list[tuple[int, int]]:
    """Members of a page that may be linked: a spanning forest of the pairs that the bounds leave."""
    vectors = [np.frombuffer(v, f"<u{w}") for v, w in zip(group["vector"], group["width"])]
    sids, found = group["sid"].to_numpy(), []
    roots = _Roots(sids)
    for i, j in tree_pairs(points_of(vectors), group["size"].to_numpy(), group["label"].to_numpy(), group["side"].to_numpy()):
        if roots.join(int(sids[i]), int(sids[j])):
            found.append((int(sids[i]), int(sids[j])))
    return found


def _linked(group: pd.DataFrame) -> list[tuple[int, int]]:
    """Links that connect different components among the members of a cluster or of two blocks of one."""
    data = list(group["hashes"])
    sets = [np.frombuffer(x, np.uint64) for x in data]
    sids, labels, found = group["sid"].to_numpy(), group["label"].to_numpy(), []
    roots = _Roots(labels)
    points = points_of([count_vector(x) for x in sets])
    for i, j in tree_pairs(points, np.array([len(x) for x in sets]), labels, group["side"].to_numpy()):
        a, b = int(labels[i]), int(labels[j])
        if roots(a) != roots(b) and overlap(data[i], data[j]):
            roots.join(a, b)
            found.append((int(sids[i]), int(sids[j])))
    return found


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch["hashes"]]
        vectors = [count_vector(x) for x in sets]
        yield pd.DataFrame({
            "sid": batch["sid"], "size": [len(x) for x in sets], "width": [v.itemsize for v in vectors], "vector": [v.tobytes() for v in vectors],
        })


def _in_blocks(members: DataFrame, key: str, several: DataFrame) -> DataFrame:
    """Members (key, sid, label) of the groups in ``several`` (key, _n), in pairs of blocks of at most about ``BLOCK`` members."""
    cut = members.join(several.select(key, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")), key)
    own = cut.withColumn("_own", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("_blocks")).cast("int"))
    return own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        key, "sid", "label", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("side"),
    )


def _search(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components, found by R-trees.

    Pages that hold several components are searched by points alone. The pairs that the bounds leave connect members to
    clusters; each member's set goes to its cluster once, where a tree over the cluster gives the pairs to compare.
    """
    labelled = members.join(labels, members["sid"] == labels["id"], "left").select("key", "sid", F.coalesce("label", "sid").alias("label"))
    counted = labelled.groupBy("key").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_n"),
        F.expr("bit_xor(xxhash64(sid))").alias("_x"), F.expr("bit_xor(xxhash64(sid, 1))").alias("_y"),
    ).where("_lo <> _hi")
    # pages with the same members are searched once
    several = counted.groupBy("_lo", "_hi", "_n", "_x", "_y").agg(F.min("key").alias("key"))
    pages = _in_blocks(labelled, "key", several)
    vectors = python_map(sets, _vectors, "sid bigint, size bigint, width int, vector binary")
    near = _by_group(pages.join(vectors, "sid"), ["key", "_i", "_j"], _near, "a bigint, b bigint")
    clusters = components(near)
    own = clusters.join(labels.select(F.col("id").alias("_id"), F.col("label").alias("_label")), F.col("id") == F.col("_id"), "left").select(
        F.col("label").alias("cluster"), F.col("id").alias("sid"), F.coalesce("_label", "id").alias("label")
    )
    grown = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    full = _in_blocks(own, "cluster", grown).join(sets, "sid")
    return _by_group(full, ["cluster", "_i", "_j"], _linked, "a bigint, b bigint")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per document."""
    ship(docs.sparkSession)
    profiles = stage(arrow_map(docs.select("doc_id", "text"), _profile, "doc_id bigint, n_shingles bigint, sid bigint, keys array<bigint>"), "profiles")
    # dealt by key once: counting the sets of a key and picking the rows of shared keys both read this one exchange
    keyed = profiles.where("keys IS NOT NULL").select("sid", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("sid").alias("_lo"), F.max("sid").alias("_hi")).where("_lo <> _hi").select("key")
    members = stage(keyed.join(shared, "key").select("key", "sid").distinct(), "page-members")
    degree = members.groupBy("sid").agg(F.count(F.lit(1)).alias("_d"))
    heads = members.join(degree, "sid").groupBy("key").agg(F.max_by("sid", "_d").alias("b"))
    pairs = stage(members.join(heads, "key").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    firsts = profiles.where("doc_id IS NOT NULL AND sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wanted = firsts.join(ends, "sid", "left_semi")
    sets = stage(_sets(docs, stage(wanted, "wanted")), "page-sets")
    first = pairs.join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    full = first.join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    links = stage(python_map(full, _verified, "a bigint, b bigint"), "links")
    labels = components(links)
    more = stage(_search(members, labels, sets), "tree-links")
    if more.limit(1).count():
        discard(labels)
        labels = components(links.union(more))
    discard(members, pairs, sets, links, more)
    return _numbered(profiles, labels)


def _numbered(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Components named by their least doc_id."""
    own = profiles.select("doc_id", "n_shingles", "sid")
    classes = own.where("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("_least"))
    named = classes.join(labels, classes["sid"] == labels["id"], "left").select("sid", "_least", F.coalesce("label", "sid").alias("_label"))
    least = named.groupBy("_label").agg(F.min("_least").alias("component_id"))
    mapped = named.join(least, "_label").select(F.col("sid").alias("_sid"), "component_id")
    full = own.where("sid IS NOT NULL AND doc_id IS NOT NULL").join(mapped, F.col("sid") == F.col("_sid")).select("doc_id", "n_shingles", "component_id")
    rest = own.where("sid IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(rest)
