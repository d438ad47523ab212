"""Shared helpers: staging in the shared folder, reading tables, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that part words.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SLICE = 1 << 22
_MEMO_LIMIT = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a folder of its own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files, whichever executor is lost.

    Shuffle files of the write go when it ends; the files themselves go when the session ends, or by ``discard``.
    """
    spark = df.sparkSession
    location = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(location)
    finally:
        spark.conf.set(_CLEANUP, before)
    path, files = _path(spark, location)
    files.deleteOnExit(path)
    staged = spark.read.schema(df.schema).parquet(location)
    staged.staged_at = location
    return staged


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per application, so that tasks can import them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        archive = Path(folder) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in [package / "__init__.py", *sorted(Path(__file__).parent.glob("*.py"))]:
                out.write(file, file.relative_to(package.parent))
        location = f"{shared_folder(spark)}/{package.name}-{uuid.uuid4().hex}.zip"
        path, files = _path(spark, location)
        files.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{archive}"), path)
    files.deleteOnExit(path)
    context.addPyFile(location)
    _SHIPPED.add(context.applicationId)


def python_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """What ``make`` gives, kept for later tasks of this Python worker; a worker keeps one such thing, so memory stays bounded."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def discard(*staged: DataFrame) -> None:
    """Delete staged files that no later step reads."""
    for df in staged:
        path, files = _path(df.sparkSession, df.staged_at)
        files.delete(path, True)


#: Rows of ids up to which ``small_side`` broadcasts: some tens of MB.
SMALL_ROWS = 2_000_000


def small_side(ids: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A staged frame of a few numbers a row, marked for broadcast if it counts ``most`` rows at most; else left to Spark's joins."""
    return F.broadcast(ids) if ids.count() <= most else ids


def fold_of(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(column, UPPER, LOWER)


def parts_for(df: DataFrame, bytes_each: int = 64 << 20, least: int = 1) -> int:
    """Partitions for a frame, from Spark's size estimate of its files and the session's setting."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // bytes_each))


class WordHasher:
    """64-bit hashes of white-space words; the memo of seen words is emptied when full, so memory is bounded."""

    def __init__(self, fold: bytes = LOWER_BYTES, limit: int = _MEMO_LIMIT):
        self.fold, self.limit, self.memo = fold, limit, {}

    def __call__(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass").translate(self.fold)
        parts = [self._hashes(words) for words in slices(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        digest = xxhash.xxh64_intdigest
        for w in {w for w in words if w not in memo}:
            memo[w] = digest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def slices(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in slices of a few megabytes, cut between words."""
    start = 0
    while start < len(data):
        end = min(len(data), start + _SLICE)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[start:end].split()
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wrap-around arithmetic)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words; fewer words make one run, none make none."""
    if not len(words):
        return words
    take = min(width, len(words))
    total = np.full(len(words) - take + 1, take, np.uint64)
    for k in range(take):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - take + 1 + k])
    return total
