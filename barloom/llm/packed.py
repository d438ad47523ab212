"""Token-ID output (1): a file format of rANS-coded blocks, written and read by Spark.

A file set is a folder with ``blocks`` (Parquet rows that are independent blocks of whole documents, in ascending order
of document id) and ``model`` (the shared frequency table). A block holds:

* ``payload``: little-endian 32-bit words of ``LANES`` interleaved range-ANS states (64-bit state, 32-bit output);
* ``marks``: a checkpoint at every ``STEPS`` rows of lanes: word offset and the lane states, so that decoding can start there;
* ``crc32`` of the ids as little-endian unsigned 32-bit numbers, checked when a block is read;
* ``doc_ids``, ``lengths`` and ``start``: which documents, their numbers of ids, and the ids of all documents before.

Frequencies are counted over all ids and scaled to 2^SCALE, at least 1 for each id that occurs. Texts are parted by ranges
of doc_id, so no task sees more than its range; a block closes at ``BLOCK`` ids, and a longer document is a block.

Results in odd cases: a null or empty text has only the end id; repeated doc_ids keep one entry for each row, in an order
set by their texts; rows with a null doc_id come first; an empty table gives a file set without blocks.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map, encoder, vocabulary_path
from barloom.llm.common import discard, parts_for, python_map, shared_folder, stage

SCALE = 20
LANES = 2048
STEPS = 64
BLOCK = 1 << 18
LOW = np.uint64(1 << 31)
END_ID = 0
STAGED = "part int, block int, before bigint, doc_ids array<bigint>, lengths array<bigint>, ids binary, counts binary"
BLOCKS = "part int, block int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, start bigint, crc32 bigint, payload binary, marks binary"


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to 2^SCALE in all, at least 1 where the count is not 0."""
    total, room = counts.sum(), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    scaled = np.where(counts > 0, np.maximum(1, counts * room // total), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    spare = room - int(scaled.sum())
    for i in order if spare < 0 else order[:1]:
        change = spare if spare > 0 else max(spare, 1 - int(scaled[i]))
        scaled[i] += change
        spare -= change
        if not spare:
            break
    return scaled


class Coder:
    """Encoder and decoder of blocks for one frequency table."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(frequencies)]).astype(np.uint64)
        self.slot = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints of a block."""
        rows = -(-len(ids) // LANES)
        freq, cum = self.freq[ids], self.cum[ids]
        states = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        shift, half, limit = np.uint64(SCALE), np.uint64(32), np.uint64(63 - SCALE)
        written = 0
        for row in range(rows - 1, -1, -1):
            f, c = freq[row * LANES : (row + 1) * LANES], cum[row * LANES : (row + 1) * LANES]
            x = states[: len(f)]
            over = (x >> limit) >= f
            if over.any():
                words.append(x[over].astype("<u4"))
                written += len(words[-1])
                x = np.where(over, x >> half, x)
            q = x // f
            states[: len(f)] = (q << shift) + (x - q * f) + c
            if row % STEPS == 0:
                marks.append((written, states.copy()))
        body = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        out = [np.array([written - at], "<u8").tobytes() + state.astype("<u8").tobytes() for at, state in reversed(marks)]
        return body.tobytes(), b"".join(out)

    def decode(self, payload: bytes, marks: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the checkpoints ``first`` to ``last`` (not included; all by default) of a block of ``n`` ids."""
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        words, table = np.frombuffer(payload, "<u4"), np.frombuffer(marks, "<u8").reshape(-1, LANES + 1)
        if not n:
            return np.zeros(0, np.uint32)
        at, states = int(table[first, 0]), table[first, 1:].astype(np.uint64)
        begin, end = first * STEPS * LANES, n if last is None else min(n, last * STEPS * LANES)
        out = np.zeros(end - begin, np.uint32)
        mask, shift, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for row in range(begin, end, LANES):
            width = min(LANES, n - row, end - row)
            x = states[:width]
            low = x & mask
            ids = self.slot[low]
            out[row - begin : row - begin + width] = ids
            x = self.freq[ids] * (x >> shift) + low - self.cum[ids]
            under = x < LOW
            need = int(under.sum())
            if need:
                x[under] = (x[under] << half) | words[at : at + need]
                at += need
            states[:width] = x
        return out


def _narrow(path: str) -> str:
    """Type in which ids of a vocabulary are staged."""
    with open(path, encoding="utf-8") as file:
        return "<u2" if max(json.load(file)["model"]["vocab"].values(), default=0) < 1 << 16 else "<u4"


def _blocks_of(path: str, end_id: int, kind: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        part, block, before, size, held, docs = 0, 0, 0, 0, [], []
        total = np.zeros(1, np.int64)

        def row(counts: bytes | None = None) -> pa.RecordBatch:
            nonlocal total
            ids = np.concatenate(held)
            seen = np.bincount(ids, minlength=len(total))
            seen[: len(total)] += total
            total = seen
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                pa.array([ids.tobytes()], pa.binary()), pa.array([counts], pa.binary()),
            ], names=["part", "block", "before", "doc_ids", "lengths", "ids", "counts"])

        for batch in batches:
            parts, ids = batch.column("part").to_pylist(), batch.column("doc_id").to_pylist()
            for part, doc, found in zip(parts, ids, code.encode_texts(batch.column("text"))):
                own = np.empty(len(found) + 1, kind)
                own[:-1], own[-1] = found, end_id
                held.append(own)
                docs.append(doc)
                size += len(own)
                if size >= BLOCK:
                    yield row()
                    block, before, size, held, docs = block + 1, before + size, 0, [], []
        if held:
            yield row()
        seen = np.flatnonzero(total)
        if len(seen):
            pairs = np.stack([seen, total[seen]]).astype("<i8").tobytes()
            held, docs, block = [np.zeros(0, kind)], [], -1
            yield row(pairs)

    return make


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["counts"]:
            seen, n = np.frombuffer(data, "<i8").reshape(2, -1)
            yield pd.DataFrame({"id": seen, "n": n})


def _coded(frequencies: np.ndarray, kind: str):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(frequencies)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                ids = np.frombuffer(r.ids, kind)
                payload, marks = coder.encode(ids)
                out.append(dict(part=r.part, block=r.block, doc_ids=r.doc_ids, lengths=r.lengths, n_ids=len(ids),
                                start=r.start, crc32=zlib.crc32(ids.astype("<u4")), payload=payload, marks=marks))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return make


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) into the file set at ``folder``."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    n = parts_for(docs, 32 << 20)
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    placed = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = _narrow(path)
    staged = stage(arrow_map(placed, _blocks_of(path, end_id, kind), STAGED), "token-blocks")
    counted = python_map(staged.select("counts").where("counts IS NOT NULL"), _counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    found = {r["id"]: r["n"] for r in counted.collect()}  # one row per id of the vocabulary at most
    counts = np.zeros(max(found, default=0) + 1, np.int64)
    for k, v in found.items():
        counts[k] = v
    frequencies = scaled_frequencies(counts)
    seen = np.flatnonzero(frequencies)
    model = pd.DataFrame({"id": seen, "frequency": frequencies[seen]}, dtype="int64")
    spark.createDataFrame(model, "id bigint, frequency bigint").coalesce(1).write.parquet(f"{folder}/model")
    # one row per partition, and parts_for bounds the number of those
    parts = staged.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("_own"))
    bases = parts.selectExpr("part", "sum(_own) OVER (ORDER BY part) - _own AS _base")
    placed = staged.where("block >= 0").join(F.broadcast(bases), "part").select(
        "part", "block", "doc_ids", "lengths", "ids", (F.col("_base") + F.col("before")).alias("start")
    )
    coded = python_map(placed, _coded(frequencies, kind), BLOCKS)
    coded.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    discard(staged)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit numbers)."""
    model = spark.read.parquet(f"{folder}/model").toPandas()
    frequencies = np.zeros(int(model["id"].max() if len(model) else 0) + 1, np.int64)
    frequencies[model["id"]] = model["frequency"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for r in batch.to_pylist():
                ids = coder.decode(r["payload"], r["marks"], r["n_ids"]).astype("<u4", copy=False)
                if zlib.crc32(ids) != r["crc32"]:
                    raise ValueError(f"block {r['part']}/{r['block']}: checksum differs")
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                columns = [
                    pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["start"]), pa.array(lengths),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(zip(names, ("bigint", "bigint", "bigint", "bigint", "binary")))
    return arrow_map(spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), make, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, as read back from the files written for ``docs``."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, vocabulary)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return read(spark, folder, with_ids=False)
