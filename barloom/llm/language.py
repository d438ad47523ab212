"""Language ID (10): unigram piece models, summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary (byte strings, all single bytes included). The
probability of a word is the sum over all its segmentations, found by the forward algorithm; white space parts words. Long words
are scored in blocks of ``BLOCK`` bytes that hand on the last sums, scaled, so no segmentation is lost and memory is bounded. Only
in learning are words of more than ``RUN`` bytes counted in runs of that many. Probabilities are learned by expectation maximisation from
labelled texts, at most about ``SAMPLE`` documents of each language (picked by a hash of doc_id); expected counts are
computed in tasks, and only languages x pieces numbers come to the driver. Scoring covers every whole text.

Results in odd cases: ``und`` with score 0 where the text is null or has no letter, or where nothing was learned; ties go to
the name that sorts first; repeated rows repeat in the result; a null doc_id falls in no held-out fold and is not learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map, vocabulary_path
from barloom.llm.common import LOWER_BYTES, discard, fold_of, held, mix, python_map, slices, stage
from barloom.llm.piece_counts import vocabulary_pieces

SAMPLE = 1500
ROUNDS = 3
RUN = 32
#: Bytes of a word scored at once; longer words go block by block.
BLOCK = 64
HELD_OUT = 5
SMOOTHING = 0.1
_MEMO_NUMBERS = 1 << 20
_WORDS = 1 << 19
_ROWS = 1000


class Pieces:
    """Vocabulary with piece numbers; number ``size`` stands for no piece and has probability 0.

    Numbers are found for many words at once: 64-bit hashes of all their runs of bytes are looked up in tables by a few
    bits of the hash; the few pieces that meet in a place go to a further, smaller table.
    """

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        names = set(vocabulary_pieces(path)) | {bytes([b]) for b in range(256)}
        self.number = {p: i for i, p in enumerate(sorted(names))}
        self.size = len(self.number)
        self.longest = max(map(len, names))
        hashes = np.zeros(self.size, np.uint64)
        with np.errstate(over="ignore"):
            for p, i in self.number.items():
                h = 0
                for byte in p:
                    h = (h * int(self.STEP) + byte + 1) & 0xFFFFFFFFFFFFFFFF
                hashes[i] = h
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left, bits = np.arange(self.size), 20
        while len(left):
            shift = np.uint64(64 - bits)
            place = mix(hashes[left] + np.uint64(bits)) >> shift
            _, first = np.unique(place, return_index=True)
            keys, numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.size, np.int32)
            keys[place[first]], numbers[place[first]] = hashes[left[first]], left[first]
            self.tables.append((shift, keys, numbers))
            left, bits = np.delete(left, first), max(10, bits - 5)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, self.size, np.int32)
        for shift, keys, numbers in self.tables:
            place = (mix(hashes + np.uint64(64) - shift) >> shift).astype(np.int64)
            same = keys[place] == hashes
            out[same] = numbers[place[same]]
        return out

    def lattice(self, words: list[bytes]) -> np.ndarray:
        """Piece numbers [length - 1, end, word] of words of one length."""
        n = len(words[0])
        data = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        out = np.full((min(self.longest, n), n, len(words)), self.size, np.int32)
        hashes = np.zeros_like(data)
        for k in range(1, min(self.longest, n) + 1):
            hashes = hashes[: n - k + 1] * self.STEP + data[k - 1 :]
            out[k - 1, k - 1 :] = self._numbers(hashes)
        return out


def forward(lattice: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Sums over segmentations of all prefixes [length, word, language]; ``probs`` is [piece, language]."""
    longest, n, words = lattice.shape
    sums = np.zeros((n + 1, words, probs.shape[1]))
    sums[0] = 1.0
    for end in range(1, n + 1):
        for k in range(1, min(longest, end) + 1):
            sums[end] += sums[end - k] * probs[lattice[k - 1, end - 1]]
    return sums


def log_total(pieces: Pieces, words: list[bytes], probs: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Logarithms of the sums over all segmentations [word, language] of words of one length.

    A piece that ends in a block starts at most ``longest`` bytes before its end, so each block takes over so many sums; they are
    divided by their largest, whose logarithm is kept apart.
    """
    n = len(words[0])
    if n <= block:
        return np.log(np.maximum(forward(pieces.lattice(words), probs)[-1], 1e-300))
    scale = np.zeros((len(words), probs.shape[1]))
    before = np.ones((1, len(words), probs.shape[1]))
    for start in range(0, n, block):
        back, size = min(start, pieces.longest - 1), min(block, n - start)
        lattice = pieces.lattice([w[start - back : start + size] for w in words])
        sums = np.concatenate([before[-back - 1 :], np.zeros((size, *before.shape[1:]))])
        for end in range(back + 1, back + size + 1):
            most = min(len(lattice), end)
            sums[end] = (sums[end - most : end][::-1] * probs[lattice[:most, end - 1]]).sum(axis=0)
        before = sums[-pieces.longest :]
        top = np.maximum(before.max(axis=0), 1e-300)
        before, scale = before / top, scale + np.log(top)
    return scale + np.log(np.maximum(before[-1], 1e-300))


def backward(lattice: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Sums over segmentations of all suffixes, from each place to the end."""
    longest, n, words = lattice.shape
    sums = np.zeros((n + 1, words, probs.shape[1]))
    sums[n] = 1.0
    for start in range(n - 1, -1, -1):
        for k in range(1, min(longest, n - start) + 1):
            sums[start] += sums[start + k] * probs[lattice[k - 1, start + k - 1]]
    return sums


def runs(word: bytes) -> list[bytes]:
    return [word[i : i + RUN] for i in range(0, len(word), RUN)]


def by_length(words: list[bytes], most: int = 1 << 15) -> Iterator[list[int]]:
    """Places of words of equal length, in batches of at most ``most`` bytes or one word; a long word counts as one block."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or len(words[order[i]]) != len(words[order[start]]) or (i - start + 1) * min(len(words[order[start]]), 2 * BLOCK) > most:
            yield order[start:i]
            start = i



def pieces_of(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            own = counts.setdefault(lang, Counter())
            for part in slices(text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES)):
                own.update(r for w, n in Counter(part).items() for _ in range(n) for r in runs(w))
        rows = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"])


def _expected(path: str, langs: list[str], probs: np.ndarray | None):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces_of(path)
        total = np.zeros((len(langs), vocabulary.size + 1))
        at = {lang: i for i, lang in enumerate(langs)}
        flat = np.ones((vocabulary.size + 1, 1)) / vocabulary.size
        flat[-1] = 0.0
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                i = at[lang]
                own = flat if probs is None else np.ascontiguousarray(probs[:, i : i + 1])
                words, counts = list(rows["word"]), rows["n"].to_numpy(np.float64)
                for batch_at in by_length(words):
                    lattice = vocabulary.lattice([words[k] for k in batch_at])
                    ahead, behind = forward(lattice, own)[:, :, 0], backward(lattice, own)[:, :, 0]
                    weight = counts[batch_at] / np.maximum(ahead[-1], 1e-300)
                    for end in range(1, lattice.shape[1] + 1):
                        for k in range(1, min(vocabulary.longest, end) + 1):
                            ids = lattice[k - 1, end - 1]
                            share = weight * ahead[end - k] * own[ids, 0] * behind[end]
                            total[i] += np.bincount(ids, share, vocabulary.size + 1)
        i, piece = np.nonzero(total[:, :-1])
        yield pd.DataFrame({"i": i.astype(np.int32), "piece": piece.astype(np.int32), "n": total[i, piece]})

    return make


def learn(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities [piece, language], from the rows of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    known = docs.where((fold_of("doc_id", HELD_OUT) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per language
    langs = [r[0] for r in rows]
    vocab = pieces_of(path)
    if not langs:
        return [], np.zeros((vocab.size + 1, 0))
    grid = 1 << 30
    bound = F.lit(0)
    for lang, n in rows:
        bound = F.when(F.col("lang") == lang, int(grid * min(1.0, sample / n))).otherwise(bound)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < bound).select("lang", "text")
    counted = python_map(picked, _words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(counted, "language-words")
    probs = None
    for _ in range(rounds):
        found = python_map(words, _expected(path, langs, probs), "i int, piece int, n double")
        sums = found.groupBy("i", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((vocab.size + 1, len(langs)))
        counts[sums["piece"], sums["i"]] = sums["n"]
        counts[:-1] += SMOOTHING
        probs = counts / counts.sum(axis=0)
    discard(words)
    return langs, probs


class Scorer:
    """Log probabilities of texts for each language; the memo of words is emptied when full."""

    def __init__(self, path: str, probs: np.ndarray):
        self.pieces, self.probs = Pieces(path), probs
        self.limit = max(10_000, _MEMO_NUMBERS // max(1, probs.shape[1]))
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, self.probs.shape[1]))

    def _learn(self, words: list[bytes]) -> None:
        values = np.zeros((len(words), self.probs.shape[1]))
        for at in by_length(words):
            values[at] = log_total(self.pieces, [words[k] for k in at], self.probs)
        first = len(self.memo)
        while first + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(words)] = values
        self.memo.update(zip(words, range(first, first + len(words))))

    def score(self, texts: list[str]) -> np.ndarray:
        """Log probabilities [text, language]. New words of some megabytes of text are learned together."""
        out = np.zeros((len(texts), self.probs.shape[1]))
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in slices(text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES)):
                held.append((i, part))
                size += len(part)
                if size >= _WORDS:
                    self._sum(held, out)
                    held, size = [], 0
        self._sum(held, out)
        return out

    def _sum(self, held: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        at = [np.fromiter(map(self.memo.get, part, repeat(-1)), np.int64, len(part)) for _, part in held]
        new = list(dict.fromkeys(part[k] for (_, part), own in zip(held, at) for k in np.flatnonzero(own < 0)))
        if new:
            if len(self.memo) + len(new) > self.limit:
                self._reset()
                new = list(dict.fromkeys(w for _, part in held for w in part))
            self._learn(new)
            at = [np.fromiter(map(self.memo.__getitem__, part), np.int64, len(part)) for _, part in held]
        for (i, _), own in zip(held, at):
            out[i] += self.table[own].sum(axis=0)


def _predicted(path: str, langs: list[str], probs: np.ndarray, column: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("scorer", path, probs.tobytes()), lambda: Scorer(path, probs))
        for batch in batches:
            texts = batch.column(column)
            names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            for start in range(0, len(texts), _ROWS):
                part = [t or "" for t in texts.slice(start, _ROWS).to_pylist()]
                known = np.flatnonzero([bool(langs) and any(map(str.isalpha, t)) for t in part])
                if len(known):
                    logs = scorer.score([part[i] for i in known])
                    names[start + known] = np.array(langs, object)[logs.argmax(axis=1)]
                    scores[start + known] = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            kept = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(names, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"]
            )

    return make


def predict(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``keep`` columns, held_out, lang_pred and score, one row per document; learned from ``labelled`` (``docs`` by default)."""
    out = _predictions(docs, keep, vocabulary, labelled)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_held").alias("held_out"), "lang_pred", "score")


def keep_documents(docs: DataFrame, least: float, vocabulary: str | None = None) -> DataFrame:
    """``docs`` whose language is known with a score of ``least`` or more, columns as they were."""
    out = _predictions(docs, tuple(docs.columns), vocabulary, None)
    known = out.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return known.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])


def _predictions(docs: DataFrame, keep: tuple[str, ...], vocabulary: str | None, labelled: DataFrame | None) -> DataFrame:
    """``keep`` columns under names of their own, _held, lang_pred and score."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    langs, probs = learn(docs if labelled is None else labelled, path)
    column = f"_k{keep.index('text')}" if "text" in keep else "_text"
    own = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(fold_of("doc_id", HELD_OUT) == 0, F.lit(False)).alias("_held"),
        *([F.col("text").alias("_text")] if column == "_text" else []),
    )
    kinds = ", ".join(f"`{n}` {kind}" for n, kind in own.drop("_text").dtypes)
    return arrow_map(own, _predicted(path, langs, probs, column), f"{kinds}, lang_pred string, score double")
