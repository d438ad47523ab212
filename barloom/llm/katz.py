"""LM scoring (9): Katz backoff bigrams with Good-Turing discounts and exactly normalised backoff weights.

P(w | h) is d(r) r / c(h) for a pair seen r times in training, and alpha(h) P(w) otherwise; P(w) is d(c) c / N for a word
seen c times, and what the discounts leave over for the one unknown type. alpha(h) is what the seen pairs of h leave over,
divided by what the words seen after h leave over of P, so each context sums to one. Counts above ``K`` keep their value;
where all counts are above it, half an occurrence is set aside.

Work is dealt in two rounds of tables, each kept in partitions by a hash. Documents are gathered into batches of a few
megabytes with their distinct words. First every batch asks the word table, then the pair table, whose partitions are
chosen by the context, so that all continuations of a context are together; contexts with a large share of the tokens are
parted further by the pair, and their sums, a bounded number, are added up at the end. A batch asks once for each
distinct word or pair, with its own training count; so what is moved is pre-aggregated, and a frequent word or pair costs
each table no more than one entry per batch. Words stand as 64-bit hashes, continuations of a context as 48-bit ones.

Results in odd cases: a null or empty text is its end token; a null doc_id is neither learned from nor held out; without
training text every probability is that of the unknown type; repeated rows count and score each; an empty table gives an
empty result. Discounts that Good-Turing cannot give (missing counts of counts) are 1 - 1 / (2 r).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map
from barloom.llm.common import WordHasher, discard, fold_of, mix, parts_for, python_map, ship, stage

FOLDS, HELD_OUT = 7, 2
K = 5
BATCH_CHARS = 8 << 20
#: Hashes of the end token and of the context at the start of a text.
END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A657A657A657A6)
MOST_HOT_PARTS = 5000
BATCHES = "batch bigint, doc_ids array<bigint>, train array<boolean>, lengths array<bigint>, words binary, tokens binary"


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def packed_tokens(tokens: np.ndarray) -> bytes:
    """Places below 2^32 by planes of their bytes; frequent words have low places, so the upper planes are nearly empty."""
    return packed(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unpacked_tokens(data: bytes) -> np.ndarray:
    planes = unpacked(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0 to K (index 0 unused) from counts of counts n[1..K + 1]."""
    r = np.arange(K + 1)
    plain = 1.0 - 0.5 / np.maximum(r, 1)
    n = counts.astype(np.float64)
    if (n[1:] <= 0).any():
        return plain
    top = (K + 1) * n[K + 1] / n[1]
    d = np.ones(K + 1)
    d[1:] = ((r[1:] + 1) * n[2:] / (r[1:] * n[1:-1]) - top) / (1 - top) if top < 1 else -1.0
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else plain


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounts."""
    return np.where(r <= K, d[np.minimum(r, K)] * r, r.astype(np.float64))


def count_of_counts(r: np.ndarray) -> np.ndarray:
    return np.bincount(r[(r > 0) & (r <= K + 1)].astype(np.int64), minlength=K + 2)


class Words:
    """Word probabilities from totals of the word table."""

    def __init__(self, tokens: int, types: int, counts: np.ndarray):
        self.tokens, self.types, self.d = tokens, types, discounts(counts)
        n = counts.astype(np.float64)
        small = (n[1 : K + 1] * np.arange(1, K + 1) * (1 - self.d[1:])).sum()
        if tokens and not small:  # no count is small enough for a discount: half a token is set aside
            small = 0.5
        self.kept = 1.0 - 0.5 / tokens if tokens and not (n[1 : K + 1] > 0).any() else 1.0
        self.unknown = small / tokens if tokens else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        seen = discounted(c, self.d) * self.kept / max(1, self.tokens)
        return np.where(c > 0, seen, self.unknown)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, task = WordHasher(), TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    docs, train, size, number = [], [], 0, 0

    def row() -> pa.RecordBatch:
        words, tokens, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words, tokens = words[order], place[tokens]
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())),
            pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()), pa.array([packed_tokens(tokens)], pa.binary()),
        ], names=[c.split()[0] for c in BATCHES.split(", ")])

    for batch in batches:
        for doc, learn, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            held.append(np.append(hasher(text), END))
            docs.append(doc)
            train.append(learn)
            size += len(text)
            if size >= BATCH_CHARS:
                yield row()
                held, docs, train, size, number = [], [], [], 0, number + 1
    if held:
        yield row()


class Batch:
    """A gathered batch: distinct words, tokens as places among them, and which tokens are learned from."""

    def __init__(self, r, parts: int):
        self.words, self.tokens = np.frombuffer(r["words"], np.uint64), unpacked_tokens(r["tokens"])
        self.lengths = np.array(r["lengths"], np.int64)
        self.learned = np.repeat(np.array([bool(t) for t in r["train"]], bool), self.lengths)
        self.part = (mix(self.words) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(self.part, kind="stable")
        self.parts = parts

    def word_cuts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Places of distinct words by part, in an order that the table's answer keeps."""
        cuts = np.searchsorted(self.part[self.order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            yield int(p), self.order[cuts[p] : cuts[p + 1]]

    def word_counts(self, answers) -> np.ndarray:
        """Counts of distinct words from the table's answers (part, data)."""
        found = {int(part): data for part, data in answers}
        out = np.zeros(len(self.words), np.int64)
        for p, at in self.word_cuts():
            out[at] = unpacked(found[p], "<u4")
        return out

    def pairs(self, counts: np.ndarray, hot_from: float) -> None:
        """Distinct (context, word) pairs in the order of parts, contexts and continuations."""
        n = len(self.words)
        both = self.tokens.astype(np.int64)
        both[1:] += self.tokens[:-1].astype(np.int64) * (n + 1)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        both[starts] = self.tokens[starts].astype(np.int64) + n * (n + 1)
        distinct, at = np.unique(both, return_inverse=True)
        del both
        own, word = distinct // (n + 1), distinct % (n + 1)
        contexts = np.append(self.words, START)
        cold = np.append(counts <= hot_from, False)
        context = contexts[own]
        hashed = mix(self.words[word] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        place = np.where(cold[own], mix(context ^ np.uint64(0x3C3C3C3C3C3C3C3C)), mix(context + hashed))
        part = (place % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((own, part))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.pair_of = rank[at]
        del at, rank
        self.context_at, self.word_at = own[order], word[order]
        self.pair_part, self.pair_context, self.pair_word = part[order], context[order], hashed[order] & np.uint64((1 << 48) - 1)
        self.pair_learned = np.bincount(self.pair_of[self.learned], minlength=len(order))
        self.pair_cold = cold[self.context_at]

    def pair_cuts(self) -> Iterator[tuple[int, slice]]:
        cuts = np.searchsorted(self.pair_part, np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            yield int(p), slice(int(cuts[p]), int(cuts[p + 1]))


def _ask_words(parts: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.to_dict("records"):
                batch = Batch(r, parts)
                counts = np.bincount(batch.tokens[batch.learned], minlength=len(batch.words)).astype("<u4")
                out = [(p, r["batch"], batch.words[at].tobytes(), packed(counts[at])) for p, at in batch.word_cuts()]
                yield pd.DataFrame(out, columns=["part", "batch", "words", "counts"])

    return make


ANSWERS = "batch bigint, part int, data binary, more binary, flags binary, numbers array<bigint>"


def _answer_words(group: pd.DataFrame) -> pd.DataFrame:
    """Counts for each asking batch, and one row of totals: tokens, types, counts of counts."""
    asked = [np.frombuffer(w, np.uint64) for w in group["words"]]
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    given = np.concatenate([unpacked(c, "<u4") for c in group["counts"]]).astype(np.float64)
    counts = np.bincount(at, given).astype(np.int64)
    part, ends = int(group["part"].iloc[0]), np.cumsum([len(a) for a in asked])
    out = [(b, part, packed(counts[at[e - len(a) : e]].astype("<u4")), None, None, None) for b, a, e in zip(group["batch"], asked, ends)]
    totals = [int(counts.sum()), int((counts > 0).sum()), *count_of_counts(counts)]
    return pd.DataFrame([*out, (None, part, None, None, None, totals)], columns=["batch", "part", "data", "more", "flags", "numbers"]).astype({"batch": "Int64"})


def _ask_pairs(parts: int, hot_from: float):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.to_dict("records"):
                batch = Batch(r, parts)
                counts = batch.word_counts((a["part"], a["data"]) for a in r["answers"])
                batch.pairs(counts, hot_from)
                for p, cut in batch.pair_cuts():
                    context = batch.pair_context[cut]
                    new = np.concatenate([[True], context[1:] != context[:-1]])
                    word = batch.pair_word[cut]
                    yield pd.DataFrame([(
                        p, r["batch"], context[new].tobytes(), packed(np.diff(np.append(np.flatnonzero(new), len(new))).astype("<u4")),
                        (word & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (word >> np.uint64(32)).astype("<u2").tobytes(),
                        packed(batch.pair_learned[cut].astype("<u4")), packed(counts[batch.word_at[cut]].astype("<u4")),
                        packed(batch.pair_cold[cut][new]),
                    )], columns=["part", "batch", "contexts", "sizes", "words", "counts", "word_counts", "cold"])

    return make


def _answer_pairs(words: Words):
    def make(group: pd.DataFrame) -> pd.DataFrame:
        """For each asking batch the counts of its pairs and, for contexts of its unseen pairs, the sums that alpha needs.

        Further rows: counts of counts of the part, and the sums of its hot contexts.
        """
        part = int(group["part"].iloc[0])
        contexts = np.concatenate([np.frombuffer(c, np.uint64) for c in group["contexts"]])
        sizes = np.concatenate([unpacked(s, "<u4") for s in group["sizes"]]).astype(np.int64)
        cold = np.concatenate([unpacked(c, "?") for c in group["cold"]])
        lengths = [len(w) // 6 for w in group["words"]]
        word = np.concatenate([
            np.frombuffer(w, "<u4", n).astype(np.uint64) + (np.frombuffer(w, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))
            for w, n in zip(group["words"], lengths)
        ])
        names, context_at = np.unique(contexts, return_inverse=True)
        pair_context = np.repeat(context_at, sizes)
        keys = mix(names[pair_context]) + mix(word + np.uint64(1))
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        r = np.bincount(at, np.concatenate([unpacked(c, "<u4") for c in group["counts"]]).astype(np.float64)).astype(np.int64)
        c = np.concatenate([unpacked(c, "<u4") for c in group["word_counts"]]).astype(np.int64)[first]
        owner, seen = pair_context[first], r > 0
        sums = np.zeros((len(names), K + 2))
        np.add.at(sums, (owner[seen & (r <= K)], r[seen & (r <= K)] - 1), 1.0)
        sums[:, K] = np.bincount(owner, np.where(r > K, r, 0), len(names))
        sums[:, K + 1] = np.bincount(owner, np.where(seen, words.probability(c), 0.0), len(names))
        whole = sums[:, :K].sum(axis=1) == 0
        out, pair_end, context_end = [], 0, 0
        for b, n, data in zip(group["batch"], lengths, group["contexts"]):
            own = r[at[pair_end : pair_end + n]]
            k = len(data) // 8
            near = context_at[context_end : context_end + k]
            size = sizes[context_end : context_end + k]
            unseen = np.bincount(np.repeat(np.arange(k), size)[own == 0], minlength=k) > 0
            asked = unseen & cold[context_end : context_end + k]
            out.append((b, part, packed(own.astype("<u4")), packed(sums[near[asked]]), packed(whole[near]), None))
            pair_end, context_end = pair_end + n, context_end + k
        out.append((None, part, None, None, None, count_of_counts(r).tolist()))
        hot = np.unique(context_at[~cold])
        if len(hot):
            out.append((None, part, names[hot].tobytes(), sums[hot].tobytes(), None, None))
        return pd.DataFrame(out, columns=["batch", "part", "data", "more", "flags", "numbers"]).astype({"batch": "Int64"})

    return make


def _score(parts: int, hot_from: float, words: Words, pair_d: np.ndarray, starts: int, hot: dict[int, np.ndarray]):
    schema = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.to_dict("records"):
                batch = Batch(r, parts)
                counts = batch.word_counts((a["part"], a["data"]) for a in r["answers"])
                batch.pairs(counts, hot_from)
                found = {a["part"]: a for a in r["pair_answers"]}
                logs = np.empty(len(batch.pair_part))
                for p, cut in batch.pair_cuts():
                    seen = unpacked(found[p]["data"], "<u4").astype(np.int64)
                    context, at = batch.pair_context[cut], batch.context_at[cut]
                    c = np.append(counts, starts)[at]
                    new = np.concatenate([[True], context[1:] != context[:-1]])
                    run = np.cumsum(new) - 1
                    k = int(new.sum())
                    sums = np.zeros((k, K + 2))
                    asked = (np.bincount(run[seen == 0], minlength=k) > 0) & batch.pair_cold[cut][new]
                    sums[asked] = unpacked(found[p]["more"], "<f8").reshape(-1, K + 2)
                    whole = unpacked(found[p]["flags"], "?").copy()
                    for i in np.flatnonzero(~batch.pair_cold[cut][new]):
                        sums[i] = hot[int(context[new][i])]
                        whole[i] = not sums[i, :K].any()
                    total = np.maximum(c[new], 1)
                    share = np.where(whole, 1.0 - 0.5 / total, 1.0)  # no count is small enough for a discount: half a pair is set aside
                    kept = (sums[:, :K] @ (pair_d[1:] * np.arange(1, K + 1)) + sums[:, K]) / total
                    alpha = np.where(c[new] > 0, np.where(whole, 0.5 / total, 1.0 - kept) / (1.0 - sums[:, K + 1]), 1.0)
                    single = words.probability(counts[batch.word_at[cut]])
                    full = discounted(seen, pair_d) * share[run] / np.maximum(c, 1)
                    logs[cut] = np.log10(np.where(seen > 0, full, np.maximum(alpha[run], 1e-300) * single))
                ends = np.cumsum(batch.lengths)
                begins = ends - batch.lengths
                base = np.log10((counts + 1) / (words.tokens + words.types + 1))
                token = [base[batch.tokens], logs[batch.pair_of], (counts > 0)[batch.tokens]]
                base_sum, pair_sum, known = (np.add.reduceat(x.astype(np.float64), begins) for x in token)
                yield pd.DataFrame(dict(zip(schema, (
                    pd.array(list(r["doc_ids"]), "Int64"), [bool(t) for t in r["train"]], batch.lengths, known.astype(np.int64), base_sum, pair_sum,
                ))))

    return make


def _with_answers(gathered: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Batches with an array of the answers they got; a batch has at most one answer per part."""
    own = answers.where("batch IS NOT NULL").groupBy(F.col("batch").alias("_b")).agg(F.collect_list(F.struct("part", "data", "more", "flags")).alias(name))
    return gathered.join(own, gathered["batch"] == own["_b"]).drop("_b")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per document."""
    ship(docs.sparkSession)
    parts = parts_for(docs, 24 << 20)
    fold = fold_of("doc_id", FOLDS)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold != HELD_OUT, F.lit(False)).alias("train"), "text")
    gathered = stage(arrow_map(placed, _gather, BATCHES), "lm-batches", "none")
    asked = python_map(gathered, _ask_words(parts), "part int, batch bigint, words binary, counts binary")
    answers = stage(asked.groupBy("part").applyInPandas(_answer_words, ANSWERS), "lm-words")
    totals = [r["numbers"] for r in answers.where("numbers IS NOT NULL").select("numbers").collect()]  # one row per part
    sums = np.array(totals, np.int64).sum(axis=0) if totals else np.zeros(K + 4, np.int64)
    words = Words(int(sums[0]), int(sums[1]), sums[2:])
    starts = gathered.select(F.expr("aggregate(train, 0L, (a, t) -> a + IF(t, 1, 0))").alias("n")).agg(F.sum("n")).first()[0] or 0
    hot_from = words.tokens / (4 * min(parts, MOST_HOT_PARTS))  # at most so many contexts are above it
    first = stage(_with_answers(gathered, answers, "answers"), "lm-asking", "none")
    discard(gathered, answers)
    pairs = python_map(
        first, _ask_pairs(parts, hot_from),
        "part int, batch bigint, contexts binary, sizes binary, words binary, counts binary, word_counts binary, cold binary",
    )
    found = stage(pairs.groupBy("part").applyInPandas(_answer_pairs(words), ANSWERS), "lm-pairs")
    counted = [r["numbers"] for r in found.where("numbers IS NOT NULL").select("numbers").collect()]  # one row per part
    pair_d = discounts(np.array(counted, np.int64).sum(axis=0) if counted else np.zeros(K + 2, np.int64))
    hot: dict[int, np.ndarray] = {}
    partial = found.where("batch IS NULL AND data IS NOT NULL").select("data", "more")
    for r in partial.toLocalIterator():  # at most 4 * parts contexts, one row of them per part
        for name, values in zip(np.frombuffer(r["data"], np.uint64), np.frombuffer(r["more"], np.float64).reshape(-1, K + 2)):
            hot[int(name)] = hot.get(int(name), 0) + values
    both = _with_answers(first, found, "pair_answers")
    scored = python_map(
        both, _score(parts, hot_from, words, pair_d, int(starts), hot),
        "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
