"""Toxicity (12): a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct runs of 2 to 5 characters, lower-cased, with white space as single blanks. From labelled
texts each n-gram gets the logarithm of its smoothed share among toxic texts over that among others; n-grams whose ratio is
under ``SIGMAS`` standard errors, or that occur in fewer than ``LEAST_TEXTS`` texts, are left out. A logistic regression is
fitted on the present n-grams' ratios, both classes weighing the same, and its weights times the ratios score every whole text.

It is fitted on about ``SAMPLE`` labelled texts of each class at most, picked by a hash of doc_id; that bounds the n-grams
too, the only thing that comes to the driver. N-grams are told apart by 64-bit hashes.

Results in odd cases: null and empty texts get the score of a text without any known n-gram; a null doc_id is not held out
and not learned from; a document labelled twice counts as toxic if one label says so; labels other than 0 and 1 are not
used; without texts of both classes every score is the share of toxic ones among those there are, 0 if none; repeated rows
repeat in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.chunks import arrow_map
from barloom.llm.common import discard, fold_of, held, mix, stage

ORDERS = (2, 3, 4, 5)
SAMPLE = 4000
LEAST_TEXTS = 3
SIGMAS = 3.0
SMOOTHING = 1.0
PENALTY = 1e-3
HELD_OUT = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20
_BITS = 20
_HELD_GRAMS = 1 << 22


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, in pieces of about a million characters that overlap by the longest order less one."""
    whole = f" {' '.join((text or '').lower().split())} "
    if whole == "  ":
        return
    for start in range(0, len(whole), _SLICE):
        part = whole[start : start + _SLICE + ORDERS[-1] - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        rolled, out = codes, []
        for n in range(2, ORDERS[-1] + 1):
            rolled = rolled[:-1] * _STEP + codes[n - 1 :]
            if n in ORDERS:
                # n-grams that begin in the overlap belong to the next piece
                out.append(mix(rolled[:_SLICE] + np.uint64(n)))
        yield np.concatenate(out)


def distinct_grams(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for h in gram_hashes(text))]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, clean): in how many texts of each class; summed up for some million n-grams at a time."""

    def summed() -> pa.RecordBatch:
        grams, at = np.unique(np.concatenate(found), return_inverse=True)
        toxic = np.bincount(at, np.concatenate(marks), len(grams)).astype(np.int64)
        columns = [grams.view(np.int64), toxic, np.bincount(at, minlength=len(grams)) - toxic]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "toxic", "clean"])

    found, marks, size = [], [], 0
    for batch in batches:
        for text, mark in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            found.append(distinct_grams(text.as_py()))
            marks.append(np.full(len(found[-1]), mark, np.int8))
            size += len(found[-1])
            if size >= _HELD_GRAMS:
                yield summed()
                found, marks, size = [], [], 0
    if size:
        yield summed()


def _present(grams: np.ndarray):
    """Numbers of the chosen n-grams (sorted hashes ``grams``) that each text holds."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.flatnonzero(np.isin(grams, distinct_grams(t.as_py()), assume_unique=True)).astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(ids, pa.list_(pa.int32()))], names=["toxic", "ids"])

    return make


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the labelled documents to learn from: outside the held-out fold, about ``most`` of each class at most."""
    marks = labels.where((fold_of("doc_id", HELD_OUT) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    grid = 1 << 30
    bound = F.when(F.col("toxic") == 1, int(grid * min(1.0, most / sizes.get(1, 1)))).otherwise(int(grid * min(1.0, most / sizes.get(0, 1))))
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < bound).select(F.col("doc_id").alias("_id"), "toxic")
    # about 2 * most rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def ratios(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-count ratios of the n-grams of ``texts`` (text, toxic) whose ratio stands out."""
    found = arrow_map(texts, _counts, "gram bigint, toxic bigint, clean bigint")
    grams = stage(found.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-grams")
    p, q = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    total = grams.agg(F.sum(p).alias("p"), F.sum(q).alias("q")).first()
    ratio = F.log(p / F.lit(total["p"])) - F.log(q / F.lit(total["q"]))
    sure = F.abs(ratio) >= SIGMAS * F.sqrt(1 / p + 1 / q)
    rows = grams.where((F.col("toxic") + F.col("clean") >= LEAST_TEXTS) & sure).select("gram", ratio.alias("ratio")).toPandas()
    discard(grams)
    hashes = rows["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["ratio"].to_numpy(np.float64)[order]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes of n-grams, their weights, and the constant, from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    texts = stage(sample(docs, labels, most).repartition(8), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    none = np.zeros(0, np.uint64), np.zeros(0)
    if len(sizes) < 2:
        return *none, np.inf if sizes.get(1) else -np.inf
    grams, ratio = ratios(texts)
    if not len(grams):
        return *none, 0.0
    rows = stage(arrow_map(texts, _present(grams), "toxic int, ids array<int>"), "toxic-rows")
    vector = F.udf(lambda ids: Vectors.sparse(len(ratio), ids, ratio[ids]), VectorUDT())
    weight = F.when(F.col("toxic") == 1, 1.0 / sizes[1]).otherwise(1.0 / sizes[0])
    frame = rows.select(vector("ids").alias("x"), F.col("toxic").cast("double").alias("y"), weight.alias("weight"))
    model = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="weight", regParam=PENALTY, standardization=False, maxIter=60, tol=1e-4
    ).fit(frame)
    discard(rows, texts)
    return grams, model.coefficients.toArray() * ratio, float(model.intercept)


class Scorer:
    """Sums of the weights of a text's distinct n-grams; a table by the first bits passes over most n-grams that have none."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, constant: float):
        self.grams, self.weights, self.constant = grams, weights, constant
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def __call__(self, text: str | None) -> float:
        found = [np.zeros(0, np.uint64)]
        if len(self.grams):
            for hashes in gram_hashes(text):
                found.append(np.unique(hashes[self.seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]]))
        hashes = np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]
        at = np.searchsorted(self.grams, hashes)
        at[at == len(self.grams)] = 0
        z = self.constant + (float(self.weights[at[self.grams[at] == hashes]].sum()) if len(hashes) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))) if np.isfinite(z) else float(z > 0)


def _scored(model: tuple[np.ndarray, np.ndarray, float]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("toxicity", model[0].tobytes(), model[1].tobytes(), model[2])
        scorer = held(key, lambda: Scorer(*model))
        for batch in batches:
            scores = np.array([scorer(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return make


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document of ``docs`` (doc_id, text); learned from ``labels`` (doc_id, toxic)."""
    model = fit(docs, labels, most)
    fold = F.coalesce(fold_of("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out")
    return arrow_map(docs.select("doc_id", fold, "text"), _scored(model), "doc_id bigint, held_out boolean, score double, predicted int")
