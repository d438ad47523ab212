"""Toxicity: features and ratios against plain counting, held-out accuracy on planted words, odd rows."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from barloom.llm import toxicity
from tests.llm.conftest import prose


def grams_of(text):
    whole = f" {' '.join((text or '').lower().split())} "
    if whole == "  ":
        return set()
    return {whole[i : i + n] for n in (2, 3, 4, 5) for i in range(len(whole) - n + 1)}


def hash_of(gram):
    """Hash of one n-gram, written out in whole numbers."""
    mask, h = (1 << 64) - 1, ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
    return int(toxicity.mix(np.array([(h + len(gram)) & mask], np.uint64))[0])


def test_grams_match_plain_cutting(monkeypatch):
    texts = ["Ab  c\n", "x", "", " \t", None, "Été \U0001f600 İ", "aaaaaaaaaaaaaaaa", prose(random.Random(1), 300)]
    want = [{hash_of(g) for g in grams_of(t)} for t in texts]
    assert [set(toxicity.distinct_grams(t).tolist()) for t in texts] == want
    monkeypatch.setattr(toxicity, "_SLICE", 7)
    assert [set(toxicity.distinct_grams(t).tolist()) for t in texts] == want


def planted(n, seed):
    """Documents of two languages; toxic ones hold words of a stem that nothing else holds, with changing ends."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        toxic, words = i % 4 == 0, prose(rng, rng.randint(20, 200), "en" if i % 3 else "de").split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), ("zorkug" if i % 3 else "blixam") + prose(rng, 1))
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, int(toxic), 1))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = planted(400, 1)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (1000, None), (1001, ""), (1002, rows[0][1] * 40), (1002, rows[1][1])], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (1001, None, 1), (1002, 7, 1), (None, 1, 1), (9999, 1, 0)], "doc_id bigint, toxic int, text int")
    return docs.repartition(4), marks, dict(rows), {i: t for i, t, _ in labels}


def test_held_out_accuracy_and_odd_rows(spark, tables):
    docs, marks, texts, _ = tables
    out = toxicity.score(docs, marks).collect()
    assert len(out) == docs.count()
    by_id = {r["doc_id"]: r for r in out}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0)
    unseen = [i for i in texts if i % 5 == 0 or by_id[i]["held_out"]]
    right = [by_id[i]["predicted"] == int(i % 4 == 0) for i in unseen]
    assert len(unseen) > 100 and sum(right) >= 0.95 * len(right)
    assert by_id[None]["predicted"] == 1 and by_id[1000]["score"] == by_id[1001]["score"] and by_id[1000]["predicted"] == 0
    assert sorted(r["predicted"] for r in out if r["doc_id"] == 1002) == [0, 1]


def test_ratios_match_plain_counts(spark, tables):
    docs, marks, texts, known = tables
    learned = [(texts[i], t) for i, t in known.items() if crc32(str(i).encode()) % 5]
    grams, ratio = toxicity.ratios(toxicity.sample(docs, marks))
    counts = {0: Counter(), 1: Counter()}
    for text, t in learned:
        counts[t].update(grams_of(text))
    every = set(counts[0]) | set(counts[1])
    p, q = (sum(counts[t][g] + 1.0 for g in every) for t in (1, 0))
    want = {}
    for g in every:
        a, b = counts[1][g] + 1.0, counts[0][g] + 1.0
        r = math.log(a / p) - math.log(b / q)
        if counts[1][g] + counts[0][g] >= 3 and abs(r) >= 3 * math.sqrt(1 / a + 1 / b):
            want[hash_of(g)] = r
    assert grams.tolist() == sorted(want) and len(want) > 10
    assert ratio == pytest.approx([want[g] for g in grams.tolist()])


def test_scores_are_sums_over_distinct_grams(tables):
    grams = sorted({hash_of(g) for g in ("ab", " ab", "xyz", "abxy")})
    weights = np.arange(1.0, 1 + len(grams))
    scorer = toxicity.Scorer(np.array(grams, np.uint64), weights, -2.0)
    for text in ("ab ab ab", "abxyz", "", None, "q", "Xyz ab"):
        z = -2.0 + sum(weights[grams.index(h)] for h in {hash_of(g) for g in grams_of(text)} & set(grams))
        assert scorer(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_sample_is_bounded_by_class(tables):
    docs, marks, _, _ = tables
    n = {r["toxic"]: r["count"] for r in toxicity.sample(docs, marks, most=20).groupBy("toxic").count().collect()}
    assert 5 <= n[0] <= 45 and 5 <= n[1] <= 45


@pytest.mark.parametrize(("toxic", "score"), [(0, 0.0), (1, 1.0)])
def test_one_class_or_none(spark, docs, none, toxic, score):
    marks = spark.createDataFrame([(i, toxic) for i in range(12)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs, marks).collect()} == {score}
    assert {r["score"] for r in toxicity.score(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.score(none, marks).collect() == []
