"""Spelling variants against all pairs."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from barloom.llm import spelling
from tests.llm.conftest import FOLD


def one_edit(a, b):
    """Exactly one insertion, deletion or replacement, tried out."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_all_pairs(texts, least=5, often=3, ratio=2, divisor=None):
    n = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            if divisor:
                h = crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % divisor == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= often}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(spark, texts, **options):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    return {tuple(r) for r in spelling.variants(docs.repartition(3), **options).collect()}


def test_odd_documents_match_all_pairs(docs, texts):
    out = spelling.variants(docs, divisor=7).collect()
    assert {tuple(r) for r in out} == by_all_pairs(texts, divisor=7) and len({r["word"] for r in out}) == len(out) > 20
    assert any(r["n_near"] for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_few_letters_match_all_pairs(spark, seed):
    """Words of two or three letters of the alphabet: runs of equal letters, edits at both ends, many near words and ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("ab" if seed == 1 else "aéÿ") for _ in range(rng.randint(4, 9))) for _ in range(160)]
    texts = [(k, "".join(rng.choice(words) + rng.choice(" -9\nЖ") for _ in range(60))) for k in range(40)]
    want = by_all_pairs(texts)
    assert found(spark, texts) == want and len(want) > 60


def test_chains_lead_to_the_last_form(spark):
    counts = {"abcdefgh": 81, "abcdefg": 40, "abcdef": 20, "abcde": 10, "bcdefgh": 3, "zzzzz": 3, "zzzzzz": 5}
    texts = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    out = found(spark, texts)
    assert out == by_all_pairs(texts)
    roots = {r[0]: r[2] for r in out}
    assert roots["abcde"] == roots["bcdefgh"] == roots["abcdefgh"] == "abcdefgh" and roots["zzzzz"] == "zzzzz"


def test_long_words_and_hot_groups(spark):
    """Words longer than the widths that have segments of two; a group that fills several Arrow batches."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefg") for _ in range(700))
    long = [base, base[:350] + "x" + base[350:], base[:699], "y" + base[1:], base[:100] + "z" + base[101:600] + "q" + base[601:]]
    texts = [(k, " ".join(long)) for k in range(3)]
    assert found(spark, texts) == by_all_pairs(texts)
    letters = "abcdefghijklmnopqrstuvwxyzàáâã"
    hot = [f"same{x}{y}tail" for x in letters for y in letters]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        texts = [(k, " ".join(hot)) for k in range(3)]
        out = found(spark, texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(hot) and {r[4] for r in out} == {2 * (len(letters) - 1)}


def test_slices_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "_SLICE", 7)
    text = "Abc déf,ghijklmnopqrstu Жvw"
    assert [w for part in spelling.runs_of(text) for w in part] == [b"abc", b"d\xe9f", b"ghijklmnopqrstu", b"vw"]


def test_empty_and_ratio(spark, none, docs):
    assert spelling.variants(none).collect() == []
    assert spelling.variants(docs.where("doc_id IN (200, 201, 202)")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(docs, ratio=1)
