"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import jaccard
from barloom.llm.common import WordHasher
from tests.llm.conftest import FOLD, words_of


def sets_of(texts):
    out = []
    for _, text in texts:
        words = [w.translate(FOLD) for w in words_of(text)]
        out.append({tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set())
    return out


def by_all_pairs(texts):
    """(doc_id, set size, least doc_id of the component) of each row."""
    sets, least = sets_of(texts), [i for i, _ in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and None not in (least[i], least[j]) and 100 * shared >= 90 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    names = {}
    for i, doc in enumerate(least):
        names.setdefault(top(i), []).append(doc)
    return [(doc, len(sets[i]), None if doc is None else min(names[top(i)])) for i, doc in enumerate(least)]


def found(frame):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=key)


def test_odd_rows(docs, texts):
    key = lambda r: tuple((v is None, v) for v in r)
    assert found(jaccard.link(docs)) == sorted(by_all_pairs(texts), key=key)


def test_nothing(none):
    assert jaccard.link(none).count() == 0


def test_families_of_near_copies(spark):
    """Chains, stars without their centre and sets at the limit, in sizes from a few words up."""
    rng = random.Random(9)
    texts, doc = [], 0
    for n in (4, 9, 12, 25, 60, 150, 400):
        for _ in range(6):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
            for _ in range(rng.choice([1, 3, 9])):
                own = list(base)
                for at in rng.sample(range(n), rng.randint(0, max(1, n // 50))):
                    own[at] = f"v{rng.randint(0, 10**6)}"
                if rng.random() < 0.3:
                    base = own  # later ones drift from here on
                texts.append((doc, " ".join(own) + " x" * rng.choice([0, 0, 1, n // 12])))
                doc += 1
    rng.shuffle(texts)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    assert found(jaccard.link(frame)) == sorted(by_all_pairs(texts))


def test_page_search_alone(spark, monkeypatch):
    """Near copies without a centre, found by the tree in blocks smaller than the page."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for doc in range(14):
        own = list(base)
        for at in rng.sample(range(200), 3):
            own[at] = f"u{doc}x{at}"
        texts.append((doc, " ".join(own)))
    sets = {doc: jaccard.shingle_set(WordHasher(), text) for doc, text in texts}
    members = spark.createDataFrame([(1, d) for d in sets], "key bigint, sid bigint")
    frame = spark.createDataFrame(pd.DataFrame({"sid": list(sets), "hashes": [s.tobytes() for s in sets.values()]}), "sid bigint, hashes binary")
    labels = spark.createDataFrame([], "id bigint, label bigint")
    links = [tuple(r) for r in jaccard._search(members, labels, frame).collect()]
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in links:
        assert jaccard.overlap(sets[a].tobytes(), sets[b].tobytes())
        root[top(a)] = top(b)
    own = {}
    for doc, _, component in by_all_pairs(texts):
        own.setdefault(component, set()).add(top(doc))
    assert all(len(v) == 1 for v in own.values()) and len({top(d) for d in sets}) == len(own)


@settings(max_examples=60, deadline=None)
@given(st.integers(10, 400), st.integers(0, 10**6), st.floats(0, 1))
def test_linked_sets_share_a_page(n, seed, share):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    cut = int(share * 0.1 * n)
    b = np.unique(np.concatenate([a[: len(a) - cut], rng.integers(0, 1 << 63, int((1 - share) * 0.05 * n), dtype=np.uint64)]))
    linked = jaccard.overlap(a.tobytes(), b.tobytes())
    pages = jaccard.Pages()
    if linked and not np.array_equal(a, b):
        assert len(np.intersect1d(pages.keys(a), pages.keys(b)))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 60), st.integers(0, 10**6))
def test_tree_passes_over_no_link(n, seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64))
    sets = []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, len(base), rng.integers(0, 9))] = rng.integers(0, 1 << 63)
        sets.append(np.unique(own))
    points, sizes = jaccard.points_of([jaccard.count_vector(x) for x in sets]), np.array([len(s) for s in sets])
    tree = jaccard.PageTree(points, sizes)
    for i in range(n):
        near = set(tree.candidates(points[i], sizes[i]).tolist())
        assert {j for j in range(n) if jaccard.overlap(sets[i].tobytes(), sets[j].tobytes())} <= near
