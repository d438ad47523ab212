"""Decontamination, URL rules, quality rules, licenses, scores and languages against direct computation."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from barloom.llm import decontaminate, katz, language, licenses, outliers, url_rules
from barloom.llm.chunks import vocabulary_path
from tests.llm.conftest import FOLD, prose, words_of


def tokens_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(texts, items):
    windows = {}
    for item, text in items:
        w = tokens_of(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in texts:
        w, hit, found = tokens_of(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def items(spark, texts):
    import random

    base = texts[4][1].split(" ")
    rows = [(1, " ".join(base[10:40])), (2, "One  TWO"), (10, " ".join(base[30:60])), (3, None), (4, " ,; "), (5, prose(random.Random(1), 30)), (2, "one two"), (None, " ".join(base[10:40])), (None, prose(random.Random(2), 30)), (6, texts[13][1])]
    return spark.createDataFrame(rows, "item_id bigint, text string"), rows


def test_contamination(docs, texts, items):
    found = decontaminate.judge(docs, items[0]).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    wanted = Counter(contamination(texts, items[1]))
    assert Counter(map(tuple, found.collect())) == wanted and max(wanted.values()) > 1


def test_contaminated_documents_and_spans_go(docs, texts, items):
    bad = Counter((i, t) for (i, t), r in zip(texts, contamination(texts, items[1])) if r[5])
    kept = Counter((r["doc_id"], r["text"]) for r in decontaminate.remove_documents(docs, items[0]).collect())
    assert bad and kept == Counter(texts) - bad
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items[0]).where("doc_id IS NOT NULL").collect()}
    assert not any(r[2] for r in contamination(list(cut.items()), items[1]) if r[0] == 4)
    clean = {i for (i, t), r in zip(texts, contamination(texts, items[1])) if not r[2]}
    assert all(cut[i] == t for i, t in texts if i in clean and i is not None)


def test_contamination_of_nothing(docs, none, items):
    assert decontaminate.judge(none, items[0]).count() == 0
    nothing = decontaminate.judge(docs, items[0].limit(0))
    assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == docs.count()


def test_items_without_id_hit(spark, docs, texts):
    """Only items without an id: their passages count, under the empty id."""
    rows = [(None, texts[4][1]), (None, texts[5][1])]
    found = decontaminate.judge(docs, spark.createDataFrame(rows, "item_id bigint, text string"))
    shown = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert Counter(map(tuple, shown)) == Counter(contamination(texts, rows))
    assert {r["doc_id"] for r in shown if r["contaminated"]} >= {4, 5}


URLS = (
    ("http://a.net/x", "a.net", "/x", "net/"), ("http://example.net/en/1?q", "example.net", "/en/1", "example.net/en/"),
    ("https://WWW.Example.com/de/#t", "www.example.com", "/de/", "example.com/de/"), ("http://notexample.com/de/", "notexample.com", "/de/", None),
    ("http://b.org/fr/1", "b.org", "/fr/1", "org/fr/"), ("http://b.org/FR/1", "b.org", "/FR/1", None), ("http://a.net", "a.net", "", None),
    ("nothing", "", "", None), (None, "", "", None), ("x://h?p=/net/", "h", "", None), ("http://a.net:80/x", "a.net:80", "/x", None), ("", "", "", None),
)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u[0], None) for i, u in enumerate(URLS)]
    rows += [(1000 + i, f"http://spam{i % 2}.example.com/{'casino' if i % 3 else 'news'}/{i}", None) for i in range(300)]
    labels = [(1000 + i, 1, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(None, 0, 1), (1000, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_listed_rules(pages):
    found = {r["page_id"]: r for r in url_rules.judge(*pages).collect()}
    verdicts = {rule: verdict for verdict, rule in url_rules.RULES}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        if rule:
            assert found[i]["verdict"] == verdicts[rule]


def test_mined_rules_equal_counting(pages):
    found = url_rules.judge(*pages).where("page_id >= 1000").collect()
    assert len(found) == 300
    assert all(r["verdict"] == ("block" if (r["page_id"] - 1000) % 3 else "allow") for r in found)


def test_rules_on_late_tokens_equal_counting(spark):
    """URLs of 20 to 40 tokens: a path word and a query name near the end tell the bad ones, alone or together."""
    rng = random.Random(3)
    rows, labels, parsed = [], [], []
    for i in range(600):
        deep = [f"d{k}" for k in range(16)] + [f"slug{rng.randrange(10**6)}" for _ in range(rng.randrange(16))]
        marks = [m for m in ("casino", "win") if rng.random() < 0.4]
        names = [n for n in ("aff", "ref") if rng.random() < 0.4]
        bad = ("casino" in marks and rng.random() < 0.95) or ("win" in marks and "aff" in names) or rng.random() < 0.05
        rows.append((i, "http://www.example.com/" + "/".join(deep + marks) + "?id=1" + "".join(f"&{n}=2" for n in names), None))
        parsed.append((frozenset([*marks, *names]), bad, i % 3 > 0))
        if i % 3:
            labels.append((i, 1, int(bad)))
    found = {r["page_id"]: r["confidence"] for r in url_rules.judge(
        spark.createDataFrame(rows, "page_id bigint, url string, html string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    ).collect()}
    known = [(have, bad) for have, bad, labelled in parsed if labelled]
    base = sum(bad for _, bad in known) / len(known)
    rules = {}
    for size in (1, 2, 3, 4):
        for want in itertools.combinations(("casino", "win", "aff", "ref"), size):
            fits = [bad for have, bad in known if have >= set(want)]
            if sum(fits) >= 25 and sum(fits) / len(fits) >= max(url_rules.MIN_CONFIDENCE, base + 1e-12):
                rules[frozenset(want)] = sum(fits) / len(fits)
    assert len(rules) > 2
    for i, (have, _, _) in enumerate(parsed):
        best = max((c for want, c in rules.items() if have >= want), default=None)
        assert found[i] == (best if best is None else pytest.approx(best))


def test_tokens_of_the_same_urls_each_fit_a_rule(spark):
    """30 path words that go together in labelled URLs: one of them is enough in a page that has no label."""
    together = [f"t{k}" for k in range(30)]
    rows = [(i, "http://a.io/" + ("/".join(together) if i % 2 else "plain"), None) for i in range(200)]
    rows += [(1000, "http://b.io/t7", None), (1001, "http://b.io/t29/other", None), (1002, "http://b.io/none", None)]
    labels = [(i, 1, i % 2) for i in range(200)]
    found = {r["page_id"]: r["verdict"] for r in url_rules.judge(
        spark.createDataFrame(rows, "page_id bigint, url string, html string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    ).collect()}
    assert (found[1], found[2], found[1000], found[1001], found[1002]) == ("block", "allow", "block", "block", "allow")


def test_parameter_names_come_from_the_query_alone(spark):
    """A rule on a parameter does not fit the same text in a path, a fragment, a value, or a url without a host."""
    rows = [(i, "http://a.io/p" + ("?bad=1" if i % 2 else "?good=1"), None) for i in range(200)]
    fits = ("http://b.io?bad", "http://b.io/p?x=1&bad=2#t", "HTTP://b.io/?&&bad&")
    fails = (
        "nohost?bad=1", "?bad=1", "://?bad=1", "file:///p?bad=1", "http://z.com/x&bad", "http://z.com/x&bad=1?y", "http://z.com/x#?bad=1",
        "http://z.com/x?y=1#&bad=1", "http://z.com/x?y=?bad", "http://z.com/?badly=1", "nohost?bad=1://", "",
    )
    rows += [(1000 + i, url, None) for i, url in enumerate(fits + fails)] + [(1000 + len(fits + fails), None, None)]
    labels = [(i, 1, i % 2) for i in range(200)]
    found = url_rules.judge(
        spark.createDataFrame(rows, "page_id bigint, url string, html string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    ).where("page_id >= 1000").orderBy("page_id").collect()
    assert [r["verdict"] for r in found] == ["block"] * len(fits) + ["allow"] * (len(fails) + 1)


def test_no_labels_allow_and_no_pages(pages):
    found = url_rules.judge(pages[0], pages[1].limit(0)).collect()
    assert len(found) == len(URLS) + 300 and all(r["verdict"] == "allow" for r in found if r["rule"] is None)
    assert url_rules.judge(pages[0].limit(0), pages[1]).count() == 0


def base_of(text):
    words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {r for r, n in Counter(runs).items() if n > 1}
    hit = {p for i, r in enumerate(runs) if r in often for p in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_counts(spark, docs, texts, none):
    more = [(900 + i, t) for i, t in enumerate(["a b c a b c", "a a a a", "x\ny\nx\n \nx", "a b c d a b c", "", "q " * 60])]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = outliers.judge(frame).select(*names).collect()
    assert Counter(map(tuple, found)) == Counter((i, *base_of(t)) for i, t in [*texts, *more])
    assert outliers.judge(none).count() == 0


def test_outliers_go_and_others_stay(spark):
    import random

    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(60, 400), "en"), "en", "s") for i in range(300)]
    odd = [(1000 + i, " ".join(w + "$$##" for w in prose(rng, 100).split(" ")), "en", "s") for i in range(20)]
    found = outliers.judge(spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, source string")).collect()
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert kept == set(range(300))


def test_licenses(spark, docs, none):
    apache = dict(licenses.TEMPLATES)["apache-2.0-header"]
    changed = apache.replace("governing", "x").replace("agreed", "AGREEDX").replace("either express", "express")
    rows = [(1, "foo bar " + apache + " tail"), (2, "intro\n" + changed), (3, "all RIGHTS  reserved"), (4, "no license here"), (5, apache + " x y z " + apache), (6, None)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    whole = [s for s in found[1]["spans"] if s["license"] == "apache-2.0-header"]
    assert len(whole) == 1 and whole[0]["coverage"] == 1.0
    assert rows[0][1][whole[0]["char_start"] : whole[0]["char_end"]] == apache.rstrip(".")
    near = [s for s in found[2]["spans"] if s["license"] == "apache-2.0-header"]
    assert len(near) == 1 and 0.9 < near[0]["coverage"] < 1.0
    assert found[3]["licenses"] == "all-rights-reserved" and found[4]["n_matches"] == 0 and found[6]["n_matches"] == 0
    assert sum(s["license"] == "apache-2.0-header" for s in found[5]["spans"]) == 2
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


@pytest.mark.parametrize("name", ["all-rights-reserved", "mit-line", "apache-2.0-line", "gpl-3.0-line", "mit"])
def test_every_near_license_match_is_found(spark, name):
    """Copies of a notice with 0 to 16 words between them, five of each, and a notice cut off at the text's start and end."""
    notice = dict(licenses.TEMPLATES)[name]
    size = len(re.findall(r"[A-Za-z0-9]+", notice))
    rows = [(gap, (" ".join(f"w{i}" for i in range(gap)) + " ").join([notice + " "] * 5)) for gap in (0, 3, 5, 7, 12, 16)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for gap, _ in rows:
        spans = [(s["word_start"], s["word_end"], s["coverage"]) for s in found[gap]["spans"] if s["license"] == name]
        assert spans == [(k * (size + gap), k * (size + gap) + size, 1.0) for k in range(5)]
    words = re.findall(r"[A-Za-z0-9]+", notice)
    lost = size // 6
    cut = [(1, " ".join(words[lost:])), (2, " ".join(words[: len(words) - lost]))]
    for row in licenses.scan(spark.createDataFrame(cut, "doc_id bigint, text string")).collect():
        assert name in row["licenses"].split(",")


def test_listing_of_licenses(spark):
    """Each notice once, one after the other: all of them are found, also those of which others hold parts."""
    text = "\n".join(notice for _, notice in licenses.TEMPLATES)
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert set(row["licenses"].split(",")) == {name for name, _ in licenses.TEMPLATES}


def test_winnowing_keeps_a_hash_of_every_window():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 50, 200).astype(np.uint64)
    for window in (1, 2, 5):
        kept = licenses.winnow(hashes, window)
        assert all(any(i <= k < i + window for k in kept) for i in range(len(hashes) - window + 1))


def reference_scores(texts):
    """Katz scores by dictionaries."""
    tokens = [[*words_of((t or "").translate(FOLD)), None] for _, t in texts]
    fold = [None if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in texts]
    learn = [f is not None and f != 2 for f in fold]
    one, two = Counter(), Counter()
    for t, use in zip(tokens, learn):
        if use:
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t))
    total, starts = sum(one.values()), sum(learn)
    d1, d2 = (katz.discounts(np.array([0] + [sum(v == r for v in c.values()) for r in range(1, 7)])) for c in (one, two))
    less = lambda r, d: d[r] * r if r <= katz.K else r
    unknown = 1 - sum(less(c, d1) for c in one.values()) / total
    single = lambda w: less(one[w], d1) / total if one[w] else unknown
    kept, below, small = Counter(), Counter(), set()
    for (h, w), r in two.items():
        kept[h] += less(r, d2)
        below[h] += single(w)
        if r <= katz.K:
            small.add(h)

    def pair(h, w):
        c = starts if h == "<s>" else one[h]
        if not c:
            return single(w)
        if two[h, w]:
            return less(two[h, w], d2) / c * (1 if h in small else 1 - 0.5 / c)
        return (1 - kept[h] / c if h in small else 0.5 / c) / (1 - below[h]) * single(w)

    out = []
    for (i, _), t, f in zip(texts, tokens, fold):
        base = sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in t)
        out.append((i, f == 2, len(t), sum(one[w] > 0 for w in t), total, base, sum(math.log10(pair(h, w)) for h, w in zip(["<s>", *t[:-1]], t))))
    sums = [sum(pair(h, w) for w in one) + pair(h, "unseen!") for h in list(one)[:20] if h is not None]
    return out, sums


def test_scores(docs, texts, none, monkeypatch):
    expected, sums = reference_scores(texts)
    assert np.allclose(sums, 1.0)
    key = lambda r: tuple((v is None, v) for v in r)
    found = sorted(map(tuple, katz.score(docs).collect()), key=key)
    for ours, theirs in zip(found, sorted(expected, key=key), strict=True):
        assert ours[:5] == theirs[:5] and np.allclose(ours[5:], theirs[5:], rtol=1e-9)
    assert katz.score(none).count() == 0


def test_scores_without_training_text(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = katz.score(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert [tuple(r)[:5] for r in rows] == [(held, True, 3, 0, 0)] and rows[0]["score"] == 0.0


def test_forward_sums_all_segmentations():
    vocabulary = language.Pieces(vocabulary_path("word_bpe_49k.json"))
    probs = np.random.default_rng(0).random((vocabulary.size + 1, 2)) / vocabulary.size
    probs[-1] = 0

    def total(word, lang):
        if not word:
            return 1.0
        return sum(probs[vocabulary.number[word[:k]], lang] * total(word[k:], lang) for k in range(1, len(word) + 1) if word[:k] in vocabulary.number)

    assert vocabulary.longest == max(map(len, vocabulary.number)) > 12
    for word in (b"the", b"schung", "ü".encode(), b"x"):
        ahead = language.forward(vocabulary.lattice([word]), probs)
        assert np.allclose(ahead[-1, 0], [total(word, 0), total(word, 1)])
        assert np.allclose(language.backward(vocabulary.lattice([word]), probs)[0, 0], ahead[-1, 0])


def test_long_words_lose_no_segmentation():
    """Words of a block and more against exact sums over the whole vocabulary, for blocks shorter than the longest piece too."""
    vocabulary = language.Pieces(vocabulary_path("word_bpe_49k.json"))
    probs = np.random.default_rng(1).random((vocabulary.size + 1, 2)) / 1000
    probs[-1] = 0
    longest = max(vocabulary.number, key=len)
    rng = random.Random(2)
    for n in (1, 63, 64, 65, 128, 129, 700):
        words = [bytes(rng.choice(b"etaoinschr\xc3\xbc") for _ in range(n)) for _ in range(2)]
        words.append((prose(rng, 200).replace(" ", "").encode() + longest * 40)[-n:])
        for block in (5, 64):
            found = language.log_total(vocabulary, words, probs, block)
            for word, own in zip(words, found):
                for lang in (0, 1):
                    sums = [Fraction(1)]
                    for end in range(1, n + 1):
                        sums.append(sum(
                            (sums[end - k] * Fraction(probs[vocabulary.number[word[end - k : end]], lang])
                             for k in range(1, min(end, len(longest)) + 1) if word[end - k : end] in vocabulary.number), Fraction(0),
                        ))
                    exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
                    assert own[lang] == pytest.approx(exact, rel=1e-9)


def test_languages(docs, none):
    found = language.predict(docs, ("doc_id", "lang", "text")).collect()
    assert len(found) == docs.count()
    for r in found:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
        if r["lang"] and len(words_of(r["text"])) > 50:
            assert r["lang_pred"] == r["lang"]
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert language.predict(none).count() == 0
