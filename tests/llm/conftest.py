"""Small tables with odd rows, and brute-force helpers."""

import random
import re

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, kept string, score string, n_words string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, lang="en"):
    syllables = {"en": ["the", "and", "er", "on", "ing", "th", "wh", "of"], "de": ["sch", "ung", "ü", "ein", "ver", "ch", "pf", "ß"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    rng = random.Random(5)
    out, base = [], [prose(rng, 120, lang) for lang in ("en", "de") for _ in range(12)]
    for i, text in enumerate(base):
        out.append((i, text, "en" if i < 12 else "de", "a" if i % 3 else "b"))
    near = base[0].split(" ")
    for k in range(6):  # near copies with one or two changed words each
        own = list(near)
        for at in rng.sample(range(len(own)), 1 + k % 2):
            own[at] = f"changed{k}x{at}"
        out.append((100 + k, " ".join(own), "en", "a"))
    out += [
        (200, None, "en", "a"), (201, "", "en", None), (202, " \n\t ", None, None), (203, "one", "en", "a"), (204, "one two", None, "a"),
        (205, base[1], "en", "b"), (206, base[1], "en", "b"), (206, base[1], "en", "b"), (None, base[2], "en", "a"), (None, None, None, None),
        (207, prose(rng, 9000), "en", "a"), (208, "1234 5678 !!", None, "b"), (209, "\u00c9t\u00e9 na\u00efve \U0001f600 x\u0301y", "de", "a"),
        (210, "a  b\n\n\nc \u3000 d\x1fe", "en", "a"), (211, "$$$ ### " * 40 + base[3], "en", "a"),
    ]
    return [(i, t, lang, source, len(t or ""), "p", "k", "l", "w") for i, t, lang, source in out]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns whose names operators use inside."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]
