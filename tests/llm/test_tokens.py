"""Token files, packing and piece counts against direct computation."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import packed, packing, piece_counts
from barloom.llm.chunks import ChunkEncoder, vocabulary_path
from tests.llm.conftest import FOLD

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def ids_of(name, text, end=0):
    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", NAMES)
def test_chunks_equal_whole_texts(name, texts):
    encoder = ChunkEncoder(vocabulary_path(name), memo=60)
    found = encoder.encode_texts(pa.array([t for _, t in texts], pa.string()))
    for (_, text), ids in zip(texts, found):
        assert ids.tolist() == ids_of(name, text).tolist()[:-1]


ENCODERS = {name: ChunkEncoder(vocabulary_path(name), memo=500) for name in NAMES}
PIECES = [" ", "  ", "\n", "\t", "a", "Word", "x.", "b,", "'s", "é", "Été", "ß", "1", "$", "\x1f", "Σ", "\u0301", "\xa0", "\u3000", "\x85", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "K"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_chunks_equal_odd_texts(text):
    for name, encoder in ENCODERS.items():
        found = next(encoder.encode_texts(pa.array([text], pa.string())))
        assert found.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=5000), st.integers(1, 5))
def test_rans_round_trip(ids, skew):
    ids = np.array(ids, np.uint32) // skew
    coder = packed.Coder(packed.scaled_frequencies(np.bincount(ids)))
    payload, marks = coder.encode(ids)
    assert coder.decode(payload, marks, len(ids)).tolist() == ids.tolist()


def test_rans_checkpoints_decode_alone():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.1, 600_000), 200).astype(np.uint32)
    coder = packed.Coder(packed.scaled_frequencies(np.bincount(ids)))
    payload, marks = coder.encode(ids)
    each = packed.STEPS * packed.LANES
    parts = [coder.decode(payload, marks, len(ids), k, k + 1) for k in range(-(-len(ids) // each))]
    assert len(parts) > 3 and np.array_equal(np.concatenate(parts), ids)
    assert len(payload) < 4 * len(ids) / 3


def test_scaled_frequencies_keep_rare_ids():
    counts = np.array([10**12, 1, 0, 1])
    scaled = packed.scaled_frequencies(counts)
    assert scaled.sum() == 1 << packed.SCALE and scaled[1] >= 1 and scaled[2] == 0


def test_token_files(spark, docs, texts, tmp_path):
    packed.write(docs, f"file://{tmp_path}/set")
    found = sorted(packed.read(spark, f"file://{tmp_path}/set").collect(), key=lambda r: r["start"])
    known = sorted(((i, ids_of(NAMES[0], t).tobytes()) for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == Counter(known)
    assert [r["doc_id"] for r in found] == [i for i, _ in known]
    start = 0
    for r in found:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]


def test_token_files_of_nothing(none):
    assert packed.round_trip(none).count() == 0


def seats(plan):
    sequences = {}
    for r in plan.itertuples():
        for k in range(r.first, r.last):
            over = k - r.first
            sequences.setdefault(r.base + over // r.each, []).append((r.offset + over % r.each * r.length, r.length))
    return sequences


def plain_best_fit(lengths, limit):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(limit - x)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 15), max_size=12), st.sampled_from([40, 41, 60, 100]))
def test_plan_is_gapless_and_no_worse_than_best_fit(histogram, limit):
    sequences = seats(packing.plan(histogram, limit))
    packed_lengths = Counter()
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
            packed_lengths[length] += 1
        assert end <= limit
    assert packed_lengths == Counter(histogram)
    assert len(sequences) <= plain_best_fit([k for k, n in histogram.items() for _ in range(n)], limit)


def fewest(lengths, limit):
    """Fewest sequences by search, for a few pieces."""
    best = len(lengths)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            place(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]])
        place(rest[1:], [*rooms, limit - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_reduction_keeps_an_optimum(lengths):
    left = packing._Lengths(dict(Counter(lengths)))
    fixed = packing.reduce(left, 30)
    rest = [k for k, n in left.left.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + (fewest(rest, 30) if rest else 0) == fewest(lengths, 30)


def test_pack(docs, texts, none):
    found = packing.pack(docs, limit=256).toPandas()
    expected = Counter()
    for i, t in texts:
        ids = ids_of(NAMES[1], t)
        for piece, at in enumerate(range(0, len(ids), 256)):
            expected[(i, piece, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()))] += 1
    rows = [tuple(None if v != v else int(v) for v in r) for r in found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert Counter(rows) == expected
    found = found.sort_values(["sequence_id", "offset"])
    ends = found.groupby("sequence_id")["length"].cumsum()
    assert (ends - found["length"] == found["offset"]).all() and ends.max() <= 256
    assert packing.pack(none).count() == 0


def greedy(word, pieces):
    at = n = 0
    while at < len(word):
        at += next(k for k in range(len(word) - at, 0, -1) if k == 1 or word[at : at + k] in pieces)
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=15), st.text("abc", max_size=15))
def test_automaton_equals_greedy(pieces, word):
    assert piece_counts.Automaton(pieces).count(word.encode()) == greedy(word.encode(), pieces)


def test_piece_counts(docs, texts, none):
    pieces = piece_counts.vocabulary_pieces(vocabulary_path(NAMES[1]))
    expected = Counter()
    for i, t in texts:
        counts = [greedy(w, pieces) for w in (t or "").translate(FOLD).encode().split()]
        expected[(i, len(counts), sum(counts), max(counts, default=0))] += 1
    assert Counter(map(tuple, piece_counts.count(docs).collect())) == expected
    assert piece_counts.count(none).count() == 0


def test_known_chunks_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    code = ChunkEncoder(vocabulary_path("byte_bpe_50k.json"))
    known = " ".join(f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(500))
    list(code.encode_texts(pa.array([known])))
    code.memo = Counted(code.memo)
    found = list(code.encode_texts(pa.array([known + " unseen andmore. naïve, last\nline"])))[0]
    assert Counted.asked <= 10  # the new chunks and the words within them, not the known ones
    assert found.tolist() == code.tokenizer.encode(known + " unseen andmore. naïve, last\nline", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_memo_that_empties_gives_the_same_ids(name):
    texts = [" ".join(f"{'éaAb'[k % 4]}{'xyzw'[j % 4] * (k % 7)}{'., ;'[j % 4]}" for j in range(k, k + 9)) for k in range(60)]
    small, whole = ChunkEncoder(vocabulary_path(name), memo=12), ChunkEncoder(vocabulary_path(name))
    for text in texts:
        ids = whole.tokenizer.encode(text, add_special_tokens=False).ids
        assert [list(e.encode_texts(pa.array([text])))[0].tolist() for e in (small, whole)] == [ids, ids]
