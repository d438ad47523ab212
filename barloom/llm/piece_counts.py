"""Token counts (5): greedy longest-match word pieces, counted in linear time without building pieces.

The pieces are the byte strings of a public vocabulary (word-end marks left out), held in a trie. Each node has a failure
link and the number of pieces that leave the text when the link is taken, so one pass over a word's bytes gives its count.
Words are runs without white space, A-Z lower-cased. All single bytes are pieces, so every word can be cut.

Results in odd cases: a null or empty text has no words and no tokens; rows stand for themselves, so repeated rows and null
doc_ids repeat in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.llm.chunks import byte_of_letter, vocabulary_path
from barloom.llm.common import LOWER_BYTES, held, python_map, slices

_MEMO = 1 << 20


def vocabulary_pieces(path: str) -> set[bytes]:
    """Byte strings of a byte-level vocabulary file, without word-end marks."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    mark, letters = model.get("end_of_word_suffix") or "", byte_of_letter()
    names = (k[: -len(mark)] if mark and k.endswith(mark) else k for k in model["vocab"])
    return {bytes(letters[c] for c in k) for k in names if k and all(c in letters for c in k)}


class Automaton:
    """Longest-match automaton: children, failure links and pieces popped by each link. Node 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]):
        pieces = {*pieces} | {bytes([b]) for b in range(256)}
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                node = self.next[node].setdefault(b, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    whole.append(False)
            whole[node] = True
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in self.next[parent].items():
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while b not in self.next[at]:
                    count, at = count + self.popped[at], self.fail[at]
                self.fail[node], self.popped[node] = self.next[at][b], count

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word."""
        node, total, follow, fail, popped = 0, 0, self.next, self.fail, self.popped
        for b in word:
            while (step := follow[node].get(b)) is None:
                total += popped[node]
                node = fail[node]
            node = step
        while node:
            total += popped[node]
            node = fail[node]
        return total


def _counted(path: str):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, memo = held(("automaton", path), lambda: (Automaton(vocabulary_pieces(path)), {}))
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = tokens = most = 0
                for part in slices((text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES)):
                    counts = np.fromiter(map(memo.get, part, repeat(0)), np.int64, len(part))
                    if len(missing := np.flatnonzero(counts == 0)):
                        if len(memo) > _MEMO:
                            memo.clear()
                        for i in missing:
                            word = part[i]
                            if word not in memo:
                                memo[word] = automaton.count(word)
                            counts[i] = memo[word]
                    words, tokens, most = words + len(part), tokens + int(counts.sum()), max(most, int(counts.max(initial=0)))
                out.append((None if pd.isna(doc) else int(doc), words, tokens, most))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_tokens", "longest_word"]).astype({"doc_id": "Int64"})

    return make


def count(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens and longest_word (most pieces of one word), one row per document."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    return python_map(docs.select("doc_id", "text"), _counted(path), "doc_id bigint, n_words bigint, n_tokens bigint, longest_word bigint")
