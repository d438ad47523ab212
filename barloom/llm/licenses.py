"""License scans (8): winnowed fingerprints find candidate places, banded alignment measures them.

Templates are cut to words (ASCII letters and digits, A-Z lower-cased, and all bytes beyond ASCII). Hashes of ``GRAM`` words
are winnowed: of each ``WINDOW`` neighbouring hashes the least is kept, with the template and place it stands for. Each hash
of a document that is in this inverted index votes for a place; places whose bands meet are aligned together, word by word, and
a match is reported where at least ``COVERAGE`` of the template's words are matched. One alignment gives every end in its region;
of overlapping matches of a template the best stays, and votes between the matches found are aligned again in what is left there.

Results in odd cases: a null or empty text has no matches; repeated rows repeat in the result; a template given twice counts
as one; templates of fewer than ``GRAM`` words have one hash of all their words; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.llm.common import WordHasher, python_map, shingle_hashes

GRAM = 3
WINDOW = 2
BAND = 8
#: Starts of a template that are aligned together lie so far apart at most; it bounds memory, not what is found.
SPAN = 4096
COVERAGE = 0.8

#: Public license notices.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-line", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
        " shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES"
        " OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
)
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the kept hashes: the least of every ``window`` neighbours, the last of equal ones."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: np.ndarray, region: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """(score, words of the template matched in order, first and last place (not included)) of the best match at each end.

    Row by row over the template, within the band of diagonals ``low`` to ``high`` (place in the region less place in the template);
    free ends in the region; a missing or extra word costs one, a changed word one. Where the band lies beyond an end of the
    region, the place at that end stands in, so that a template cut off there is matched by the words that are left.
    """
    rows, cols = len(template), len(region)
    score: dict[int, tuple[int, int, int, int]] = {j: (0, 0, j, j) for j in range(cols + 1)}  # score, matches, first, end
    for i in range(1, rows + 1):
        new: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, min(cols, i + low)), max(0, min(cols, i + high)) + 1):
            best = (-(1 << 30), 0, 0, 0)
            if j in score:
                s, m, b, e = score[j]
                best = (s - 1, m, b, e)
            if j and j - 1 in score:
                s, m, b, e = score[j - 1]
                if template[i - 1] == region[j - 1]:
                    best = max(best, (s + 1, m + 1, b if m else j - 1, j))
                else:
                    best = max(best, (s - 1, m, b, e))
            if j and j - 1 in new:
                s, m, b, e = new[j - 1]
                best = max(best, (s - 1, m, b, e))
            new[j] = best
        score = new
    return list(score.values())


class Index:
    """Inverted index from winnowed hash to (template, place)."""

    def __init__(self, templates: Sequence[tuple[str, str]], hasher: WordHasher):
        self.names, self.words, hashes, owner, place = [], [], [], [], []
        self.short: set[int] = set()
        for name, text in dict.fromkeys((n, t) for n, t in templates):
            words = hasher(text)
            if not len(words):
                continue
            grams = shingle_hashes(words, GRAM)
            keep = winnow(grams)
            if len(words) < GRAM:
                self.short.add(len(words))
            hashes.append(grams[keep])
            owner += [len(self.names)] * len(keep)
            place.append(keep)
            self.names.append(name)
            self.words.append(words)
        all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.owner = np.array(owner, np.int64)[order]
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)

    def votes(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, start of the template in the document, place of the hash) for each indexed hash of a document."""
        for width in [GRAM, *sorted(self.short)]:
            if len(words) < width:
                continue
            grams = shingle_hashes(words, width)
            low, high = np.searchsorted(self.hashes, grams), np.searchsorted(self.hashes, grams, "right")
            for at in np.flatnonzero(high > low):
                for k in range(low[at], high[at]):
                    yield int(self.owner[k]), int(at - self.place[k]), int(at)

    def matches(self, words: np.ndarray, coverage: float) -> list[tuple[int, float, int, int]]:
        """(template, coverage, first word, last word not included) of a document's matches, in order."""
        votes: dict[int, set[tuple[int, int]]] = {}
        for owner, start, at in self.votes(words):
            votes.setdefault(owner, set()).add((start, at))
        found: list[tuple[int, float, int, int]] = []
        for owner, places in votes.items():
            template = self.words[owner]
            free = [(0, len(words), sorted(places))]
            while free:
                low, high, here = free.pop()
                apart = _apart(template, words, coverage, low, high, [start for start, _ in here])
                found += [(owner, matched / len(template), first, end) for matched, first, end in apart]
                bounds = [low, *(place for _, first, end in apart for place in (first, end)), high]
                for begin, stop in zip(bounds[::2], bounds[1::2]) if apart else ():
                    left = [v for v in here if begin <= v[1] < stop]
                    if left and stop - begin >= coverage * len(template):
                        free.append((begin, stop, left))
        return sorted(found, key=lambda m: (m[2], m[0]))


def _apart(
    template: np.ndarray, words: np.ndarray, coverage: float, low: int, high: int, starts: list[int]
) -> list[tuple[int, int, int]]:
    """(words matched, first, end) of matches that do not overlap among words ``low`` to ``high``, by place; starts are sorted."""
    groups: list[list[int]] = []
    for start in starts:
        if groups and start - groups[-1][1] <= 4 * BAND and start - groups[-1][0] <= SPAN:
            groups[-1][1] = start
        else:
            groups.append([start, start])
    ends = set()
    for start, last in groups:
        begin = max(low, start - BAND)
        region = words[begin : max(begin, min(high, last + len(template) + 2 * BAND))]
        for score, matched, first, end in align(template, region, start - 2 * BAND - begin, last + 2 * BAND - begin):
            if matched and matched / len(template) >= coverage:
                ends.add((-score, -matched, begin + first, begin + end))
    taken, apart = set(), []
    for _, matched, first, end in sorted(ends):  # of overlapping matches the best stays
        if taken.isdisjoint(range(first, end)):
            taken.update(range(first, end))
            apart.append((-matched, first, end))
    return sorted(apart, key=lambda m: m[1])


def _scanned(templates: Sequence[tuple[str, str]], coverage: float):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(_FOLD)
        index = Index(templates, hasher)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                found = index.matches(hasher(text), coverage)
                spans, covered = [], set()
                if found:
                    data = text.encode("utf-8", "surrogatepass")
                    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_FOLD))]
                    for owner, share, first, end in found:
                        chars = [len(data[:b].decode("utf-8", "replace")) for b in (places[first][0], places[end - 1][1])]
                        spans.append(dict(license=index.names[owner], coverage=share, word_start=first, word_end=end,
                                          char_start=chars[0], char_end=chars[1]))
                        covered.update(range(first, end))
                names = ",".join(sorted({s["license"] for s in spans}))
                best = max((s["coverage"] for s in spans), default=0.0)
                out.append((None if pd.isna(doc) else int(doc), len(spans), names, best, len(covered), spans))
            frame = pd.DataFrame(out, columns=["doc_id", "n_matches", "licenses", "best_coverage", "matched_words", "spans"])
            yield frame.astype({"doc_id": "Int64"})

    return make


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_matches, licenses, best_coverage, matched_words and spans, one row per document."""
    return python_map(
        docs.select("doc_id", "text"), _scanned(tuple(templates), coverage),
        "doc_id bigint, n_matches bigint, licenses string, best_coverage double, matched_words bigint, spans array<struct<license: string,"
        " coverage: double, word_start: bigint, word_end: bigint, char_start: bigint, char_end: bigint>>",
    )
