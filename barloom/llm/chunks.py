"""Batch encoding by the tokenizers library, with a memo of encoded chunks between the places where a text may be cut.

Tokens never span the cuts used here, so a text's ids are the ids of its chunks one after another:

* byte-level vocabularies part a text before a single space that a visible character follows, and before line ends;
* lower-casing vocabularies with word ends drop white space, so spaces and line ends part words.

A text with other runs of white space after a space, with characters that may be classed differently, or with the text of a
special token (which the library takes as that token), is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from barloom.llm.common import held, ship

_MEMO = 900_000
_SLICE = 16 << 20
#: Marks the first chunk of a text, which no space precedes.
_FIRST = "\x1c"
#: Stands for a line end and the start of a chunk that no space precedes.
_LINE = "\x1d"
_MARKS = _FIRST + _LINE
_STOPS = ".,"
_ODD = r"[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}]"
_WHITE = r"[\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = rf" {_WHITE}| $|{_WHITE}\n{_WHITE}|{_WHITE}\n$"


def byte_of_letter() -> dict[str, int]:
    """Letters by which byte-level vocabularies show bytes: printable ones show themselves, the rest start at 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ChunkEncoder:
    """Ids of whole texts for one vocabulary file; the memo of chunks is emptied when full."""

    def __init__(self, path: str, memo: int = _MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.word_ends = model.get("normalizer") is not None
        names, mark = model["model"]["vocab"], model["model"].get("end_of_word_suffix") or ""
        self.token_bytes = np.zeros(max(names.values(), default=0) + 2, np.int64)
        self.token_bytes[list(names.values())] = [len(k) - len(mark) * bool(mark and k.endswith(mark)) for k in names]
        self.lead = "" if self.word_ends else "Ġ"
        self.letters = {b: c for c, b in byte_of_letter().items()}
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.stops = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in _STOPS}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        special = [re.escape(t["content"]) for t in model.get("added_tokens") or []]
        self.odd = "|".join([_ODD, *([] if self.word_ends else [_RUN]), *special])
        self.limit = memo
        self._reset()

    def _reset(self, kept: np.ndarray | None = None) -> None:
        """Empty the memo, but for the places ``kept``."""
        kept = np.zeros(0, np.int64) if kept is None else kept
        if len(kept):
            chunks = list(self.memo)
            size = self.size[kept]
            at = np.repeat(self.begin[kept] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            flat, names = self.flat[at], [chunks[i] for i in kept]
        else:
            size, flat, names = np.zeros(0, np.int64), np.zeros(0, np.uint32), []
        self.memo: dict[str, int] = dict(zip(names, range(len(names))))
        self.used = len(flat)
        self.flat = np.concatenate([flat, np.zeros(1 << 16, np.uint32)])
        spare = np.zeros(1 << 16, np.int64)
        self.begin, self.size = np.concatenate([np.cumsum(size) - size, spare]), np.concatenate([size, spare])
        self.seen = np.zeros(len(self.size), np.int64)

    def _source(self, chunk: str) -> str:
        """The piece of text that a memo key stands for."""
        if self.word_ends:
            return chunk
        return chunk[1:] if chunk[:1] == _FIRST else "\n" + chunk[1:] if chunk[:1] == _LINE else " " + chunk

    def _spelled(self, word: str, lead: str) -> str:
        """A word of letters below U+0100 in the letters of the vocabulary."""
        if self.word_ends:
            word = word.lower()
        return lead + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))

    def _words(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, one after another, and the number of ids of each; told apart by the bytes of the tokens."""
        if self.word_ends:
            spelled = [self._spelled(w, lead) for w in words]
        else:
            spelled = [lead + w if w.isascii() else self._spelled(w, lead) for w in words]
        ids = np.array(self.plain.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
        upto = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(upto, ends)
        if len(ids) and last[-1] == len(ids) - 1 and (upto[last] == ends).all():
            return ids, np.diff(last, prepend=-1)
        return self._each(words if lead or self.word_ends else [_FIRST + w for w in words])

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([self._source(c) for c in chunks], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum())), size

    def _add(self, chunks: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        k = len(self.memo)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(chunks) > len(self.begin):
            self.begin, self.size, self.seen = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.size, self.seen))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[k : k + len(chunks)] = size
        self.begin[k : k + len(chunks)] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.memo.update(zip(chunks, range(k, k + len(chunks))))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of memo places, one after another."""
        size = self.size[at]
        begin, size = self.begin[at][size > 0], size[size > 0]
        step = np.ones(int(size.sum()), np.int32 if self.used < 1 << 31 else np.int64)
        if len(step):
            step[0] = begin[0]
            step[np.cumsum(size)[:-1]] = begin[1:] - (begin[:-1] + size[:-1]) + 1
        return self.flat[np.cumsum(step, dtype=step.dtype)]

    def _learn(self, new: list[str]) -> None:
        """Encode chunks: words of letters together; a line end before or a full stop or comma after such a word apart from it."""
        words: dict[str, list[str]] = {"": [], _FIRST: []}
        joined: dict[tuple[str, str], list[tuple[str, str]]] = {}
        others, bases = [], {}
        plain = words[""]
        for c in new:
            if c.isalpha() and (c.isascii() or max(c) < "\u0100"):
                plain.append(c)
                continue
            mark = c[0] if c[:1] in _MARKS and c else ""
            core = c[1:] if mark else c
            stop = core[-1] if core[-1:] in _STOPS and core else ""
            if stop:
                core = core[:-1]
            if not core.isalpha() or not (core.isascii() or max(core) < "\u0100"):
                others.append(c)
                continue
            first = _FIRST if mark else ""
            if stop or mark == _LINE:
                base = first + core
                joined.setdefault((mark, stop), []).append((c, base))
                bases[base] = (first, core)
            else:
                words[first].append(core)
        have = {first + core for first, own in words.items() for core in own} if bases else set()
        for base, (first, core) in bases.items():
            if base not in have and base not in self.memo:
                words[first].append(core)
        for first, own in words.items():
            for i in range(0, len(own), 4096):
                self._add([first + w for w in own[i : i + 4096]], *self._words(own[i : i + 4096], "" if first else self.lead))
        for i in range(0, len(others), 4096):
            self._add(others[i : i + 4096], *self._each(others[i : i + 4096]))
        for (mark, stop), own in joined.items():
            at = np.array([self.memo[base] for _, base in own], np.int64)
            before = np.array(self.line if mark == _LINE else [], np.uint32)
            after = np.array(self.stops[stop] if stop else [], np.uint32)
            size, ids = self.size[at], self._gather(at)
            whole = size + len(before) + len(after)
            start = np.cumsum(whole) - whole
            out = np.empty(int(whole.sum()), np.uint32)
            for j, value in enumerate(before):
                out[start + j] = value
            for j, value in enumerate(after):
                out[start + len(before) + size + j] = value
            out[np.repeat(start + len(before) - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
            self._add([c for c, _ in own], out, whole)

    def _places(self, words: list[str]) -> np.ndarray:
        """Memo places of distinct chunks."""
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(at < 0)):
            new = [words[i] for i in missing.tolist()]
            if len(self.memo) + len(new) > self.limit:
                often = np.flatnonzero(self.seen[: len(self.memo)] > 1)
                self._reset(often if len(often) < self.limit // 2 else often[np.argsort(-self.seen[often])[: self.limit // 2]])
                at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(at < 0)
                new = [words[i] for i in missing.tolist()]
            self._learn(new)
            at[missing] = np.fromiter(map(self.memo.__getitem__, new), np.int64, len(new))
        self.seen[at] += 1
        return at

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut, and the number of ids of each."""
        if self.word_ends:
            marked = pc.replace_substring(texts, "\n", " ")
        else:
            lines = pc.replace_substring(texts, "\n", " " + _LINE)
            marked = pc.binary_join_element_wise(pa.scalar(_FIRST, lines.type), lines, pa.scalar("", lines.type))
        split = pc.split_pattern(marked, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        at = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(self.size[at])])
        counts = total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]
        return self._gather(at), counts

    def encode_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + _SLICE, "right")))
            part = texts.slice(start, end - start)
            odd = pc.match_substring_regex(part, self.odd).to_numpy(zero_copy_only=False)
            regular = part.filter(pa.array(~odd))
            ids, counts = self._regular(regular) if len(regular) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            at = own = 0
            for i in range(end - start):
                if odd[i]:
                    found = self.tokenizer.encode_batch_fast([part[i].as_py()], add_special_tokens=False)[0].ids
                    yield np.array(found, np.uint32)
                else:
                    yield ids[at : at + counts[own]]
                    at, own = at + counts[own], own + 1
            start = end


def encoder(path: str, memo: int = _MEMO) -> ChunkEncoder:
    """The encoder of a vocabulary file, kept between the tasks of a Python worker."""
    return held(("encoder", path, memo), lambda: ChunkEncoder(path, memo))


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
