"""Token ids of whole texts, each distinct chunk encoded once per worker.

A byte-level BPE with the usual word pattern never forms a token across a
boundary from a character that is no white space to white space: no alternative
of the pattern continues past it. A line feed between two characters that are no
white space is a token group of its own. So the ids of a text are the ids of its
chunks in order, cut before each space and each line feed. A text with two white
space characters in a row is cut by a pattern that keeps such runs together.

Corpus words repeat, so a bounded table of the chunks a worker has seen replaces
nearly all encoding work. The ids are exactly those of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks a worker remembers before it starts its table anew (about 250 bytes each).
TABLE_CHUNKS = 800_000

_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=\s)")

_WORKER: dict[str, ChunkTable] = {}


class ChunkTable:
    """``encode_new`` gives the ids of a list of distinct chunks, one after the
    other, and their numbers."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = TABLE_CHUNKS):
        self.encode_new, self.limit = encode_new, limit
        self._clear()

    def _clear(self) -> None:
        self.pieces: dict[str, int] = {}  # "x" stands for " x", "\nx" for itself
        self.odd: dict[str, int] = {}  # chunks of texts with white space runs
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = self.rows = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _places(self, known: dict[str, int], keys: list[str], chunk_of: Callable[[str], str]) -> np.ndarray:
        """Rows of distinct keys; chunks not seen before are encoded."""
        got = list(map(known.get, keys))
        if None in got:
            new = [k for k, g in zip(keys, got, strict=True) if g is None]
            self._learn(known, new, *self.encode_new([chunk_of(k) for k in new]))
            got = list(map(known.__getitem__, keys))
        return np.array(got, np.int64)

    def _learn(self, known: dict[str, int], new: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(new) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used: self.used + total] = ids
        here = slice(self.rows, self.rows + len(new))
        self.start[here] = self.used + np.cumsum(size) - size
        self.length[here] = size
        known.update(zip(new, range(self.rows, self.rows + len(new)), strict=True))
        self.used += total
        self.rows += len(new)

    def _gather(self, at: np.ndarray, counts: np.ndarray, skip: int) -> list[np.ndarray]:
        """Ids of consecutive texts from the rows of their chunks."""
        size = self.length[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.start[at] - (ends - size), size)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a + skip: b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if self.rows > self.limit:
            self._clear()
        odd = [bool(_RUN.search(t)) or t[:1].isspace() for t in texts]
        plain = [t for t, o in zip(texts, odd, strict=True) if not o]
        # A line feed put first makes every piece either " x" or "\nx"; its one id is left out again.
        lists = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in plain], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        places = self._places(self.pieces, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), lambda p: p if p[:1] == "\n" else " " + p)
        out = iter(self._gather(places[coded.indices.to_numpy()], pc.list_value_length(lists).to_numpy(), 1)
                   if plain else [])
        del lists, coded
        pa.default_memory_pool().release_unused()
        if len(plain) == len(texts):
            return list(out)
        cut = [_CUT.split(t) for t, o in zip(texts, odd, strict=True) if o]
        keys = list(dict.fromkeys(c for r in cut for c in r))
        row = dict(zip(keys, self._places(self.odd, keys, str), strict=True))
        at = np.array([row[c] for r in cut for c in r], np.int64)
        rest = iter(self._gather(at, np.array([len(r) for r in cut], np.int64), 0))
        return [next(rest) if o else next(out) for o in odd]


def byte_signs() -> dict[int, int]:
    """The signs that byte-level vocabularies write bytes with: printable bytes
    stand for themselves, the others take code points from 256 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: 256 + i for i, b in enumerate(hidden)}


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def worker_table(path: str) -> ChunkTable:
    """The table of this Python worker for a tokenizers file without normaliser;
    tasks that reuse the worker share it."""
    if path not in _WORKER:
        tokenizer = load_tokenizer(path)

        before, tokenize = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        tokenizer.model._resize_cache(0)  # the table replaces it
        signs = byte_signs()

        def signed(word: str) -> str:
            # U+0120 writes a space
            return "Ġ" + (word if word.isascii() else word.encode().decode("latin-1").translate(signs))

        marks = {m: [t.id for t in tokenize(m)] for m in ".,;:!?"}

        def ids_of(chunk: str) -> list[int]:
            rest = chunk[1:]
            if chunk[0] == " " and rest and (rest.isascii() or max(rest) < "\u0250"):
                if rest.isalpha():  # one word
                    return [t.id for t in tokenize(signed(rest))]
                if rest[-1] in marks and rest[:-1].isalpha():
                    return [t.id for t in tokenize(signed(rest[:-1]))] + marks[rest[-1]]
            return [t.id for w, _ in before(chunk) for t in tokenize(w)]

        def encode_new(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            flat, sizes = array("I"), array("q")
            for ids in map(ids_of, chunks):
                flat.extend(ids)
                sizes.append(len(ids))
            return np.frombuffer(flat, np.uint32), np.frombuffer(sizes, np.int64)

        _WORKER[path] = ChunkTable(encode_new)
    return _WORKER[path]
