"""Order-preserving packing of token ids into sequences by dynamic programming.

The ids of all documents of a partition, each followed by the end id, form one
stream in input order. A sequence is a window of the stream of at most
``length`` ids. Window cuts lie at document ends (free), at sentence ends
(``sentence_cost``) or, inside a span of more than ``length`` ids without any
such end, at every ``stride`` ids (``hard_cost``). With f[j] = cost[j] +
position[j], the cheapest cutting that ends at candidate j is

    f[j] = length + penalty[j] + min f[i]  over  position[i] >= position[j] - length,

a sliding minimum that a monotone queue gives in constant time per candidate.

The stream is solved in blocks of about ``block`` ids; a block's cutting ends at
its cheapest candidate within one window of the end, and the rest starts the
next block. So memory is bounded by a block and one document, and only the end
of a partition leaves a short sequence.
Partitions are independent: no shuffle. A lost task is redone from its split.

Defined cases: a null text counts as empty, and an empty document is its end
id alone; a null id, repeated rows and ties stay in input order; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.chunk_tokens import load_tokenizer, worker_table

LENGTH = 2048
BLOCK = 1_000_000
SENTENCE_COST = 4
HARD_COST = 64
STRIDE = 64
#: Texts that one encoding step holds at once.
STEP_CHARS = 4_000_000


def best_cuts(position: np.ndarray, penalty: np.ndarray, length: int, to_end: bool = True) -> list[int]:
    """Indices of the chosen candidates, first to last. ``position`` ascends
    from 0 in steps of at most ``length``. Ties prefer the longer window.
    Without ``to_end`` the cutting ends at the candidate within ``length`` of
    the end that is cheapest to reach."""
    at, cost = position.tolist(), penalty.tolist()
    f, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        low = at[j] - length
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        f[j] = length + cost[j] + f[i]
        while queue and f[queue[-1]] > f[j]:
            queue.pop()
        queue.append(j)
    stop = len(at) - 1
    if not to_end:
        near = range(int(np.searchsorted(position, at[-1] - length, side="right")), len(at))
        stop = min(near, key=lambda j: (f[j] - at[j], -j))
    cuts = [stop]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, length: int = LENGTH,
               sentence_cost: int = SENTENCE_COST, hard_cost: int = HARD_COST,
               stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and penalties in a stream; ``ends``: positions after each
    document; ``stops``: per id, whether it ends a sentence."""
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    cut = np.flatnonzero(stops[ids] | last) + 1
    position = np.concatenate([[0], cut])
    penalty = np.concatenate([[0], np.where(last[cut - 1], 0, sentence_cost)])
    wide = np.flatnonzero(np.diff(position) > length)
    if len(wide):
        hard = np.concatenate([np.arange(position[k] + stride, position[k + 1], stride) for k in wide])
        position, penalty = np.concatenate([position, hard]), np.concatenate([penalty, np.full(len(hard), hard_cost)])
        order = np.argsort(position)
        position, penalty = position[order], penalty[order]
    return position, penalty


_STOPS: dict[str, np.ndarray] = {}


def sentence_ids(path: str) -> np.ndarray:
    """Per id of the vocabulary: does its piece end a sentence or a line? A
    worker reads the vocabulary once."""
    if path not in _STOPS:
        _STOPS[path] = _sentence_ids(path)
    return _STOPS[path]


def _sentence_ids(path: str) -> np.ndarray:
    tok = load_tokenizer(path)
    size = tok.get_vocab_size()
    flags = np.zeros(size, bool)
    for piece, i in tok.get_vocab().items():
        flags[i] = piece[-1:] in (".", "!", "?", "Ċ")  # U+010A writes a line feed in byte-level pieces
    return flags


class _Packer:
    """The stream of one partition."""

    def __init__(self, stops: np.ndarray, length: int, block: int, first: int):
        self.stops, self.length, self.block, self.sequence = stops, length, block, first
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc id, ids of the document, start, ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)
        if self.held >= self.block:
            yield self.flush(last=False)

    def flush(self, last: bool) -> pa.RecordBatch:
        sizes = np.array([len(p[3]) for p in self.parts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        ids = np.concatenate([p[3] for p in self.parts]) if self.parts else np.empty(0, np.uint32)
        position, penalty = candidates(ids, ends, self.stops, self.length)
        cuts = position[best_cuts(position, penalty, self.length, to_end=last)]
        stop = int(cuts[-1])
        edges = np.union1d(cuts, begins[begins < stop])
        lows, highs = edges[:-1], edges[1:]
        part = np.searchsorted(begins, lows, side="right") - 1
        window = np.searchsorted(cuts, lows, side="right") - 1
        raw = ids.astype("<u4", copy=False)
        doc = [self.parts[p] for p in part]
        batch = pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in doc], pa.int64()),
            np.array([d[2] for d in doc], np.int64) + lows - begins[part],
            highs - lows, pa.array([d[1] for d in doc], pa.int64()), self.sequence + window, lows - cuts[window],
            pa.array([raw[a:b].tobytes() for a, b in zip(lows, highs, strict=True)], pa.binary())],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        self.sequence += int(np.count_nonzero(cuts < stop))
        keep = np.flatnonzero(ends > stop)
        rest = []
        for k in keep:
            d, total, start, own = self.parts[k]
            skip = max(0, stop - int(begins[k]))
            rest.append((d, total, start + skip, own[skip:]))
        self.parts, self.held = rest, len(ids) - stop
        return batch


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, block: int = BLOCK,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (little-endian unsigned 32-bit). ``tokenizer`` is the path of
    a tokenizers file that every executor can read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(tokenizer)
        task = TaskContext.get()
        packer = _Packer(sentence_ids(tokenizer), length, block, (task.partitionId() if task else 0) << 33)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, texts in steps(batch.column(1)):
                for key, ids in zip(keys[lo:hi], table.encode_many(texts), strict=True):
                    yield from packer.add(key, np.concatenate([ids, end]))
        if packer.parts:
            yield packer.flush(last=True)

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
                                "ids binary")


def steps(column: pa.Array, chars: int = STEP_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Slices of a text column with about ``chars`` characters each; a longer
    text is a slice of its own."""
    lo, held, size = 0, [], 0
    for hi, value in enumerate(column):
        t = value.as_py() or ""
        if size and size + len(t) > chars:
            yield lo, hi, held
            lo, held, size = hi, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield lo, lo + len(held), held


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
