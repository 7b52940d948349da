"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

A text is split by the word pattern; each match is encoded on its own. A word is
a set of (word, position, token) rows, at first one row per byte. The recursive
query joins neighbouring rows with the merge table (left, right -> rank of the
joined bytes, which is also the id) and contracts each word's leftmost
minimum-rank pair, until no word has a pair. A word that is itself in the
vocabulary is taken whole, as the tiktoken library does.

Every distinct word is encoded once per worker: words of a batch that the worker
has not seen go through one query. Words longer than ``LONG`` bytes contract all
disjoint occurrences of their minimum-rank pair in one round where this provably
equals contracting them one by one: when no merge that uses the new token has a
lower rank (``safe``). A recursion is cut at ``DEPTH`` rounds, fewer for many
rows, and taken up again from its last state, so its memory is bounded. A long
text is encoded in slices, cut between a character that is no white space and
one that is (no token of these word patterns crosses such a place).

Decoding joins the (position, id) rows with the vocabulary, in order of position,
and concatenates each document's pieces, a bounded number of ids at once.

Defined cases: a null text counts as empty: no ids, no bytes; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.chunk_tokens import ChunkTable
from quarry.llm.dp_packing import steps

#: Positions of a word up to LONG bytes fit 6 bits, ids up to LARGEST_ID 17 bits of a row of _LEFTMOST.
LONG = 64
LARGEST_ID = (1 << 17) - 1
#: Rounds of one recursion, fewer where a query has many rows: all rounds' rows stay until its end.
DEPTH = 64
HELD_ROWS = 3_000_000
#: Code points of a text and ids that are encoded and decoded at once; longer ones go in slices.
SLICE_CHARS = 4_000_000
SLICE_IDS = 400_000
#: Bytes of new words that one recursive query holds.
QUERY_BYTES = 400_000
#: Words a worker remembers, beside the chunks of its table.
TABLE_WORDS = 400_000
TABLE_CHUNKS = 500_000
STEP_CHARS = 2_000_000

_CUT = re.compile(r"(?<=\S)(?=\s)")

_WORKER: dict[tuple[str, str], BpeCodec] = {}

#: A row is one number: word << 23 | position << 17 | token. Sorting it sorts
#: words and positions. A pair's key is rank << 12 | its position << 6 | that of its right token.
_LEFTMOST = """
with recursive state as (
  select (word::bigint << 23) | (pos::bigint << 17) | tok as v, false as done, 0 as round from words
  union all
  (with near as (
     select v, round, lead(v) over (order by v) as n from state where not done and round < {depth}),
   joined as (
     select v, round, v >> 23 as word, (m.rank::bigint << 12) | (((v >> 17) & 63) << 6) | ((n >> 17) & 63) as pair_key
     from near left join merges m on m.pair = (((v & 131071) << 32) | (n & 131071)) and (v >> 23) = (n >> 23)),
   best as (select word, min(pair_key) as low from joined group by word)
   select case when j.pair_key = b.low then ((v >> 17) << 17) | (b.low >> 12) else v end, b.low is null, j.round + 1
   from joined j join best b using (word) where b.low is null or ((v >> 17) & 63) <> (b.low & 63))
)
select (v >> 23)::int as word, ((v >> 17) & 63)::int as pos, (v & 131071)::int as tok, done
from state where done or round = {depth}
"""

_DISJOINT = """
with recursive state as (
  select word, pos, tok, false as done, 0 as round from words
  union all
  (with near as (
     select word, pos, tok, round, lead(tok) over o as nxt, row_number() over o as idx
     from state where not done and round < {depth} window o as (partition by word order by pos)),
   joined as (
     select near.*, m.rank, m.safe from near left join merges m on m.pair = ((near.tok::bigint << 32) | near.nxt)),
   best as (
     select word, min(rank) as rank, arg_min(idx, (rank::bigint << 32) | idx) as spot from joined group by word),
   hits as (
     select j.*, b.rank as low, b.spot, b.rank is not null and j.rank is not distinct from b.rank as hit
     from joined j join best b using (word)),
   runs as (
     select *, idx - row_number() over (partition by word, hit order by idx) as run from hits),
   chosen as (
     select *, hit and (idx = spot or (safe and (row_number() over (partition by word, hit, run order by idx)) % 2 = 1))
       as take from runs),
   dropped as (select *, lag(take) over (partition by word order by idx) as gone from chosen)
   select word, pos, case when take then low else tok end, low is null, round + 1
   from dropped where gone is not true)
)
select word, pos, tok, done from state where done or round = {depth}
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """pair (left id << 32 | right id), rank of the joined bytes, safe: no merge
    of a pair with this token has a lower rank."""
    left, right, rank = [], [], []
    for piece, r in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
    a, b, r = (np.array(x, np.int64) for x in (left, right, rank))
    size = max(ranks.values()) + 1 if ranks else 1
    lowest = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(lowest, a, r)
    np.minimum.at(lowest, b, r)
    return pa.table({"pair": (a << 32) | b, "rank": r.astype(np.int32), "safe": lowest[r] > r})


class BpeCodec:
    """Encoder and decoder of one Python worker: one DuckDB connection with the
    merge table and the vocabulary."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})
        self.db.execute("set temp_directory = ''")
        self._load("merges", merge_table(self.ranks))
        if max(self.ranks.values()) > LARGEST_ID:
            raise ValueError(f"ids above {LARGEST_ID} do not fit a row")
        self._load("vocab", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array(list(self.ranks), pa.binary())}))
        self.decimal = pa.array([str(i) for i in range(max(self.ranks.values()) + 1)])
        self.table = ChunkTable(self._encode_chunks, TABLE_CHUNKS)
        self.words: dict[str, bytes] = {}  # ids as little-endian 32-bit integers

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def _query(self, sql: str, table: pa.Table) -> pa.Table:
        self.db.register("words", table)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister("words")
        return out

    def _contract(self, words: list[bytes], sql: str) -> list[np.ndarray]:
        """The ids of each word; ``words`` are not in the vocabulary whole."""
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        pos = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        final: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            got = self._query(sql.format(depth=max(1, min(DEPTH, HELD_ROWS // len(word)))), pa.table({"word": word, "pos": pos, "tok": tok}))
            w, p, t = (got.column(c).to_numpy() for c in ("word", "pos", "tok"))
            done = got.column("done").to_numpy()
            final.append((w[done], p[done], t[done]))
            word, pos, tok = w[~done], p[~done], t[~done]
        w, p, t = (np.concatenate(x) for x in zip(*final, strict=True))
        order = np.lexsort((p, w))
        edges = np.searchsorted(w[order], np.arange(len(words) + 1))
        t = t[order]
        return [t[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode_words(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        out = {w: np.array([self.ranks[w]], np.int32) for w in words if w in self.ranks}
        for sql, part in ((_LEFTMOST, [w for w in words if w not in out and len(w) <= LONG]),
                          (_DISJOINT, [w for w in words if w not in out and len(w) > LONG])):
            lo = held = 0
            for hi, w in enumerate(part):
                held += len(w)
                if held >= QUERY_BYTES or hi == len(part) - 1:
                    own = part[lo: hi + 1]
                    out.update(zip(own, self._contract(own, sql), strict=True))
                    lo, held = hi + 1, 0
        return out

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split.findall(c) for c in chunks]
        if len(self.words) > TABLE_WORDS:
            self.words = {}
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in self.words))
        ids = self.encode_words([w.encode() for w in fresh])
        self.words.update((w, ids[w.encode()].astype("<u4").tobytes()) for w in fresh)
        sizes = [sum([len(self.words[w]) for w in ws]) // 4 for ws in split]
        return np.frombuffer(b"".join([self.words[w] for ws in split for w in ws]), "<u4"), np.array(sizes, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if max(map(len, texts), default=0) <= SLICE_CHARS:
            return self.table.encode_many(texts)
        out = []
        for text in texts:
            parts, at = [], 0
            while at < len(text):
                cut = _CUT.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
                end = cut.start() if cut else len(text)
                parts += self.table.encode_many([text[at:end]])
                at = end
            out.append(np.concatenate(parts) if parts else np.empty(0, np.uint32))
        return out

    def _decode_rows(self, ids: list[np.ndarray]) -> list[bytes]:
        size = np.array([len(x) for x in ids], np.int64)
        every = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        got = self._query("select piece from words join vocab using (id) order by pos",
                          pa.table({"pos": np.arange(len(every), dtype=np.int32), "id": every}))
        if len(got) != len(every):
            raise ValueError("ids outside the vocabulary")
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, got.column("piece").combine_chunks()), b"").to_pylist()

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list; at most SLICE_IDS ids in one query."""
        pieces: list[list[bytes]] = [[] for _ in ids]
        held: list[tuple[int, np.ndarray]] = []
        room = SLICE_IDS

        def flush() -> None:
            for (i, _), found in zip(held, self._decode_rows([x for _, x in held]), strict=True):
                pieces[i].append(found)
            held.clear()

        for i, own in enumerate(ids):
            lo = 0
            while lo < len(own):
                part = own[lo: lo + room]
                held.append((i, part))
                lo, room = lo + len(part), room - len(part)
                if not room:
                    flush()
                    room = SLICE_IDS
        if held:
            flush()
        return [b"".join(p) for p in pieces]

    def ids_sha256(self, ids: np.ndarray) -> str:
        """Of the decimal ids, joined by commas."""
        total = hashlib.sha256()
        for lo in range(0, len(ids), SLICE_IDS):
            words = self.decimal.take(pa.array(ids[lo: lo + SLICE_IDS]))
            total.update((b"," if lo else b"") + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), ",")[0].as_buffer())
        return total.hexdigest()


def worker_codec(path: str, pattern: str) -> BpeCodec:
    key = (path, pattern)
    if key not in _WORKER:
        _WORKER[key] = BpeCodec(path, pattern)
    return _WORKER[key]


def _coded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    """doc_id and ``columns(codec, ids, decoded)`` of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path, pattern)
        for b in batches:
            for lo, hi, texts in steps(b.column(1), STEP_CHARS):
                ids = codec.encode(texts)
                made = columns(codec, ids, codec.decode(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *made.values()], names=["doc_id", *made])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, f"doc_id long, {schema}")


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary) of every whole text.
    ``path`` is a rank file that every executor can read."""
    def columns(codec: BpeCodec, ids: list[np.ndarray], decoded: list[bytes]) -> dict[str, pa.Array]:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
        return {"ids": lists, "decoded": pa.array(decoded, pa.binary())}

    return _coded(docs, path, pattern, id_col, text_col, "ids array<int>, decoded binary", columns)


def encode_decode_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what ``encode_decode``
    gives, digested where it is made, so ids and bytes stay in their task."""
    def columns(codec: BpeCodec, ids: list[np.ndarray], decoded: list[bytes]) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([codec.ids_sha256(x) for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded])}

    return _coded(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
