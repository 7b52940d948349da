"""Token ids in compressed binary files with short-document access.

Layout, under one folder that the cluster shares:

* ``dictionary``: one row (sha256, bytes, dtype): a zstandard dictionary trained
  on the serialized id arrays of a bounded sample of documents;
* ``blocks``: rows of documents in ascending id order. A block's ``payload`` is
  ``QIDS`` | version u8 | dtype u8 (2 or 4 bytes per id) | dictionary sha256 (32)
  | count u32 | offsets u64[count + 1] | frames. Each document is one frame,
  compressed separately with the dictionary; an offset counts from the first
  frame. ``doc_ids``, ``local_starts`` and ``n_tokens`` index the block, so a
  reader fetches one frame without touching the others.

Blocks are written by Spark's Parquet writer: its commit protocol survives lost
executors and reaches any store that Spark reaches. Documents are tokenised and
compressed once, into a scratch table, and move once, already compressed, to
range partitions by id; the position of a document in the whole stream is its
position in the partition plus the ids of earlier partitions, both taken from
the written files.

Defined cases: a null text counts as empty and holds the end id alone; a null id
sorts first; rows that share an id follow each other in input order; an empty
table gives empty files and an empty result; with too few documents to train on,
the dictionary is empty and frames stand alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.chunk_tokens import worker_table
from quarry.llm.common import materialise, scratch_path
from quarry.llm.dp_packing import steps

MAGIC = b"QIDS"
#: About this many documents train the dictionary ...
SAMPLE_DOCS = 1000
#: ... up to this many serialized bytes in all, and a 64th of that each.
SAMPLE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
#: A block is closed at this many compressed bytes or documents.
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
LEVEL = 3


def _arrays(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, dtype: str) -> Iterator[tuple[pa.Array, pa.Array, list[bytes]]]:
    """doc_id, rid and serialized ids of the documents, some at a time."""
    table = worker_table(tokenizer)
    for b in batches:
        for lo, hi, texts in steps(b.column(2)):
            ids = table.encode_many(texts)
            ends = np.cumsum([len(x) + 1 for x in ids])
            flat = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype)
            own = np.ones(len(flat), bool)
            own[ends - 1] = False
            flat[own] = np.concatenate(ids) if ids else []
            raw, edges = flat.tobytes(), [0, *(ends * flat.itemsize).tolist()]
            yield (b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                   [raw[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)])


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, dtype: str) -> bytes:
    """A dictionary from documents chosen by the hash of their id, about
    ``SAMPLE_DOCS`` of them and at most ``SAMPLE_BYTES``, whole arrays only."""
    import zstandard

    every = max(1, docs.count() // SAMPLE_DOCS)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(2 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, raw in _arrays(batches, tokenizer, end_id, dtype):
            yield pa.RecordBatch.from_arrays([pa.array([r for r in raw if len(r) <= SAMPLE_BYTES // 64], pa.binary())], names=["ids"])

    samples, held = [], 0
    for r in chosen.mapInArrow(run, "ids binary").toLocalIterator():
        if held + len(r["ids"]) > SAMPLE_BYTES:
            break
        samples.append(bytes(r["ids"]))
        held += len(r["ids"])
    if len(samples) < 16 or held < 4 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, held // 8), samples).as_bytes()
    except zstandard.ZstdError:  # too little variety to learn from
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)  # else every document digests the dictionary again
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)


def _decompressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d)


def block_image(frames: list[bytes], dtype: str, digest: bytes) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return b"".join([MAGIC, bytes([1, int(dtype[-1])]), digest, struct.pack("<I", len(frames)), offsets.tobytes(), *frames])


def read_frames(payload: bytes) -> tuple[str, bytes, list[bytes]]:
    """dtype, dictionary hash and the frames of all documents of a block image."""
    if payload[:4] != MAGIC or payload[4] != 1:
        raise ValueError("not a block of token ids")
    n = struct.unpack_from("<I", payload, 38)[0]
    at = (np.frombuffer(payload, "<u8", n + 1, 42) + (42 + 8 * (n + 1))).tolist()
    return f"<u{payload[5]}", payload[6:38], [payload[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def read_frame(payload: bytes, k: int) -> tuple[str, bytes, bytes]:
    """dtype, dictionary hash and frame of document k of a block image."""
    if payload[:4] != MAGIC or payload[4] != 1:
        raise ValueError("not a block of token ids")
    n = struct.unpack_from("<I", payload, 38)[0]
    lo, hi = struct.unpack_from("<2Q", payload, 42 + 8 * k)
    base = 42 + 8 * (n + 1)
    return f"<u{payload[5]}", payload[6:38], payload[base + lo: base + hi]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
              text_col: str = "text", partitions: int | None = None) -> None:
    """Write the ids of all documents, ``end_id`` appended, in ascending id
    order. ``path`` is a folder every executor can reach."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                       F.col(text_col).alias("text"))
    dictionary = train_dictionary(cols, tokenizer, end_id, dtype)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest, dictionary, dtype)], "sha256 binary, bytes binary, dtype string").coalesce(1) \
        .write.parquet(f"{path}/dictionary")
    width = int(dtype[-1])

    # Tokenised and compressed in one Python stage: whole id arrays never cross to the JVM.
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _compressor(dictionary)
        for doc_ids, rids, raw in _arrays(batches, tokenizer, end_id, dtype):
            yield pa.RecordBatch.from_arrays(
                [doc_ids, rids, pa.array([len(r) // width for r in raw], pa.int64()),
                 pa.array([c.compress(r) for r in raw], pa.binary())], names=["doc_id", "rid", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        frames: list[bytes] = []
        counts: list[int] = []
        held = start = number = 0

        def close() -> pa.RecordBatch:
            starts = (start + np.cumsum(counts) - np.array(counts)).tolist()
            row = [[number], [block_image(frames, dtype, digest)], [ids], [starts], [counts]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        names = ["block", "payload", "doc_ids", "local_starts", "n_tokens"]
        types = [pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        for b in batches:
            for i, n, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids.append(i)
                counts.append(n)
                frames.append(f)
                held += len(f)
                if held >= BLOCK_BYTES or len(frames) >= BLOCK_DOCS:
                    yield close()
                    start, number, held = start + sum(counts), number + 1, 0
                    ids, frames, counts = [], [], []
        if frames:
            yield close()

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    framed = cols.mapInArrow(compress, "doc_id long, rid long, n_tokens long, frame binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("rid")]
    # Written first: choosing range bounds samples its input, and must not tokenise it again.
    placed = materialise(framed).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    placed.mapInArrow(blocks, "block long, payload binary, doc_ids array<long>, local_starts array<long>, "
                              "n_tokens array<long>").withColumn("part", F.spark_partition_id()) \
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def dictionary_of(spark: SparkSession, path: str) -> tuple[bytes, str]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(r["bytes"])).digest() != bytes(r["sha256"]):
        raise ValueError("the dictionary does not match its hash")
    return bytes(r["bytes"]), r["dtype"]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All documents from the files: doc_id, start (ids before it), n_tokens,
    ids (little-endian unsigned 32-bit)."""
    dictionary, _ = dictionary_of(spark, path)
    expected = hashlib.sha256(dictionary).digest()
    files = spark.read.parquet(f"{path}/blocks")
    # One row per range partition: its ids, then the ids of the partitions before it.
    sums = files.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files.join(F.broadcast(bases), "part").select("base", "payload", "doc_ids", "local_starts", "n_tokens")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _decompressor(dictionary)
        for b in batches:
            for base, payload, ids, starts, counts in zip(*[c.to_pylist() for c in b.columns], strict=True):
                dtype, digest, frames = read_frames(payload)
                if digest != expected:
                    raise ValueError("a block was written with another dictionary")
                raw = [np.frombuffer(d.decompress(f), dtype).astype("<u4").tobytes() for f in frames]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([base + s for s in starts], pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays of one document id: Parquet skips the blocks whose index
    does not hold it, and only its frames are decompressed."""
    dictionary, _ = dictionary_of(spark, path)
    d = _decompressor(dictionary)
    out = []
    for r in spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))) \
            .select("payload", "doc_ids").toLocalIterator():
        for k, i in enumerate(r["doc_ids"]):
            if i == doc_id:
                dtype, _, frame = read_frame(bytes(r["payload"]), k)
                out.append(np.frombuffer(d.decompress(frame), dtype).astype(np.uint32))
    return out


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write to a new folder under the shared one and read back."""
    path = scratch_path(docs.sparkSession)
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
