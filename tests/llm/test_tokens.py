import hashlib
import inspect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quarry.llm import dp_packing, duckdb_bpe, zstd_ids
from quarry.llm.chunk_tokens import ChunkTable, load_tokenizer, worker_table
from tests.llm.conftest import EDGE, bag

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coded(rows):
    tok = load_tokenizer(JSON)
    return [(i, tok.encode(t, add_special_tokens=False).ids) for i, t in rows]


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def random_texts(n=300):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "a", "Word", "naïve", "Größe.", "ǅx", "the,", "don't", "I'LL", "42", "é", "日本",
             "🙂", "!?", "...", "<|endoftext|>", "_", "x" * 30]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_chunk_table_equals_whole_text_encoding():
    tok = load_tokenizer(JSON)
    texts = random_texts() + [e[1] or "" for e in EDGE]
    got = worker_table(JSON).encode_many(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_full_table_starts_anew():
    seen = []
    table = ChunkTable(lambda cs: (np.array([ord(x) for c in cs for x in c], np.uint32), np.array([len(c) for c in cs])), limit=5)
    texts = [f"a b{k} c{k}\nd{k}" for k in range(6)]
    for t in texts:
        seen += table.encode_many([t])
    assert [x.tolist() for x in seen] == [[ord(x) for x in t] for t in texts] and table.rows < 16


def tiktoken_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=duckdb_bpe.read_ranks(RANKS),
                             special_tokens={})


def test_bpe_equals_tiktoken(docs, rows, empty, clash):
    enc = tiktoken_encoding()
    want = bag((i, enc.encode_ordinary(t), t.encode()) for i, t in rows)
    for df in (docs, clash):
        got = duckdb_bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN).collect()
        assert bag((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got) == want
    assert duckdb_bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_odd_texts_and_long_words():
    enc = tiktoken_encoding()
    codec = duckdb_bpe.BpeCodec(RANKS, public_tokenizers.PATTERN)
    texts = random_texts() + ["a" * 700 + "b" * 300, " " * 500, "abab" * 60, "日本" * 90, "xkcdqz9" * 60, "=" * 999]
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def check_pieces(pieces, coded, end_id, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r["offset"])
        at = 0
        for r in rs:
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert sum(r["length"] for r in pieces) == sum(len(ids) + 1 for _, ids in coded)
    want = defaultdict(list)
    for i, ids in coded:
        want[i].append(ids + [end_id])
    assert set(want) == set(by_doc)
    for i, lists in want.items():
        if len(lists) == 1:  # pieces of one document, in order
            rs = sorted(by_doc[i], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in rs) == u4(lists[0])
            assert [r["start"] for r in rs] == np.concatenate([[0], np.cumsum([r["length"] for r in rs])[:-1]]).tolist()
            assert {r["doc_tokens"] for r in rs} == {len(lists[0])}
    return by_sequence


@pytest.mark.parametrize("block", [1_000_000, 5_000])
def test_packing(docs, coded, block):
    pieces = dp_packing.pack(docs.coalesce(2), JSON, block=block).collect()
    sequences = check_pieces(pieces, coded, 1, 2048)
    total = sum(len(ids) + 1 for _, ids in coded)
    full = -(-total // 2048)
    assert len(sequences) <= full * 1.02 + 3


def test_packing_edges(empty, clash, coded):
    assert dp_packing.pack(empty, JSON).count() == 0
    check_pieces(dp_packing.pack(clash, JSON).collect(), coded, 1, 2048)


def test_cuts_are_optimal():
    """The monotone queue against the quadratic recurrence."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        position = np.concatenate([[0], np.cumsum(rng.integers(1, 12, rng.integers(1, 60)))])
        penalty = rng.choice([0, 2, 9], len(position))
        cuts = dp_packing.best_cuts(position, penalty, 20)
        best = [0] + [10**9] * (len(position) - 1)
        for j in range(1, len(position)):
            for i in range(j):
                if position[j] - position[i] <= 20:
                    best[j] = min(best[j], best[i] + 20 - (position[j] - position[i]) + penalty[j])
        cost = sum(20 - (position[b] - position[a]) + penalty[b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        assert cuts[0] == 0 and cuts[-1] == len(position) - 1 and cost == best[-1]


def test_binary_round_trip(spark, docs, coded, tmp_path, clash):
    for k, df in enumerate((docs.repartition(7), clash)):
        path = f"file://{tmp_path}/ids{k}"
        zstd_ids.write_ids(df, path, JSON, end_id=2, partitions=5)
        got = zstd_ids.read_ids(spark, path).collect()
        got.sort(key=lambda r: r["start"])
        at = 0
        for r in got:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
        assert keys == sorted(keys)
        assert bag((r["doc_id"], bytes(r["ids"])) for r in got) == bag((i, u4(ids + [2])) for i, ids in coded)
        crc = {r["start"]: r["ids_crc32"] for r in zstd_ids.digest(zstd_ids.read_ids(spark, path)).collect()}
        assert all(crc[r["start"]] == zlib.crc32(bytes(r["ids"])) for r in got)
    single = dict(coded)
    for i in (0, 17, 910):
        assert [x.tolist() for x in zstd_ids.read_document(spark, path, i)] == [single[i] + [2]]
    assert len(zstd_ids.read_document(spark, path, 905)) == 3 and zstd_ids.read_document(spark, path, -5) == []


def test_binary_output_of_an_empty_table(empty):
    assert zstd_ids.round_trip(empty, JSON).count() == 0


def test_a_changed_dictionary_is_noticed(spark, docs, tmp_path):
    path = f"file://{tmp_path}/x"
    zstd_ids.write_ids(docs.limit(40), path, JSON, partitions=2)
    d, dtype = zstd_ids.dictionary_of(spark, path)
    spark.createDataFrame([(b"0" * 32, b"other", dtype)], "sha256 binary, bytes binary, dtype string") \
        .write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        zstd_ids.read_ids(spark, path)


def test_very_long_texts_encode_and_decode_in_bounded_memory():
    """A text of 17 MB: several slices for encoding, many for decoding."""
    rng = np.random.default_rng(7)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 9, 3000)]
    long = " ".join(words[i] for i in rng.integers(0, 3000, 3_100_000))
    assert len(long) > 16_000_000
    texts = [long, "short é\n\n  end", ""]
    enc = tiktoken_encoding()
    codec = duckdb_bpe.BpeCodec(RANKS, public_tokenizers.PATTERN)
    got = codec.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)
    assert codec.decode(got) == [t.encode() for t in texts]
    assert codec.ids_sha256(got[0]) == hashlib.sha256(",".join(map(str, got[0].tolist())).encode()).hexdigest()


def test_digest_in_task_equals_digest_of_results(docs):
    full = duckdb_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted(((r["doc_id"], len(r["ids"]), hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest(),
                    hashlib.sha256(bytes(r["decoded"])).hexdigest()) for r in full), key=repr)
    got = duckdb_bpe.encode_decode_digest(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_decoding_in_one_ordered_join():
    """Pieces of several lists, empty ones between, by position; an id outside the vocabulary is an error."""
    codec = duckdb_bpe.BpeCodec(RANKS, public_tokenizers.PATTERN)
    texts = ["", "é🙂 ab", "", "the the cat\n\n\tsat", "x" * 200, ""]
    ids = codec.encode(texts)
    assert codec.decode(ids) == [t.encode() for t in texts] and codec.decode([]) == []
    assert [codec.ids_sha256(i) for i in ids] == [hashlib.sha256(",".join(map(str, i.tolist())).encode()).hexdigest() for i in ids]
    assert "string_agg" not in inspect.getsource(duckdb_bpe)
    with pytest.raises(ValueError, match="outside the vocabulary"):
        codec.decode([np.array([duckdb_bpe.LARGEST_ID], np.uint32)])


def test_frames_of_a_block_at_once():
    frames = [b"", b"abc", b"d" * 70_000]
    image = zstd_ids.block_image(frames, "<u4", b"h" * 32)
    assert zstd_ids.read_frames(image) == ("<u4", b"h" * 32, frames)
    assert [zstd_ids.read_frame(image, k)[2] for k in range(3)] == frames
