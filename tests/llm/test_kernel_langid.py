import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.kernel_langid import GramIndex, fit, identify, predict, presence, _sample
from tests.llm.conftest import bag

DATA = "/root/testdata/sf0.01"


def grams(text):
    """The set of 1- to 3-grams, in plain Python."""
    out = [" "]
    for ch in f" {text.lower()} ":
        ch = ch if unicodedata.category(ch)[0] in "LM" else " "
        if ch != " " or out[-1] != " ":
            out.append(ch)
    s = "".join(out)
    return {s[i: i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def key(gram):
    k = 0
    for ch in gram:
        k = k << 21 | ord(ch)
    return k


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    return df.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


@pytest.fixture(scope="module")
def model(labelled):
    return fit(labelled, train_texts=200, landmarks=24, vocab=3000)


def test_scores_equal_plain_kernels(model, rows):
    """Kernels by Python sets and the fitted weights give the same scores."""
    vocabulary = {int(k): i for i, k in enumerate(model.keys)}
    bits = np.unpackbits(model.landmarks, axis=1, count=len(model.keys))
    marks = [set(np.flatnonzero(b).tolist()) for b in bits]
    texts = [t for _, t in rows]
    got, letters = model.scores(texts)
    for t, s, has in zip(texts, got, letters, strict=True):
        own = {vocabulary[key(g)] for g in grams(t) if key(g) in vocabulary}
        k = [len(own & m) / math.sqrt(max(1, len(own)) * len(m)) for m in marks]
        plain = [min(1, max(0, (sum(a * w for a, w in zip(k, model.weights[:, j], strict=True)) + model.bias[j] + 1) / 2))
                 for j in range(len(model.languages))]
        assert has == any(unicodedata.category(c)[0] == "L" for c in t)
        assert np.allclose(s, plain, atol=1e-7)


def test_weights_solve_the_ridge_problem(labelled, model):
    """The distributed fit equals kernel ridge regression on Nystroem features
    computed in one place: no other weights have a smaller loss."""
    sample = _sample(labelled.select("lang", "text"), dict.fromkeys(model.languages, 50)).collect()
    k, _ = model.kernel([r["text"] for r in sample])
    y = np.array([[1.0 if g == r["lang"] else -1.0 for g in model.languages] for r in sample])
    rows = np.unpackbits(model.landmarks, axis=1, count=len(model.keys)).astype(float)
    n = np.sqrt(rows.sum(axis=1))
    own = rows @ rows.T / n[:, None] / n[None, :]

    def loss(w, b):
        return ((k @ w + b - y) ** 2).sum() + 1e-4 * len(k) * np.einsum("ij,ik,kj->", w, own, w)

    best = loss(model.weights, model.bias)
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1e-2):
        for _ in range(10):
            moved = model.weights + np.linalg.pinv(own) @ rng.normal(0, scale, model.weights.shape)
            assert loss(moved, model.bias + rng.normal(0, scale, model.bias.shape)) >= best * (1 - 1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_not_used(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    blind = docs.withColumn("lang", F.when(~F.coalesce(held, F.lit(False)), F.col("lang")))
    assert bag(map(tuple, identify(blind).collect())) == bag(map(tuple, identify(docs).collect()))


def test_edge_rows(spark, docs, clash, empty):
    got = identify(docs).collect()
    assert len(got) == docs.count()
    none = {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (r["doc_id"] in none)
        assert r["lang_pred"] != "und" or r["score"] == 0
    assert bag(map(tuple, identify(clash).collect())) == bag(map(tuple, got))
    assert identify(empty).count() == 0
    unlabelled = identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    one = identify(docs.withColumn("lang", F.lit("xx"))).select("lang_pred").distinct().collect()
    assert {r[0] for r in one} == {"xx", "und"}


def test_long_text_in_slices(model, labelled):
    """Slices of a long text give the grams of the whole."""
    text = "".join(r["text"] for r in labelled.select("text").limit(400).collect())
    assert len(text) > 600_000
    index = model._ready()[0]
    row, letters = presence(["", text, "ab"], index)
    vocabulary = {int(k): i for i, k in enumerate(model.keys)}
    assert set(np.flatnonzero(row[1])) == {vocabulary[key(g)] for g in grams(text) if key(g) in vocabulary}
    assert letters.tolist() == [False, True, True]


def test_gram_index_is_exact():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 62, 5000).astype(np.uint64))
    index = GramIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(1, 1 << 62, 20000).astype(np.uint64), keys)
    assert (index.find(other) == len(keys)).all()
    assert (GramIndex(np.empty(0, np.uint64)).find(other) == 0).all()


def test_sample_is_bounded_and_copies_weigh_once(spark):
    rows = [("en", "same text")] * 500 + [("en", f"text {i}") for i in range(300)] + [("de", "ein Text")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    got = _sample(df, {"en": 40, "de": 40}).collect()
    assert sum(r["lang"] == "en" for r in got) == 40 and sum(r["lang"] == "de" for r in got) == 1
    assert len({(r["lang"], r["text"]) for r in got}) == len(got)
    assert predict(df.limit(0), None, [F.col("lang").alias("k")]).count() == 0
