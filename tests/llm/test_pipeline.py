"""The five stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline as P
from quarry.llm.chunk_tokens import load_tokenizer
from quarry.llm.queries import tokenizer_path
from quarry.llm.rule_ensemble import classify
from quarry.llm.secret_links import find_secrets
from tests.llm import test_exact_dedup, test_secret_links, test_simhash_gph
from tests.llm.conftest import SMALL, bag


def pairs(df):
    return bag((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "secrets", "packing"]
    assert set(P.QUERIES) == {"pipeline"} and P.ORACLE_SQL is None


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = P.quality(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = Counter(r["doc_id"] for r in classify(docs, labels).where("predicted = 1").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_exact_and_near(spark, docs, rows):
    kept = P.exact(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert bag(i for i, _ in pairs(kept)) == bag(x[0] for x in test_exact_dedup.brute(rows) if x[3])
    left = [(i, t or "") for i, t in pairs(kept)]
    single = P.near(spark, kept, SMALL)
    assert single.columns == docs.columns
    of = test_simhash_gph.classes(test_simhash_gph.plain_fingerprint(t) for _, t in left)
    assert single.count() == len(set(of.values()))
    found = [of[test_simhash_gph.plain_fingerprint(t or "")] for _, t in pairs(single)]
    assert len(found) == len(set(found))


def test_secrets(spark, docs):
    spans = {}
    for r in find_secrets(docs.withColumn("t", docs["text"]), keep=("t",)).collect():
        text, at = r["t"], 0
        if r["spans"]:
            out = ""
            for s, e in sorted((s["start"], s["end"]) for s in r["spans"]):
                if s >= at:
                    out += text[at:s] + "[SECRET]"
                at = max(at, e)
            text = out + text[at:]
        spans.setdefault(r["doc_id"], []).append(text)
    done = P.secrets(spark, docs, SMALL)
    assert done.columns == docs.columns
    assert pairs(done) == bag((i, t) for i, ts in spans.items() for t in ts)
    for r in done.collect():
        assert not test_secret_links.base(r["text"] or "")
        assert r["text"] is None or r["n_chars"] == len(r["text"])


def test_run(spark):
    out = P.run(spark, SMALL).collect()
    tok = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    docs = P.documents(spark, SMALL)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    want = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == want[r["doc_id"]]
    assert got == want and 0 < len(want) < 200


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
