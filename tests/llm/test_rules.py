"""Text statistics, the rule ensemble and the robust outliers."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import robust_outliers as O
from quarry.llm import rule_ensemble as R
from quarry.llm.text_stats import COUNTS, count_text, text_stats
from tests.llm.conftest import SMALL, bag


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_counts_equal_the_definitions(docs, rows, clash, empty):
    want = bag((i, *plain_counts(t).values()) for i, t in rows)
    for df in (docs, clash.drop("n_words")):
        got = text_stats(df).select("doc_id", *plain_counts("")).collect()
        assert bag(tuple(r) for r in got) == want
    assert text_stats(empty).count() == 0


def test_counts_of_random_texts():
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice(["a", "b", " ", " ", "\n", "a b a b a ", "\x1c", "é|", "\t", "\x85"]) for _ in range(rng.randrange(60)))
        got = dict(zip(COUNTS, count_text(t), strict=True))
        assert {k: got[k] for k in plain_counts(t)} == plain_counts(t), repr(t)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_rules_are_paths_of_the_tree():
    debug = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 0.75)
    Predict: 1.0
   Else (feature 0 > 0.75)
    Predict: 0.0
"""
    inf = float("inf")
    assert R.tree_rules(debug, ["a", "b"]) == {
        (("a", -inf, 0.5),), (("a", -inf, 0.5), ("b", -inf, 2.0)), (("a", -inf, 0.5), ("b", 2.0, inf)), (("a", 0.5, inf),),
        (("a", 0.5, 0.75),), (("a", 0.75, inf),)}


def test_held_out_accuracy(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = R.classify(docs, labels).join(labels, "doc_id").collect()
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_held_out_labels_do_not_matter(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    turned = labels.withColumn("quality", F.when(R.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in R.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in R.classify(docs, turned).collect()}
    assert a == b


def test_compiled_score_equals_the_rules(spark):
    model = R.RuleModel(-0.5, [((("words", 1.0, 3.0),), 2.0), ((("upper", float("-inf"), 0.2), ("words", 2.0, float("inf"))), -1.25)])
    df = spark.createDataFrame([(0.5, 0.0), (2.0, 0.5), (2.5, 0.1), (9.0, 0.2)], "words double, upper double")
    got = [r[0] for r in df.select(model.score()).collect()]
    want = [1 / (1 + np.exp(-(-0.5 + 2.0 * (1 < w <= 3) - 1.25 * (u <= 0.2 and w > 2)))) for w, u in df.collect()]
    assert np.allclose(got, want)


def test_classifier_edges(docs, clash, empty, labels, spark):
    n = docs.count()
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, None), (2, 0, 0)], labels.schema))
    out = R.classify(docs, odd).collect()
    assert len(out) == n and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
    assert R.classify(clash, labels).count() == n and R.classify(empty, labels).count() == 0
    none = R.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one = R.classify(docs, labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)
    kept = R.drop_rejected(clash, labels)
    assert kept.columns == clash.columns and 0 < kept.count() <= n


def test_chi_square_quantiles():
    for p, d, want in ((0.95, 1, 3.8415), (0.975, 6, 14.4494), (0.5, 2, 1.3863), (0.999, 5, 20.515)):
        assert abs(O.chi2_quantile(p, d) - want) < 1e-3


def test_estimates_resist_contamination(spark):
    """Mean and covariance of the bulk, with a fifth of the rows far away; the
    second group is only noise around another centre."""
    rng = np.random.default_rng(4)
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    good = rng.multivariate_normal([1, -1], cov, 4000)
    bad = rng.multivariate_normal([9, 9], np.eye(2) * 0.2, 1000)
    other = rng.multivariate_normal([5, 5], np.eye(2), 800)
    data = [("a", *map(float, r)) for r in np.vstack([good, bad])] + [("b", *map(float, r)) for r in other]
    rows = spark.createDataFrame(data, "g string, x0 double, x1 double").repartition(5)
    got = {r["g"]: r for r in O.mcd(rows, 2, floors=(0.01, 0.01)).collect()}
    assert np.allclose(got["a"]["mean"], [1, -1], atol=0.12) and np.allclose(got["b"]["mean"], [5, 5], atol=0.15)
    assert np.allclose(np.linalg.inv(np.array(got["a"]["prec"]).reshape(2, 2)), cov, atol=0.25)


def test_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    out = O.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    got = out.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count(F.lit(1)))
    share = {r["quality"]: r["k"] for r in got.collect()}
    assert share[1] > 0.97 and share[0] < 0.4


def test_outlier_edges(docs, rows, clash, empty):
    def digest(df):
        return bag((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in O.digest(O.judge(df)).collect())

    got = digest(docs)
    assert len(got) == len(rows)
    for i, n, failed, kept in got:
        assert not (failed and kept) and (n >= 10 or failed)
    assert digest(clash.drop("n_words")) == got == digest(clash)
    assert digest(empty) == []
    assert len(digest(docs.limit(5))) == 5
