"""Quality classifier: a sparse rule ensemble compiled to column expressions.

1. ``text_stats`` counts every whole text once; ratios of the counts are the
   statistics.
2. A random forest of shallow trees is grown on the labelled rows. Every path
   from a root is a rule: a conjunction of bounds on statistics.
3. A lasso logistic regression weights the rules; most weights become 0. Rows
   with equal rule values and label are one weighted row, so the regression
   works on few rows however many labels there are.
4. The remaining rules compile to one expression over statistic columns:
   1 / (1 + exp(-(bias + sum of weights of true rules))).

The fit reads all labelled rows (no sample); labels, language, source and id are
never inputs of the score.

Defined cases: a null text counts as empty and is scored like an empty text;
null labels are left out; a document that appears in the labels more than once
counts once per label; without labels of both kinds the score is the share of
label 1 (0.5 without any) everywhere; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise
from quarry.llm.text_stats import text_stats

TREES = 20
DEPTH = 3
#: Labels that ``drop_rejected`` learns from, about, at most.
FIT_ROWS = 200_000
LASSO = 0.0005
ROUNDS = 60
SEED = 17


def statistics() -> dict[str, Column]:
    """Ratios of the counts, defined for empty texts too."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {
        "words": F.log1p(F.col("n_words").cast("double")), "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / chars, "line_words": F.log1p(F.col("n_words") / lines),
        "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / chars, "digits": F.col("n_digits") / chars, "marks": F.col("n_marks") / chars,
        "stops": F.col("n_stops") / chars, "distinct": F.col("n_distinct") / words, "adjacent": F.col("n_adjacent") / words,
    }


#: A bound: (statistic, lowest value excluded, highest value included).
Rule = tuple[tuple[str, float, float], ...]


def compile_rule(rule: Rule) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        if low != float("-inf"):
            out = out & (F.col(name) > low)
        if high != float("inf"):
            out = out & (F.col(name) <= high)
    return out


def tree_rules(debug: str, names: list[str]) -> set[Rule]:
    """The rules of all nodes below the root, from a tree's description: lines
    ``If (feature i <= t)`` and ``Else (feature i > t)``, one deeper each."""
    rules: set[Rule] = set()
    path: list[tuple[int, str, str, float]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, sign, t in path:
            low, high = bounds.get(name, (float("-inf"), float("inf")))
            bounds[name] = (low, min(high, t)) if sign == "<=" else (max(low, t), high)
        rules.add(tuple((n, *b) for n, b in sorted(bounds.items())))
    return rules


@dataclass
class RuleModel:
    bias: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The probability of label 1 as a column over statistic columns."""
        total = F.lit(self.bias)
        for rule, w in self.weights:
            total = total + F.when(compile_rule(rule), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(train: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO,
        seed: int = SEED) -> RuleModel:
    """``train``: statistic columns and a label of 0 or 1."""
    names = list(statistics())
    rows = materialise(train.select(*names, F.col(label).cast("double").alias("label")))
    share, n, kinds = rows.agg(F.avg("label"), F.count(F.lit(1)), F.countDistinct("label")).first()
    if kinds < 2:
        return RuleModel(0.0 if not n else 20.0 if share > 0.5 else -20.0, [])
    vector = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
                                    subsamplingRate=1.0, maxBins=64).fit(vector.transform(rows))
    rules = sorted(set().union(*[tree_rules(t.toDebugString, names) for t in forest.trees]))
    if not rules:
        return RuleModel(0.0, [])
    held = F.concat(*[F.when(compile_rule(r), F.lit("1")).otherwise(F.lit("0")) for r in rules])
    counted = materialise(rows.select(held.alias("bits"), "label").groupBy("bits", "label").agg(
        F.count(F.lit(1)).cast("double").alias("weight")))
    columns = [F.substring("bits", i + 1, 1).cast("double").alias(f"r{i}") for i in range(len(rules))]
    wide = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        counted.select("label", "weight", *columns)).select("label", "weight", "features")
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=ROUNDS, weightCol="weight").fit(wide)
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w != 0.0]
    return RuleModel(float(model.intercept), weights)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never read: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _known(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id, label of the labels that may be learnt."""
    return labels.select("doc_id", F.col(label_col).alias("label")).where(~held_out()).where("label in (0, 1)")


def _learn(stats: DataFrame, known: DataFrame) -> RuleModel:
    return fit(stats.join(known, "doc_id").select("label", *statistics()))


def _statistics_of(docs: DataFrame) -> DataFrame:
    counted = text_stats(docs.select("doc_id", "text"), keep=("doc_id",))
    return materialise(counted.select("doc_id", *[c.alias(n) for n, c in statistics().items()]))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = _statistics_of(docs)
    model = _learn(stats, _known(labels, label_col))
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows predicted 0, all columns kept. The fit counts
    only texts that have a label, of about ``fit_rows`` labels at most (those of
    least id hash): their ids are a bounded broadcast. Every text is then counted
    and scored in place, so no text is shuffled."""
    known = _known(labels, label_col)
    share = min(1.0, fit_rows / max(1, known.count()))
    known = materialise(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(share) * (1 << 30)))
    labelled = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = _learn(_statistics_of(labelled), known)
    names = [f"_q_{i}" for i in range(len(docs.columns))]  # the caller's names cannot clash with the counts
    own = docs.toDF(*names)
    counted = text_stats(own, text_col=names[docs.columns.index("text")], keep=tuple(names))
    scored = counted.select(*names, *[c.alias(n) for n, c in statistics().items()])
    return scored.where(model.score() >= 0.5).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
