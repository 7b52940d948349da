"""Evaluation aggregates built on one confusion-count kernel.

Every metric of a multiple-choice run (accuracy, per-letter precision /
recall / F1, macro F1 under either averaging rule) is a function of the 5x5
confusion counts. So the row-level work is ONE hash aggregation per grouping
key producing 25 conditional counts (partial aggregation map-side, so a key
holding a third of all rows still shuffles one small buffer per task), and
everything after that is scalar column arithmetic on a handful of rows.
Written as explicit expressions, the floating-point results are bit-identical
to the same arithmetic in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The answer label set.
LETTERS = ("A", "B", "C", "D", "E")
# Academic-year order used by the level breakdown.
LEVELS = ("Y1", "Y2", "Y3", "Y4", "Y5")


def cell(g: str, p: str, prefix: str = "n_") -> str:
    return f"{prefix}{g}{p}"


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


# --------------------------------------------------------------------------
# Kernel
# --------------------------------------------------------------------------

def confusion_wide(df: DataFrame, keys: Sequence[str] = ("run_name",),
                   gold: str = "gold_label", pred: str = "pred_label",
                   weight: str | None = None) -> DataFrame:
    """keys + n + n_correct + 25 cell counts ``n_<gold><pred>``, one row per key.
    With ``weight`` the counts are weighted sums (bootstrap replicates)."""
    return df.groupBy(*keys).agg(*cell_aggs(gold, pred, weight))


def cell_aggs(gold: str = "gold_label", pred: str = "pred_label", weight: str | None = None,
              prefix: str = "n_", totals: bool = True) -> list[Column]:
    """The kernel's aggregate expressions (usable inside a larger ``agg``)."""
    g, p = F.col(gold), F.col(pred)
    if weight is None:
        def cnt(cond):
            return F.count_if(cond)
        total = F.count(F.lit(1))
    else:
        def cnt(cond):
            return F.sum(F.when(cond, F.col(weight)).otherwise(0))
        total = F.sum(weight)
    aggs = [total.alias("n"), cnt(g == p).alias("n_correct")] if totals else []
    aggs += [cnt((g == a) & (p == b)).alias(cell(a, b, prefix)) for a in LETTERS for b in LETTERS]
    return aggs


def cell_array(prefix: str = "n_") -> Column:
    """The 25 counts as one array, index = gold * 5 + pred."""
    return F.array(*[F.col(cell(a, b, prefix)) for a in LETTERS for b in LETTERS])


def support(L: str, prefix: str = "n_") -> Column:
    """Gold count of letter L (row sum)."""
    return _sum([F.col(cell(L, b, prefix)) for b in LETTERS])


def predicted(L: str, prefix: str = "n_") -> Column:
    """Predicted count of letter L (column sum)."""
    return _sum([F.col(cell(a, L, prefix)) for a in LETTERS])


def precision(L: str, prefix: str = "n_") -> Column:
    return _safe_div(F.col(cell(L, L, prefix)), predicted(L, prefix))


def recall(L: str, prefix: str = "n_") -> Column:
    return _safe_div(F.col(cell(L, L, prefix)), support(L, prefix))


def f1(L: str, prefix: str = "n_") -> Column:
    """2tp / (2tp + fp + fn) = 2tp / (support + predicted); 0 when both are 0."""
    return _safe_div(2 * F.col(cell(L, L, prefix)), support(L, prefix) + predicted(L, prefix))


def accuracy_col(correct: str = "n_correct", total: str = "n") -> Column:
    """Share of exact matches; 0 for an empty group."""
    return _safe_div(F.col(correct), F.col(total))


def trace(prefix: str = "n_") -> Column:
    return _sum([F.col(cell(L, L, prefix)) for L in LETTERS])


def macro_f1_fixed_col(prefix: str = "n_") -> Column:
    """Mean F1 over all five letters, always divided by 5."""
    return _sum([f1(L, prefix) for L in LETTERS]) / F.lit(5.0)


def macro_f1_present_col(prefix: str = "n_") -> Column:
    """Mean F1 over the letters occurring in gold or prediction (labels absent
    from both have F1 0, so only the divisor differs from the fixed rule)."""
    present = _sum([F.when(support(L, prefix) + predicted(L, prefix) > 0, 1).otherwise(0) for L in LETTERS])
    return F.when(present == 0, F.lit(0.0)).otherwise(_sum([f1(L, prefix) for L in LETTERS]) / present)


# --------------------------------------------------------------------------
# Operators
# --------------------------------------------------------------------------

def confusion_matrix(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """Dense 5x5 counts per key as long rows (keys, gold_label, pred_label, n).
    Dense by construction: the 25 counters exist for every key, so no join
    with a label grid is needed."""
    wide = confusion_wide(preds, keys)
    cells = [cell(a, b) for a in LETTERS for b in LETTERS]
    long = wide.unpivot(list(keys), cells, "cell", "n")
    return long.select(*keys, F.substring("cell", 3, 1).alias("gold_label"),
                       F.substring("cell", 4, 1).alias("pred_label"), "n")


def run_metrics(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """keys, n, n_correct, accuracy, macro_f1 (fixed five-letter rule, as the
    statistics path), macro_f1_present (rule of the evaluation path)."""
    w = confusion_wide(preds, keys)
    return w.select(*keys, "n", "n_correct", accuracy_col().alias("accuracy"),
                    macro_f1_fixed_col().alias("macro_f1"),
                    macro_f1_present_col().alias("macro_f1_present"))


def accuracy(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("gold_label") == F.col("pred_label")).alias("n_correct"),
    ).select(*keys, "n", "n_correct", accuracy_col().alias("accuracy"))


def macro_f1_fixed(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    return confusion_wide(preds, keys).select(*keys, macro_f1_fixed_col().alias("macro_f1"))


def macro_f1_present(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    return confusion_wide(preds, keys).select(*keys, macro_f1_present_col().alias("macro_f1"))


def classwise_report(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """Per key and letter: precision, recall, F1, support (0 on zero division)."""
    w = confusion_wide(preds, keys)
    per_letter = F.array(*[
        F.struct(F.lit(L).alias("letter"), precision(L).alias("precision"), recall(L).alias("recall"),
                 f1(L).alias("f1"), support(L).alias("support"))
        for L in LETTERS
    ])
    return w.select(*keys, F.inline(per_letter))


def confusion_row_normalised(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """Each cell's share of its gold row; 0 for an empty row (heatmap data)."""
    w = confusion_wide(preds, keys)
    cells = F.array(*[
        F.struct(F.lit(a).alias("gold_label"), F.lit(b).alias("pred_label"),
                 F.col(cell(a, b)).alias("n"), _safe_div(F.col(cell(a, b)), support(a)).alias("share"))
        for a in LETTERS for b in LETTERS
    ])
    return w.select(*keys, F.inline(cells))


def best_run(preds: DataFrame) -> DataFrame:
    """The run with the highest accuracy; ties go to the smallest run name.
    ``min_by`` over (-accuracy, name) is deterministic; ``max_by`` is not."""
    acc = accuracy(preds)
    return acc.agg(
        F.min_by(F.struct("run_name", "accuracy"), F.struct(-F.col("accuracy"), F.col("run_name"))).alias("b")
    ).select("b.run_name", "b.accuracy")


def per_group_metrics(preds: DataFrame, group: str = "specialty",
                      keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """Accuracy, macro F1 (present-label rule) and count per key and group."""
    w = confusion_wide(preds, [*keys, group])
    return w.select(*keys, group, accuracy_col().alias("accuracy"),
                    macro_f1_present_col().alias("macro_f1"), F.col("n").alias("count"))


def accuracy_pivot(preds: DataFrame, column: str, order: Sequence[str] | None = None,
                   keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """Runs x category accuracy. Given categories come first, in the given
    order, then the rest in sorted order; null categories are left out, as in a
    pandas pivot. A run without a category gets null. The category names come to
    the driver: they become column names."""
    acc = preds.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(
        (F.count_if(F.col("gold_label") == F.col("pred_label")) / F.count(F.lit(1))).alias("acc"))
    if order is not None:
        # Only categories that occur become columns, as in a pandas pivot.
        present = {r[0] for r in acc.select(column).distinct().collect()}
        values = [c for c in order if c in present] + sorted(present - set(order))
        return acc.groupBy(*keys).pivot(column, values).agg(F.first("acc"))
    return acc.groupBy(*keys).pivot(column).agg(F.first("acc"))


def f1_pivot(preds: DataFrame, keys: Sequence[str] = ("run_name",)) -> DataFrame:
    """Runs x letter F1 (columns A..E)."""
    w = confusion_wide(preds, keys)
    return w.select(*keys, *[f1(L).alias(L) for L in LETTERS])


# --------------------------------------------------------------------------
# Seeds, perplexity, token lengths
# --------------------------------------------------------------------------

SEED_PATTERN = r"^(.+)_seed(\d+)$"
DEFAULT_SEED = 42


def seed_aggregates(config: DataFrame) -> DataFrame:
    """Mean and sample std of accuracy and macro F1 across seeds.

    ``<base>_seed<N>`` gives (base, N). A suffix-less run counts as seed 42
    only when a seeded sibling with that base exists (and no explicit
    ``_seed42`` run does). Bases with fewer than two seeds are dropped.
    Input: one row per run (run_name, accuracy, macro_f1). One pass: the
    sibling test is a window over the base, then one aggregation on the same
    partitioning.
    """
    n = F.col("run_name")
    seeded = n.rlike(SEED_PATTERN)
    rows = config.select(
        F.when(seeded, F.regexp_extract(n, SEED_PATTERN, 1)).otherwise(n).alias("base"),
        F.when(seeded, F.regexp_extract(n, SEED_PATTERN, 2).cast("long")).otherwise(F.lit(DEFAULT_SEED))
        .alias("seed"),
        seeded.alias("seeded"), "accuracy", "macro_f1")
    w = Window.partitionBy("base")
    rows = rows.withColumn("_has_seeded", F.max(F.col("seeded").cast("int")).over(w) == 1).withColumn(
        "_explicit42", F.max((F.col("seeded") & (F.col("seed") == DEFAULT_SEED)).cast("int")).over(w) == 1)
    keep = F.col("seeded") | (F.col("_has_seeded") & ~F.col("_explicit42"))
    return (rows.where(keep).groupBy("base")
            .agg(F.array_join(F.sort_array(F.collect_list("seed")), ",").alias("seeds"),
                 F.count(F.lit(1)).alias("n_seeds"),
                 F.avg("accuracy").alias("accuracy"), F.stddev_samp("accuracy").alias("acc_std"),
                 F.avg("macro_f1").alias("macro_f1"), F.stddev_samp("macro_f1").alias("f1_std"))
            .where(F.col("n_seeds") >= 2)
            .select(F.lit("seed_agg").alias("kind"), F.col("base").alias("run_name"), "seeds", "n_seeds",
                    "accuracy", "acc_std", "macro_f1", "f1_std"))


def perplexity(losses: DataFrame, keys: Sequence[str] = ("model", "variant"),
               loss: str = "loss", n: str = "n_target") -> DataFrame:
    """exp(sum(loss * n) / sum(n)) over answer tokens; rows with n = 0 carry
    no tokens and are skipped; NaN when a group has no tokens at all."""
    used = F.col(n) > 0
    agg = losses.groupBy(*keys).agg(
        F.sum(F.when(used, F.col(loss) * F.col(n))).alias("nll"),
        F.sum(F.when(used, F.col(n)).otherwise(0)).alias("n_tokens"),
    )
    ppl = F.when(F.col("n_tokens") == 0, F.lit(float("nan"))).otherwise(F.exp(F.col("nll") / F.col("n_tokens")))
    return agg.select(*keys, "n_tokens", ppl.alias("perplexity"))


def perplexity_before_after(losses: DataFrame, base_variant: str, model: str = "model",
                            variant: str = "variant") -> DataFrame:
    """Base-model perplexity beside each adapted variant, for models that have
    a base: the perplexities of a model (a row per variant) meet in a window."""
    ppl = perplexity(losses, (model, variant)).where(F.col(variant).isNotNull())
    is_base = F.col(variant) == base_variant
    own = Window.partitionBy(model)
    beside = ppl.withColumn("_has", F.max(is_base).over(own)).withColumn(
        "ppl_before", F.max(F.when(is_base, F.col("perplexity"))).over(own))
    return beside.where(F.col("_has") & ~is_base).select(
        F.col(model).alias("model"), F.col(variant).alias("stage1_method"),
        "ppl_before", F.col("perplexity").alias("ppl_after"))


def token_length_profile(lengths: DataFrame, limit: int, keys: Sequence[str] = ("corpus",),
                         length: str = "n_tokens", exact: bool = True) -> DataFrame:
    """p50 / p95 / p99 of sequence length and the share above ``limit``.
    ``exact`` uses ``percentile`` (linear interpolation); at 100 TB pass
    ``exact=False`` for the mergeable ``percentile_approx`` sketch."""
    L = F.col(length)
    if exact:
        q = [F.percentile(L, p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    else:
        q = [F.percentile_approx(L, p, 10000).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return lengths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *q,
        F.avg(F.when(L > limit, 1.0).otherwise(0.0)).alias("share_truncated"),
        F.max(L).alias("max_len"))
