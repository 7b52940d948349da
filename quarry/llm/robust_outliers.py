"""Quality rules: base rules and robust multivariate outliers.

Each text gets counts (``text_stats``) and a vector of transformed statistics.
Per language and source, a minimum-covariance-determinant estimate describes the
bulk of the vectors; a text is rejected when its squared Mahalanobis distance
exceeds ``cutoff``.

The estimate runs over all rows as aggregations on a narrow table: two
deterministic starts (median with scaled deviations; covariance of clipped
scores), then C-steps: the ``coverage`` share of rows nearest to the current
estimate gives the next mean and covariance, with sums collapsed map-side, so a
source that holds a third of all rows ships one partial row per task. The start
with the smaller determinant wins, and one reweighted step follows. A floor on
each variance keeps a statistic that is constant in the bulk from rejecting
every text that differs a little.

Groups with fewer than ``min_rows`` texts share the estimate of their language's
small groups, and what is still too small a common one; below ``min_rows`` rows
there, nothing is rejected by distance.

Defined cases: a null text counts as empty and fails the base rules; null
language and source are groups of their own; repeated rows get equal verdicts;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise
from quarry.llm.text_stats import text_stats

COVERAGE = 0.75
C_STEPS = 3
MIN_ROWS = 60
#: Least standard deviation of each transformed statistic.
FLOORS = (0.1, 0.3, 0.35, 0.35, 0.35, 0.25)
#: Groups whose estimates are broadcast; more groups join by shuffle.
BROADCAST_GROUPS = 20_000
#: Chi-square tail of a text that is rejected.
TAIL = 1e-9
_ACCURACY = 2000


def vector() -> list[Column]:
    """Transformed statistics: word length, and shares of symbols, repeated
    words, upper case letters, marks and distinct words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def share(x: Column, of: Column) -> Column:
        return F.log1p(100 * x / of)

    return [F.log1p(F.col("word_chars") / words), share(F.col("n_symbols"), chars), share(F.col("n_repeat_words"), words),
            share(F.col("n_upper"), chars), share(F.col("n_marks"), chars),
            F.log1p(10 * F.col("n_adjacent") / words)]


def chi2_cdf(x: float, d: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    a, z = d / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-17 * abs(total):
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 10.0
    while chi2_cdf(hi, d) < p and hi < 400:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return (lo + hi) / 2


def _with_group(stats: DataFrame, min_rows: int) -> DataFrame:
    """``g``: the group whose estimate a row uses."""
    def named(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))

    keyed = stats.withColumn("_l", named("lang")).withColumn("_s", named("source"))
    own = keyed.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n"))
    rest = own.where(F.col("n") < min_rows).groupBy("_l").agg(F.sum("n").alias("rest"))
    named_group = F.when(F.col("n") >= min_rows, F.concat_ws("\x1f", F.lit("source"), "_l", "_s")) \
        .when(F.col("rest") >= min_rows, F.concat_ws("\x1f", F.lit("lang"), "_l")).otherwise(F.lit("all"))
    groups = own.join(rest, "_l", "left").select("_l", "_s", named_group.alias("g"))
    return keyed.join(_small(groups), ["_l", "_s"]).drop("_l", "_s")


def _small(groups: DataFrame) -> DataFrame:
    """Broadcast a table with a row per group if its size is proven bounded."""
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def _distance(d: int, mean: str, prec: str) -> Column:
    """Squared Mahalanobis distance of x0 .. x(d-1)."""
    diff = [F.col(f"x{i}") - F.col(mean)[i] for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + diff[i] * diff[j] * F.col(prec)[i * d + j] * (1 if i == j else 2)
    return total


def _moments(d: int, weight: Column) -> list[Column]:
    """Weighted sums of 1, x and x x', in one aggregation."""
    w = F.when(weight, F.lit(1.0)).otherwise(F.lit(0.0))
    out = [F.sum(w).alias("m")] + [F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(d)]
    return out + [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]


def _estimate(sums: DataFrame, d: int, floors: tuple[float, ...], keys: str, scale: float = 1.0) -> DataFrame:
    """Mean, precision and log determinant per row of sums; ``scale`` makes a
    truncated covariance consistent."""
    floor = np.diag(np.square(floors))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[[k.split()[0] for k in keys.split(", ")]].copy()
            mean, prec, det = [], [], []
            for r in f.to_dict("records"):
                m = max(r["m"], 1.0)
                mu = np.array([r[f"s{i}"] for i in range(d)]) / m
                cov = np.zeros((d, d))
                for i in range(d):
                    for j in range(i, d):
                        cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / m - mu[i] * mu[j]
                cov = cov * scale + floor
                values, vectors = np.linalg.eigh(cov)
                values = np.maximum(values, floor.min())
                mean.append(mu.tolist())
                prec.append(((vectors / values) @ vectors.T).ravel().tolist())
                det.append(float(np.log(values).sum()))
            out["mean"], out["prec"], out["logdet"] = mean, prec, det
            yield out

    return materialise(sums.mapInPandas(run, f"{keys}, mean array<double>, prec array<double>, logdet double"))


def mcd(rows: DataFrame, d: int, floors: tuple[float, ...] = FLOORS, coverage: float = COVERAGE,
        steps: int = C_STEPS) -> DataFrame:
    """Reweighted estimates per ``g`` of ``rows`` (g, x0 .. x(d-1)): g, mean,
    prec (d x d, row by row), logdet."""
    xs = [f"x{i}" for i in range(d)]
    centre = rows.groupBy("g").agg(F.array(*[F.percentile_approx(x, 0.5, _ACCURACY) for x in xs]).alias("med"))
    apart = rows.join(_small(centre), "g")
    mad = apart.groupBy("g", "med").agg(F.array(*[F.percentile_approx(
        F.abs(F.col(x) - F.col("med")[i]), 0.5, _ACCURACY) * 1.4826 for i, x in enumerate(xs)]).alias("mad"))
    scale = materialise(mad)

    def z(i: int) -> Column:
        return (F.col(f"x{i}") - F.col("med")[i]) / F.sqrt(F.col("mad")[i] ** 2 + F.lit(floors[i] ** 2))

    # Start 0: the rows nearest to the median in scaled deviations. Start 1: moments of clipped scores.
    scored = rows.join(_small(scale), "g")
    plain = F.lit(0.0)
    for i in range(d):
        plain = plain + z(i) * z(i)
    near = materialise(scored.select("g", plain.alias("d2")).groupBy("g").agg(
        F.percentile_approx("d2", coverage, _ACCURACY).alias("cut")))
    start0 = scored.join(_small(near), "g").groupBy("g").agg(*_moments(d, plain <= F.col("cut"))).withColumn("start", F.lit(0))
    clipped = scored.select("g", *[(F.col("med")[i] + F.sqrt(F.col("mad")[i] ** 2 + F.lit(floors[i] ** 2)) * F.greatest(
        F.lit(-1.5), F.least(F.lit(1.5), z(i)))).alias(f"x{i}") for i in range(d)])
    start1 = clipped.groupBy("g").agg(*_moments(d, F.lit(True))).withColumn("start", F.lit(1))
    now = _estimate(start0.unionByName(start1), d, floors, "g string, start int")

    q = chi2_quantile(coverage, d)
    consistent = coverage / chi2_cdf(q, d + 2)
    for _ in range(steps):
        both = now.groupBy("g").agg(*[F.max(F.when(F.col("start") == s, F.col(c))).alias(f"{c}{s}")
                                      for s in (0, 1) for c in ("mean", "prec")])
        far = rows.join(_small(both), "g").select("g", *xs, *[_distance(d, f"mean{s}", f"prec{s}").alias(f"d{s}") for s in (0, 1)])
        cuts = materialise(far.groupBy("g").agg(*[F.percentile_approx(f"d{s}", coverage, _ACCURACY).alias(f"c{s}") for s in (0, 1)]))
        judged = far.join(_small(cuts), "g")
        sums = None
        for s in (0, 1):
            one = judged.groupBy("g").agg(*_moments(d, F.col(f"d{s}") <= F.col(f"c{s}"))).withColumn("start", F.lit(s))
            sums = one if sums is None else sums.unionByName(one)
        now = _estimate(sums, d, floors, "g string, start int", consistent)
    best = now.groupBy("g").agg(F.min(F.struct("logdet", "start", "mean", "prec")).alias("b")).select(
        "g", F.col("b.mean").alias("mean0"), F.col("b.prec").alias("prec0"))
    limit = chi2_quantile(0.975, d)
    inside = rows.join(_small(best), "g").withColumn("d0", _distance(d, "mean0", "prec0"))
    sums = inside.groupBy("g").agg(*_moments(d, F.col("d0") <= limit))
    return _estimate(sums, d, floors, "g string", 0.975 / chi2_cdf(limit, d + 2))


def judge(docs: DataFrame, cutoff: float | None = None, min_rows: int = MIN_ROWS, floors: tuple[float, ...] = FLOORS,
          coverage: float = COVERAGE, steps: int = C_STEPS) -> DataFrame:
    """Per document: doc_id, lang, source, the counts, base_failed, distance
    (null without an estimate) and kept."""
    xs = vector()
    d = len(xs)
    limit = chi2_quantile(1 - TAIL, d) if cutoff is None else cutoff
    counted = text_stats(docs.select("doc_id", "lang", "source", "text"), keep=("doc_id", "lang", "source"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialise(counted.select("*", failed.alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]))
    rows = materialise(_with_group(stats, min_rows))
    # The base rules have judged the rows that fail them; they do not shape the estimates.
    fit = rows.where(~F.col("base_failed"))
    enough = fit.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows // 2).select("g")
    fitted = mcd(fit.join(_small(enough), "g", "left_semi").select("g", *[f"x{i}" for i in range(d)]), d, floors, coverage, steps)
    out = rows.join(_small(fitted), "g", "left").withColumn("distance", _distance(d, "mean", "prec"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    return out.withColumn("kept", kept).drop("g", "mean", "prec", "logdet", *[f"x{i}" for i in range(d)])


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "distance")
