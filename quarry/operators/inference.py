"""Inferential statistics over prediction runs.

* Percentile bootstrap of accuracy and macro F1. Both statistics depend only
  on the 5x5 confusion counts, so a resample of n rows is exactly a
  multinomial draw of n over the 25 cells with the observed shares. A
  replicate therefore costs O(25) instead of O(n): the row-level work is the
  one confusion aggregation, and replicates fan out as (run, block) rows
  handled by ``mapInPandas`` (NumPy, seeded by (seed, name, block), so the
  result does not depend on partitioning). Percentiles are Spark's exact
  ``percentile`` (linear interpolation, as NumPy's default).
* Paired bootstrap of Full-vs-LoRA deltas: the same idea over the 125 joint
  cells (gold, pred_a, pred_b), which keeps the pairing.
* ``bootstrap_hash``: a bootstrap with Poisson(1) weights derived from
  md5(question_id ':' replicate) -- identical in any SQL engine. Rows are
  shuffled once, by question; tasks draw the weights of a question and add them
  to the cells of all its runs; then only partial cell sums are shuffled.
* McNemar: discordant counts from the paired rows; exact binomial p from
  a closed-form sum, chi-square tail via ``erfc`` (the one small Python UDF,
  one row per contrast).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType

from quarry.operators import metrics as M
from quarry.session import arrow_batches_by_rows, cut_lineage

LETTERS = M.LETTERS
K = len(LETTERS)
N_BOOT = 10_000
SEED = 42
BLOCK = 1000
#: Accumulators of the hash bootstrap that a task holds before it hands partial sums on.
HELD_BYTES = 256 << 20
TASKS_PER_CORE = 4


def _poisson_thresholds() -> tuple[int, ...]:
    """Floor of the Poisson(1) CDF x 2^32 at k = 0, 1, ... as far as 32 bits tell them apart."""
    with localcontext() as ctx:
        ctx.prec = 40
        out, term, cdf = [], Decimal(-1).exp(), Decimal(0)
        while not out or int((cdf + term) * 2**32) > out[-1]:
            cdf += term
            out.append(int(cdf * 2**32))
            term /= len(out)
    return tuple(out)


POISSON_THRESHOLDS = _poisson_thresholds()
CONTRAST_STAGE1 = ("none", "lora", "full", "full3ep")


# --------------------------------------------------------------------------
# NumPy kernels on count matrices (run inside tasks)
# --------------------------------------------------------------------------

def _acc_f1(cm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cm: (R, 5, 5) counts -> accuracy and fixed-five macro F1 per replicate.
    A letter that neither occurs nor is predicted has F1 0."""
    gold, said = cm.sum(axis=2), cm.sum(axis=1)
    hits = np.einsum("rkk->rk", cm)
    share = hits.sum(axis=1) / gold.sum(axis=1).clip(min=1)
    return share, (hits / ((gold + said) / 2).clip(min=0.5)).mean(axis=1)


def _rng(seed: int, name: str, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(name.encode("utf-8")), block])


def _replicates_single(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for name, block, size, cells in zip(pdf["run_name"], pdf["block"], pdf["size"], pdf["cells"]):
            counts = np.asarray(cells, dtype=np.int64)
            n = int(counts.sum())
            if n == 0:
                acc = f1 = np.zeros(size)
            else:
                draws = _rng(seed, name, int(block)).multinomial(n, counts / n, size=int(size))
                acc, f1 = _acc_f1(draws.reshape(-1, K, K))
            out.append(pd.DataFrame({"run_name": name, "acc": acc, "f1": f1}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _replicates_paired(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for name, block, size, cells in zip(pdf["contrast"], pdf["block"], pdf["size"], pdf["cells"]):
            counts = np.asarray(cells, dtype=np.int64)
            n = int(counts.sum())
            if n == 0:
                d_acc = d_f1 = np.zeros(size)
            else:
                draws = _rng(seed, name, int(block)).multinomial(n, counts / n, size=int(size))
                joint = draws.reshape(-1, K, K, K)  # gold, pred_a, pred_b
                acc_a, f1_a = _acc_f1(joint.sum(axis=3))
                acc_b, f1_b = _acc_f1(joint.sum(axis=2))
                d_acc, d_f1 = acc_a - acc_b, f1_a - f1_b
            out.append(pd.DataFrame({"contrast": name, "d_acc": d_acc, "d_f1": d_f1}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _ci(grouped, metrics: dict[str, str], *extra: Column) -> DataFrame:
    """95% percentile interval per metric: one exact ``percentile`` call per
    metric returning both bounds (the replicate values are buffered once)."""
    aggs = [F.percentile(F.col(src), [0.025, 0.975]).alias(f"_{name}") for name, src in metrics.items()]
    out = grouped.agg(*extra, *aggs)
    cols = [c for c in out.columns if not c.startswith("_")]
    for name in metrics:
        cols += [F.col(f"_{name}")[0].alias(f"{name}_ci_lo"), F.col(f"_{name}")[1].alias(f"{name}_ci_hi")]
    return out.select(*cols)


def _blocks(df: DataFrame, n_boot: int, block: int) -> DataFrame:
    """Fan each row out to ceil(n_boot / block) (block, size) rows."""
    nb = (n_boot + block - 1) // block
    sizes = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(min(block, n_boot - i * block)).alias("size"))
                      for i in range(nb)])
    out = df.select("*", F.inline(sizes))
    # Spread the replicate work over the cluster. A repartition to an explicit
    # number is not coalesced by AQE, so the rows (tiny in bytes, heavy in
    # compute) do not collapse into one task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return out.repartition(parts)


# --------------------------------------------------------------------------
# Bootstrap CI
# --------------------------------------------------------------------------

def bootstrap_ci(preds: DataFrame, n_boot: int = N_BOOT, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Per run: accuracy and macro F1 (fixed rule) with 95% percentile CIs."""
    # 27 counters per run, read by several branches.
    wide = cut_lineage(M.confusion_wide(preds, ["run_name"]))
    counted = sum((F.col(M.cell(a, b)) for a in LETTERS for b in LETTERS), F.lit(0))
    odd = [r["run_name"] for r in wide.where(F.col("n") != counted).select("run_name").limit(5).collect()]
    if odd:
        raise ValueError(f"labels outside {''.join(LETTERS)} or null in runs such as {odd}: "
                         "see cleaning.label_domain_violations")
    point = wide.select("run_name", "n", M.accuracy_col().alias("accuracy"),
                        M.macro_f1_fixed_col().alias("macro_f1"))
    cells = wide.select("run_name", M.cell_array().alias("cells"))
    reps = _blocks(cells, n_boot, block).mapInPandas(
        lambda it: _replicates_single(it, seed), "run_name string, acc double, f1 double")
    ci = _ci(reps.groupBy("run_name"), {"acc": "acc", "f1": "f1"})
    return point.join(ci, "run_name").select(
        F.lit("config").alias("kind"), "run_name", "accuracy", "acc_ci_lo", "acc_ci_hi",
        "macro_f1", "f1_ci_lo", "f1_ci_hi", "n")


def hash_value(key: Column, salt: Column) -> Column:
    """First 32 bits of md5(key ':' salt) as a non-negative integer."""
    m = F.md5(F.concat(key.cast("string"), F.lit(":"), salt.cast("string")))
    return F.conv(F.substring(m, 1, 8), 16, 10).cast("bigint")


#: Shifts and constants of MD5's 64 steps.
_SHIFT = [r[i % 4] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_SINE = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_ROTATE = [(np.uint32(r), np.uint32(32 - r)) for r in _SHIFT]
#: Digests worked out at once.
_LANES = 1 << 16


def _first_word(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First 32 bits of the MD5 of one-block messages; ``words``: their sixteen
    32-bit words, each of a shape that broadcasts to ``shape``."""
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    fixed = [int(w.flat[0]) if w.size == 1 else None for w in words]
    # Steps before the first word that differs in both directions: once per row or column.
    start = 0
    while start < 16 and np.broadcast_shapes(b.shape, words[start].shape) != shape:
        left, right = _ROTATE[start]
        f = (((c ^ d) & b) ^ d) + a + words[start] + np.uint32(_SINE[start])
        a, b, c, d = d, (f << left | f >> right) + b, b, c
        start += 1
    a, b, c, d = (np.array(np.broadcast_to(x, shape), order="C") for x in (a, b, c, d))
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(start, 61):  # the last three steps leave the first word alone
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        if fixed[g] is None:
            np.add(f, words[g], out=f)
        np.add(f, np.uint32((_SINE[i] + (fixed[g] or 0)) % 2**32), out=f)
        left, right = _ROTATE[i]
        np.left_shift(f, left, out=t), np.right_shift(f, right, out=f)
        np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    np.add(b, np.uint32(0x67452301), out=b)
    return b.byteswap(inplace=True)


def first_bits(prefixes: list[bytes], first: int, size: int) -> np.ndarray:
    """First 32 bits of md5(prefix + decimal number) for the numbers first ..
    first + size - 1: one row per prefix."""
    out = np.empty((len(prefixes), size), np.uint32)
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(prefixes):
        by_length.setdefault(len(p), []).append(i)
    numbers = [b"%d" % k for k in range(first, first + size)]
    for length, rows in by_length.items():
        fit = sum(length + len(k) <= 55 for k in numbers)  # the others need more than one block
        if fit < size:
            out[rows, fit:] = [[int.from_bytes(hashlib.md5(prefixes[i] + k).digest()[:4]) for k in numbers[fit:]] for i in rows]
        if not fit:
            continue
        tail = np.frombuffer(b"".join([bytes(length) + k + b"\x80" + bytes(55 - length - len(k)) + (8 * (length + len(k))).to_bytes(8, "little")
                                       for k in numbers[:fit]]), "<u4").reshape(-1, 16)
        tails = [tail[None, :1, j] if (tail[:, j] == tail[0, j]).all() else tail[None, :, j].copy() for j in range(16)]
        step = max(1, _LANES // fit)
        for at in range(0, len(rows), step):
            own = rows[at: at + step]
            head = np.frombuffer(b"".join([prefixes[i] + bytes(64 - length) for i in own]), "<u4").reshape(-1, 16)
            words = [head[:, j: j + 1] | n if 4 * j < length else n for j, n in enumerate(tails)]
            out[own, :fit] = _first_word(words, (len(own), fit))
    return out


#: Weight by the upper 16 bits of a hash, and whether a threshold lies inside these (then marked in the first).
_BY_UPPER = np.searchsorted(POISSON_THRESHOLDS, np.arange(1 << 16, dtype=np.int64) << 16, side="right").astype(np.uint16)
_SPLIT_UPPER = np.zeros(1 << 16, bool)
_SPLIT_UPPER[[t >> 16 for t in POISSON_THRESHOLDS if t < 2**32]] = True
_SPLIT = np.uint16(2**16 - 1)
_BY_UPPER[_SPLIT_UPPER] = _SPLIT


def replicate_weights(questions: Sequence[str | int], first: int, size: int) -> np.ndarray:
    """Poisson(1) weights of questions in replicates first .. first + size - 1:
    the thresholds not above the first 32 bits of md5(question ':' replicate)."""
    h = first_bits([f"{q}:".encode() for q in questions], first, size).ravel()
    out = np.empty(len(h), np.uint16)
    for at in range(0, len(h), _LANES):
        part, w = h[at: at + _LANES], out[at: at + _LANES]
        # The indices have 16 bits: no mode changes them, "wrap" writes without a buffer.
        np.take(_BY_UPPER, part >> np.uint32(16), out=w, mode="wrap")
        odd = np.flatnonzero(w == _SPLIT)
        w[odd] = np.searchsorted(POISSON_THRESHOLDS, part[odd].astype(np.int64), side="right")
    return out.reshape(-1, size)


CELLS = [M.cell(a, b) for a in LETTERS for b in LETTERS]
#: Rows whose 16-bit weights are summed at once: no sum overflows.
_ADDENDS = (2**16 - 1) // len(POISSON_THRESHOLDS)
#: Weights that a task holds at once.
_WEIGHTS = 1 << 20


def _ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in ascending order, null last, and each row's place among them."""
    found = values.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return found.dictionary.take(order), place[found.indices.to_numpy()]


def _by_question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, equal ones counted, as one row per question. Lists in
    one order and cells of one byte each: shuffled rows compress well."""
    for b in batches:
        (questions, question), (runs, run) = _ranked(b.column("question")), _ranked(b.column("run_name"))
        # One number per (question, run, cell): sorting integers is far cheaper than sorting texts.
        rows, n = np.unique((question * len(runs) + run) * K * K + b.column("cell").to_numpy(), return_counts=True)
        rows, cell = np.divmod(rows, K * K)
        question, run = np.divmod(rows, max(1, len(runs)))
        edges = pa.array(np.searchsorted(question, np.arange(len(questions) + 1)), pa.int32())
        cells = pa.Array.from_buffers(pa.binary(), len(questions), [None, edges.buffers()[1], pa.py_buffer(cell.astype(np.uint8))])
        yield pa.RecordBatch.from_arrays(
            [questions, pa.ListArray.from_arrays(edges, runs.take(pa.array(run))), cells, pa.ListArray.from_arrays(edges, pa.array(n, pa.int64()))],
            names=["question", "runs", "cells", "n"])


def _weighted_cells(batches: Iterator[pa.RecordBatch], n_boot: int, block: int) -> Iterator[pa.RecordBatch]:
    """Partial sums per (run, replicate) of rows grouped by question."""
    held: dict[str | None, np.ndarray] = {}
    limit = max(1, HELD_BYTES // (8 * n_boot * K * K))
    per = max(1, _WEIGHTS // min(block, n_boot))  # questions at once

    def flush() -> Iterator[pa.RecordBatch]:
        for run, sums in held.items():
            for lo in range(0, n_boot, block):
                part = sums[:, lo: lo + block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * part.shape[1], pa.string()), pa.array(np.arange(lo, lo + part.shape[1])), *map(pa.array, part)],
                    names=["run_name", "rep", *CELLS])
        held.clear()

    for b in batches:
        keys = b.column(0).dictionary_encode()
        questions = keys.dictionary.to_pylist()
        of = np.repeat(keys.indices.to_numpy(), b.column(1).value_lengths().to_numpy())
        runs = b.column(1).flatten().dictionary_encode(null_encoding="encode")
        names, n = runs.dictionary.to_pylist(), b.column(3).flatten().to_numpy()
        slot = runs.indices.to_numpy().astype(np.int64) * K * K + np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8)
        order = np.argsort(of // per * (len(names) * K * K) + slot, kind="stable")
        of, slot, n = of[order], slot[order], n[order]
        for run in names:
            if run not in held:
                held[run] = np.zeros((K * K, n_boot), np.int64)
        parts = np.searchsorted(of // per, np.arange(-(-len(questions) // per) + 1))
        for g, (lo, hi) in enumerate(zip(parts[:-1], parts[1:], strict=True)):
            edges = [lo, *(lo + 1 + np.flatnonzero(np.diff(slot[lo:hi]))), hi]
            for first in range(0, n_boot, block):
                size = min(block, n_boot - first)
                weights = replicate_weights(questions[g * per: (g + 1) * per], first, size)
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    run, cell = divmod(int(slot[x]), K * K)
                    sums = held[names[run]][cell, first: first + size]
                    for at in range(x, y, _ADDENDS):
                        own = slice(at, min(y, at + _ADDENDS))
                        drawn, times = weights.take(of[own] - g * per, axis=0), n[own]
                        sums += drawn.sum(axis=0, dtype=np.uint16)
                        if (times > 1).any():
                            more = times > 1
                            sums += (times[more] - 1) @ drawn[more].astype(np.int64)
        if len(held) > limit:
            yield from flush()
    yield from flush()


def bootstrap_hash_replicates(preds: DataFrame, n_boot: int = N_BOOT, block: int = BLOCK) -> DataFrame:
    """Weighted confusion counts per (run, replicate). A weight depends on
    (question, replicate) only, so runs are paired by construction; rows without
    a question have none. Rows are shuffled once, by question and not per
    replicate: equal rows of a batch are counted before, so a question holding a
    third of all rows is a few rows there. A task works out the weights of its
    questions block by block of replicates and holds the sums of its runs."""
    g, p = F.col("gold_label"), F.col("pred_label")
    letters = F.array(*map(F.lit, LETTERS))
    bad = F.raise_error(F.concat(F.lit("labels outside "), F.lit("".join(LETTERS)), F.lit(" or null in run "),
                                 F.coalesce("run_name", F.lit("null"))))
    known = F.coalesce(g.isin(*LETTERS) & p.isin(*LETTERS), F.lit(False))
    cell = F.when(known, (F.array_position(letters, g) - 1) * K + F.array_position(letters, p) - 1).otherwise(bad.cast("long"))
    # Whole numbers are written out by the task that hashes them, once per question.
    kind = "long" if isinstance(preds.select("question_id").schema[0].dataType, IntegralType) else "string"
    rows = preds.where(F.col("question_id").isNotNull()).select(
        F.col("question_id").cast(kind).alias("question"), "run_name", cell.cast("int").alias("cell"))
    counted = rows.mapInArrow(_by_question, f"question {kind}, runs array<string>, cells binary, n array<long>")
    spark = preds.sparkSession
    # Every task hands on the sums of all replicates and runs: a few tasks per core, however many partitions are set.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    dealt = counted.repartition(parts, "question").sortWithinPartitions("question")
    partial = dealt.mapInArrow(lambda it: _weighted_cells(it, n_boot, block),
                               "run_name string, rep long, " + ", ".join(f"{c} long" for c in CELLS))
    sums = partial.groupBy("run_name", "rep").agg(*[F.sum(c).alias(c) for c in CELLS])
    total = sum((F.col(c) for c in CELLS[1:]), F.col(CELLS[0]))
    correct = sum((F.col(M.cell(a, a)) for a in LETTERS[1:]), F.col(M.cell(LETTERS[0], LETTERS[0])))
    return sums.select("run_name", "rep", total.alias("n"), correct.alias("n_correct"), *CELLS).where("n > 0")


def bootstrap_hash(preds: DataFrame, n_boot: int = N_BOOT) -> DataFrame:
    """Per run: percentile CIs of accuracy and macro F1 over hash-weighted
    replicates (exactly reproducible in SQL)."""
    reps = bootstrap_hash_replicates(preds, n_boot).select(
        "run_name", "rep", M.accuracy_col().alias("acc"), M.macro_f1_fixed_col().alias("f1"))
    # Worked out here, one row per run and replicate: the setting holds for this action only.
    with arrow_batches_by_rows(preds.sparkSession):
        reps = cut_lineage(reps)
    return _ci(reps.groupBy("run_name"), {"acc": "acc", "f1": "f1"}, F.count(F.lit(1)).alias("n_boot"))


# --------------------------------------------------------------------------
# Contrasts, pairing, McNemar
# --------------------------------------------------------------------------

def find_contrasts(runs: DataFrame, models: DataFrame) -> DataFrame:
    """(model, stage1, run_full, run_lora) for every (model, stage 1 method)
    having both a suffix-free ``_s2-full`` and ``_s2-lora`` run. One pass
    over the distinct run names, paired by a conditional aggregation."""
    pat = r"^(.+)_s1-(none|lora|full|full3ep)_s2-(full|lora)$"
    n = F.col("run_name")
    r = runs.select("run_name").distinct().where(n.rlike(pat)).select(
        "run_name", F.regexp_extract(n, pat, 1).alias("model"), F.regexp_extract(n, pat, 2).alias("stage1"),
        F.regexp_extract(n, pat, 3).alias("s2"))
    r = r.join(F.broadcast(models.select(F.col("short_name").alias("model"))), "model", "left_semi")
    # count_if keeps this aggregation duplicate-sensitive, so the distinct
    # above stays in the plan and the regexes run on distinct names only.
    pairs = r.groupBy("model", "stage1").agg(
        F.max(F.when(F.col("s2") == "full", n)).alias("run_full"),
        F.max(F.when(F.col("s2") == "lora", n)).alias("run_lora"),
        F.count_if(F.col("s2") == "full").alias("_nf"), F.count_if(F.col("s2") == "lora").alias("_nl"))
    return pairs.where((F.col("_nf") > 0) & (F.col("_nl") > 0)).select(
        "model", "stage1", F.concat_ws(" vs ", "run_full", "run_lora").alias("contrast"), "run_full", "run_lora")


def contrast_order(df: DataFrame) -> DataFrame:
    """Report order: longer model names first, then name, then stage 1 order."""
    pos = F.array_position(F.array(*[F.lit(s) for s in CONTRAST_STAGE1]), F.col("stage1"))
    return df.orderBy(F.length("model").desc(), "model", pos)


def paired_predictions(preds: DataFrame, contrasts: DataFrame) -> DataFrame:
    """Inner equi-join of the two sides of every contrast on question_id (one
    job for all contrasts). The side table has two rows per contrast; AQE
    broadcasts it when its measured size is small and shuffles otherwise.
    Duplicated ids multiply, as an inner join does."""
    sides = contrasts.select("contrast", F.inline(F.array(
        F.struct(F.lit("a").alias("side"), F.col("run_full").alias("run_name")),
        F.struct(F.lit("b").alias("side"), F.col("run_lora").alias("run_name")))))
    p = preds.select("run_name", "question_id", "gold_label", "pred_label").join(sides, "run_name")
    a = p.where(F.col("side") == "a").select("contrast", "question_id", F.col("gold_label").alias("gold_a"),
                                             F.col("pred_label").alias("pred_a"))
    b = p.where(F.col("side") == "b").select("contrast", "question_id", F.col("gold_label").alias("gold_b"),
                                             F.col("pred_label").alias("pred_b"))
    return a.join(b, ["contrast", "question_id"])


def align_pair(preds: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """One pair: (a rows, b rows, aligned, gold disagreements). Rows lost =
    input minus aligned; a non-zero disagreement count is the error case."""
    pa = preds.where(F.col("run_name") == run_a).select("question_id", F.col("gold_label").alias("gold_a"),
                                                        F.col("pred_label").alias("pred_a"))
    pb = preds.where(F.col("run_name") == run_b).select("question_id", F.col("gold_label").alias("gold_b"),
                                                        F.col("pred_label").alias("pred_b"))
    j = pa.join(pb, "question_id")
    stats = j.agg(F.count(F.lit(1)).alias("aligned"),
                  F.count_if(~F.col("gold_a").eqNullSafe(F.col("gold_b"))).alias("gold_disagreements"))
    return stats.select(F.lit(run_a).alias("run_a"), F.lit(run_b).alias("run_b"),
                        pa.select(F.count(F.lit(1))).scalar().alias("rows_a"),
                        pb.select(F.count(F.lit(1))).scalar().alias("rows_b"), "aligned", "gold_disagreements")


def binom_two_sided_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p at 0.5: min(1, 2 * P(X <= min(b, c)))."""
    n, m = b + c, F.least(b, c)
    # running term C(n, i) and running sum, i = 1..m (integers exact in doubles)
    acc = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), m.cast("bigint")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda st, i: F.struct((st["t"] * (n - i + 1) / i).alias("t"), (st["s"] + st["t"] * (n - i + 1) / i).alias("s")),
    )["s"]
    total = F.when(m == 0, F.lit(1.0)).otherwise(acc)
    return F.least(F.lit(1.0), 2.0 * total / F.pow(F.lit(2.0), n))


@F.pandas_udf(DoubleType())
def chi2_sf_1df(x: pd.Series) -> pd.Series:
    """Survival function of chi-square with 1 df: erfc(sqrt(x / 2))."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)) if v is not None and v == v else float("nan"))


def mcnemar_columns(b: Column, c: Column, with_chi2_p: bool = True) -> list[Column]:
    """b+c = 0: stat 0, p 1, exact. b+c < 25: stat min(b,c), exact binomial p.
    Else continuity-corrected chi-square (|b-c|-1)^2/(b+c) (no clamp at b=c)."""
    n = b + c
    kind = F.when(n < 25, "exact").otherwise("chi2_cc")
    chi = F.when(n > 0, F.pow(F.abs(b - c) - 1, 2) / n)
    stat = F.when(n == 0, F.lit(0.0)).when(n < 25, F.least(b, c).cast("double")).otherwise(chi)
    p_exact = F.when(n == 0, F.lit(1.0)).when(n < 25, binom_two_sided_p(b, c))
    cols = [b.alias("mcnemar_b"), c.alias("mcnemar_c"), stat.alias("mcnemar_stat"), kind.alias("mcnemar_kind")]
    if with_chi2_p:
        cols.append(F.coalesce(p_exact, chi2_sf_1df(chi)).alias("mcnemar_p"))
    else:
        cols.append(p_exact.alias("mcnemar_p_exact"))
    return cols


def joint_counts(paired: DataFrame) -> DataFrame:
    """(contrast, gold, pred_a, pred_b, n): the paired rows aggregated once;
    every paired statistic below is computed from these <= 125 rows per
    contrast. Gold labels that disagree and labels that are null or no letter
    are an error of the job: no statistic is computed from them."""
    what = F.when(~F.col("gold_a").eqNullSafe(F.col("gold_b")), F.lit("gold labels disagree"))
    for c in ("gold_a", "pred_a", "pred_b"):
        what = what.when(~F.coalesce(F.col(c).isin(*LETTERS), F.lit(False)), F.lit("a label is outside the letters"))
    # Tested per group, where the labels of a group are all alike.
    cells = paired.groupBy("contrast", "gold_a", "gold_b", "pred_a", "pred_b").agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(F.col("contrast").cast("string"), F.lit(": "), what, F.lit(" ("),
                       F.concat_ws(", ", *[F.coalesce(F.col(c), F.lit("null")) for c in ("gold_a", "gold_b", "pred_a", "pred_b")]),
                       F.lit(")"))
    n = F.when(what.isNotNull(), F.raise_error(message).cast("long")).otherwise(F.col("n"))
    return cells.select("contrast", F.col("gold_a").alias("gold"), "pred_a", "pred_b", n.alias("n"))


def mcnemar_from_joint(joint: DataFrame, with_chi2_p: bool = True) -> DataFrame:
    ca = F.col("pred_a") == F.col("gold")
    cb = F.col("pred_b") == F.col("gold")
    counts = joint.groupBy("contrast").agg(
        F.sum("n").alias("n"), F.sum(F.when(ca & ~cb, F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when(~ca & cb, F.col("n")).otherwise(0)).alias("c"))
    return counts.select("contrast", "n", *mcnemar_columns(F.col("b"), F.col("c"), with_chi2_p))


def mcnemar(paired: DataFrame, with_chi2_p: bool = True) -> DataFrame:
    """Per contrast: n, discordant counts and the McNemar test."""
    return mcnemar_from_joint(joint_counts(paired), with_chi2_p)


# --------------------------------------------------------------------------
# Paired bootstrap and the contrast report
# --------------------------------------------------------------------------

def joint_cells(joint: DataFrame) -> DataFrame:
    """Per contrast: dense 125-cell counts, index = gold*25 + pred_a*5 + pred_b."""
    letters = F.array(*[F.lit(L) for L in LETTERS])

    def idx(c):
        return F.array_position(letters, F.col(c)) - 1

    code = idx("gold") * 25 + idx("pred_a") * 5 + idx("pred_b")
    m = joint.groupBy("contrast").agg(F.map_from_entries(F.collect_list(F.struct(code, F.col("n")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(K ** 3 - 1).cast("bigint")),
                        lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint")))
    return m.select("contrast", dense.alias("cells"))


def paired_bootstrap_delta(paired: DataFrame, n_boot: int = N_BOOT, seed: int = SEED,
                           block: int = BLOCK, joint: DataFrame | None = None) -> DataFrame:
    """Deltas (A minus B) of macro F1 and accuracy with 95% CIs and the
    two-sided bootstrap sign p of the F1 delta (add-one smoothing)."""
    cells = joint_cells(joint if joint is not None else joint_counts(paired))
    reps = _blocks(cells, n_boot, block).mapInPandas(
        lambda it: _replicates_paired(it, seed), "contrast string, d_acc double, d_f1 double")
    nb = F.count(F.lit(1))
    lo = (F.count_if(F.col("d_f1") <= 0) + 1) / (nb + 1)
    hi = (F.count_if(F.col("d_f1") >= 0) + 1) / (nb + 1)
    return _ci(reps.groupBy("contrast"), {"f1_delta": "d_f1", "acc_delta": "d_acc"},
               F.least(F.lit(1.0), 2 * F.least(lo, hi)).alias("f1_delta_p"))


def contrast_report(preds: DataFrame, models: DataFrame, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """One row per Full-vs-LoRA contrast: McNemar + paired bootstrap deltas.
    The paired rows are aggregated once into joint cells; one aggregation of
    that small table gives the discordant counts and both sides' confusion
    cells, and the bootstrap reads the same table."""
    contrasts = find_contrasts(preds, models)
    # The joint table (<= 125 rows per contrast) feeds several branches: it is
    # computed once and checkpointed into the shared checkpoint folder, so the
    # branches neither rescan the predictions nor depend on executor memory.
    try:
        joint = cut_lineage(joint_counts(paired_predictions(preds, contrasts)))
    except PySparkException as e:  # the error that joint_counts raises on bad labels, as in bootstrap_ci
        if "USER_RAISED_EXCEPTION" not in str(e):
            raise
        raise ValueError(str(e)) from e
    ca = F.col("pred_a") == F.col("gold")
    cb = F.col("pred_b") == F.col("gold")
    stats = joint.groupBy("contrast").agg(
        F.sum("n").alias("n"), F.sum(F.when(ca & ~cb, F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when(~ca & cb, F.col("n")).otherwise(0)).alias("c"),
        *M.cell_aggs("gold", "pred_a", "n", prefix="a_", totals=False),
        *M.cell_aggs("gold", "pred_b", "n", prefix="b_", totals=False))
    point = stats.select(
        "contrast", "n", *mcnemar_columns(F.col("b"), F.col("c")),
        (M.macro_f1_fixed_col("a_") - M.macro_f1_fixed_col("b_")).alias("f1_delta"),
        M._safe_div(M.trace("a_") - M.trace("b_"), F.col("n")).alias("acc_delta"))
    boot = paired_bootstrap_delta(None, n_boot, seed, joint=joint)
    j = contrasts.join(point, "contrast").join(boot, "contrast")
    return j.select(
        F.lit("contrast").alias("kind"), "model", "stage1", F.col("contrast").alias("run_name"),
        "run_full", "run_lora", "n", "mcnemar_b", "mcnemar_c", "mcnemar_stat", "mcnemar_p", "mcnemar_kind",
        "f1_delta", "f1_delta_ci_lo", "f1_delta_ci_hi", "f1_delta_p",
        "acc_delta", "acc_delta_ci_lo", "acc_delta_ci_hi")


def statistics_table(config: DataFrame, contrasts: DataFrame, seeds: DataFrame) -> DataFrame:
    """The three row kinds in one table; missing columns are null."""
    return config.unionByName(contrasts, allowMissingColumns=True).unionByName(seeds, allowMissingColumns=True)


__all__: Sequence[str] = [
    "bootstrap_ci", "bootstrap_hash", "find_contrasts", "paired_predictions", "align_pair", "mcnemar",
    "paired_bootstrap_delta", "contrast_report", "statistics_table",
]
