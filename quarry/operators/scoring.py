"""Batch scoring and prediction assembly.

``score_choices`` runs a caller-supplied scorer over Arrow batches with
``mapInArrow``: the factory builds one scorer per task (a model would be
loaded once per executor slot), rows are scored in fixed-size batches, and
the five answer-letter logits come back as columns. The built-in
``LinearScorer`` scores a numeric feature array with a fixed weight matrix so
the whole path runs (and is checkable in SQL) without model weights.
Everything after the logits -- argmax, correctness, metrics, the per-group
result map -- is JVM-side column work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as T
from quarry.operators import metrics as M
from quarry.session import cut_lineage

LETTERS = M.LETTERS
BATCH_SIZE = 16
#: Rows that a scoring task hands on at once, rounded to whole batches.
STEP_ROWS = 512
PROMPT_TOKENS = 2048


class LinearScorer:
    """logit_j = sum_i W[j, i] * x_i with W[j, i] = ((3 i + 7 j) mod 11 - 5) / 10
    for i < dim (a fixed, data-independent matrix)."""

    def __init__(self, dim: int):
        i = np.arange(dim)[None, :]
        j = np.arange(len(LETTERS))[:, None]
        self.w = (((3 * i + 7 * j) % 11) - 5) / 10.0

    def __call__(self, features: np.ndarray) -> np.ndarray:
        """features: (batch, dim) -> logits (batch, 5)."""
        return features @ self.w.T


class OptionLengthScorer:
    """A deterministic text scorer for prompts: the logit of a letter is the
    length of that option's text in the prompt's options block (0 when the
    option line is absent). It stands in for a language model so the prompt
    path runs end to end and can be checked in SQL."""

    _line = re.compile(r"^([A-E])\) (.*)$")

    def __call__(self, prompts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(prompts), len(LETTERS)))
        for i, p in enumerate(prompts):
            block = p.rsplit("### Options:\n", 1)[-1].split("\n\n### Answer:", 1)[0]
            for line in block.split("\n"):
                m = self._line.match(line)
                if m:
                    out[i, LETTERS.index(m.group(1))] = len(m.group(2))
        return out


def score_choices(df: DataFrame, scorer_factory: Callable[[], Callable],
                  features: str, keep: Sequence[str], batch_size: int = BATCH_SIZE) -> DataFrame:
    """Append logit_A..logit_E from ``scorer(batch)``, ``batch_size`` rows at
    a time within each Arrow batch (one scorer per task, built by the
    factory). A string column is passed as a list of prompts, a numeric
    array column as a (batch, dim) float matrix. Kept columns stay in Arrow, and
    Python objects are made for one such batch at a time."""
    src = df.select(*keep, features)
    fields = src.schema.fields[:-1]
    is_text = isinstance(src.schema[features].dataType, StringType)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + [f"logit_{L} double" for L in LETTERS])

    step = max(1, STEP_ROWS // batch_size) * batch_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_factory()
        for b in batches:
            for lo in range(0, b.num_rows, step):
                own = b.slice(lo, step)
                out = np.empty((own.num_rows, len(LETTERS)))
                for s in range(0, own.num_rows, batch_size):
                    part = own.column(len(fields)).slice(s, batch_size)
                    if is_text:
                        x = part.to_pylist()
                    else:
                        x = np.stack([np.asarray(v, dtype=np.float64) for v in part.to_numpy(zero_copy_only=False)])
                    out[s:s + batch_size] = scorer(x)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *[pa.array(out[:, j]) for j in range(len(LETTERS))]],
                                                 names=[*[f.name for f in fields], *[f"logit_{L}" for L in LETTERS]])

    return src.mapInArrow(run, schema)


class TokenSumScorer:
    """A deterministic scorer of token ids: the logit of letter j is the sum over
    the tokens of (id * (2 j + 3)) mod 97. Padding has no part in it, as in a
    model that is given an attention mask."""

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.stack([((ids * (2 * j + 3)) % 97 * mask).sum(axis=1) for j in range(len(LETTERS))], axis=1).astype(float)


def score_prompts(df: DataFrame, scorer_factory: Callable[[], Callable], tokenizer_factory: Callable[[], object],
                  prompt: str, keep: Sequence[str], batch_size: int = BATCH_SIZE, max_len: int = PROMPT_TOKENS,
                  pad_id: int = 0, by_length: bool = True) -> DataFrame:
    """Append logit_A..logit_E from ``scorer(ids, attention_mask)`` over batches of
    prompts that are cut to ``max_len`` tokens and padded on the left to the
    longest of their batch. The rows of each Arrow batch are grouped by length
    first, so that prompts of like length share a batch, and come back in their
    order; such a batch also ends before a prompt over twice as long as its first,
    so less than half of it is padding. ``by_length=False`` batches rows as they stand. Also appended:
    n_tokens, and padded_to, the width of the row's batch. A null prompt counts
    as an empty text. One tokenizer (``encode``) and one scorer per task; memory
    is bounded by an Arrow batch of cut id lists and one padded batch."""
    src = df.select(*keep, prompt)
    fields = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + [f"logit_{L} double" for L in LETTERS] + ["n_tokens int", "padded_to int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, tokenizer = scorer_factory(), tokenizer_factory()
        for pdf in batches:
            ids = [tokenizer.encode("" if t is None else t)[:max_len] for t in pdf[prompt]]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            order = np.argsort(length, kind="stable") if by_length else np.arange(len(ids))
            logits, width = np.empty((len(ids), len(LETTERS))), np.zeros(len(ids), np.int32)
            end = 0
            while end < len(ids):
                rows = order[end:end + batch_size]
                if by_length:
                    rows = rows[length[rows] <= 2 * max(length[rows[0]], 1)]
                end += len(rows)
                w = int(length[rows].max())
                block = np.full((len(rows), w), pad_id, np.int64)
                mask = np.zeros((len(rows), w), np.int64)
                for at, row in enumerate(rows):
                    block[at, w - length[row]:] = ids[row]
                    mask[at, w - length[row]:] = 1
                logits[rows], width[rows] = scorer(block, mask), w
            out = pdf[list(keep)].copy()
            for j, L in enumerate(LETTERS):
                out[f"logit_{L}"] = logits[:, j]
            yield out.assign(n_tokens=length.astype(np.int32), padded_to=width)

    return src.mapInPandas(run, schema)


def argmax_letter(logit_cols: Sequence[str] = tuple(f"logit_{L}" for L in LETTERS),
                  letters: Sequence[str] = LETTERS) -> Column:
    """Letter of the highest logit; the first on ties; NaN counts as largest."""
    arr = F.array(*[F.col(c) for c in logit_cols])
    return F.element_at(F.array(*[F.lit(L) for L in letters]),
                        F.array_position(arr, F.array_max(arr)).cast("int"))


def active_letters(answers: DataFrame, token_map: DataFrame, answer: str = "answer") -> DataFrame:
    """Sorted letters occurring in the answers or in the token map."""
    a = answers.select(F.col(answer).alias("letter")).where(F.col("letter").isin(*LETTERS))
    t = token_map.select("letter")
    return a.union(t).agg(F.array_sort(F.collect_set("letter")).alias("letters"))


def assemble_predictions(scored: DataFrame, pred: Column, present: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Prediction rows: reference = upper(strip(answer)), correct flag,
    specialty falling back by *column presence* to umbrella_specialty then
    'Unknown', question_id falling back to row position, logits as columns,
    then the columns ``extra`` as they are."""
    spec = (F.col("specialty") if "specialty" in present else
            F.col("umbrella_specialty") if "umbrella_specialty" in present else F.lit("Unknown"))
    qid = F.col("question_id") if "question_id" in present else F.col("row_idx").cast("string")
    ref = F.upper(T.fill_strip("answer"))
    return scored.select(
        qid.alias("question_id"), ref.alias("gold_label"), pred.alias("pred_label"),
        (pred == ref).alias("correct"), spec.alias("specialty"),
        (F.col("umbrella_specialty") if "umbrella_specialty" in present else F.lit("Unknown")).alias("umbrella_specialty"),
        (F.col("level") if "level" in present else F.lit("Unknown")).alias("level"),
        *[F.col(f"logit_{L}") for L in LETTERS], *extra)


def eval_results(preds: DataFrame, group: str = "specialty", keys: Sequence[str] = (),
                 token_map: DataFrame | None = None) -> DataFrame:
    """One row per key: accuracy, macro F1 (present-label rule), total, and a
    map group -> {accuracy, macro_f1, count} (one aggregation per level).
    With ``token_map`` (letter, token_id) the result also carries the map
    letter -> answer token id used for scoring. A null group is the entry
    ``None`` of the map, together with groups of that name."""
    preds = preds.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("None")))
    # The predictions are read (and scored) once: groups and overall both come from the groups' cells.
    cells = cut_lineage(M.confusion_wide(preds, [*keys, group]))
    g = cells.select(*keys, group, M.accuracy_col().alias("accuracy"), M.macro_f1_present_col().alias("macro_f1"),
                     F.col("n").alias("count"))
    per = g.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(group), F.struct("accuracy", "macro_f1", "count")))).alias("per_specialty_scores"))
    counts = [c for c in cells.columns if c not in (*keys, group)]
    overall = cells.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts]).select(
        *keys, M.accuracy_col().alias("accuracy"), M.macro_f1_present_col().alias("macro_f1"),
        F.col("n").alias("total_samples"))
    out = overall.join(per, list(keys)) if keys else _one_row_join(overall, per)
    if token_map is not None:
        tm = token_map.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "token_id"))))
                           .alias("answer_token_ids"))
        out = _one_row_join(out, tm)
    return out


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row aggregates on a constant key."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
