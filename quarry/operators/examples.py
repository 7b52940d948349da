"""Training-example building.

* Exact seeded split: rows are ranked by md5('<seed>:<id>') and the first
  ceil(f * n) are validation. The cut is found without a global sort: a
  histogram over the first four hex digits (65,536 buckets, uniform because
  md5 is) locates the boundary bucket, only that bucket's rows are ranked,
  and everything else is decided by comparing its bucket with the boundary.
* Prompts are ``concat`` / ``when`` column expressions.
* Tokenise + label mask: a tokenizer is either a Column builder (the built-in
  character tokenizer, pure array functions, JVM-side) or a caller-supplied
  Python tokenizer factory applied with ``mapInPandas`` (one instance per
  task, Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators.rows import with_ordinal
from quarry.session import cut_lineage

# Prompt layout.
QUESTION_HEADER = "### Question:\n"
OPTIONS_HEADER = "### Options:\n"
ANSWER_MARKER = "### Answer:\n"
IGNORE_INDEX = -100
PREFIX_HEX = 4  # histogram buckets = 16 ** PREFIX_HEX


# --------------------------------------------------------------------------
# Splits, caps, samples
# --------------------------------------------------------------------------

def split_key(id_col: Column, seed: int) -> Column:
    """md5('<seed>:<id>'); a null id counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def split_exact(df: DataFrame, id_col: str, fraction: float, seed: int = 42, name: str = "split",
                max_train: int | None = None, max_val: int | None = None) -> DataFrame:
    """Label every row 'val' or 'train'; exactly ceil(fraction * n) rows are
    'val': those with the smallest md5('<seed>:<id>') (ties by id).

    ``max_val`` and ``max_train`` cap each side after the split, in the order of
    the split; rows beyond a cap are left out. A cap never moves a row to the
    other side."""
    if min(max_train or 0, max_val or 0) < 0:
        raise ValueError("a cap is a number of rows, 0 or more")
    keyed = df.withColumn("_h", split_key(F.col(id_col), seed)).withColumn("_b", F.substring("_h", 1, PREFIX_HEX))
    # One pass builds the histogram (<= 65,536 rows); the windows below run on
    # that small table only, and its one row of cuts comes to the driver.
    hist = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    cum = hist.select("_b", "_c", F.sum("_c").over(Window.orderBy("_b")).alias("_cum"),
                      F.sum("_c").over(Window.partitionBy()).alias("_n"))
    # Ranks at which a label ends, each with the bucket that holds it.
    k = F.ceil(F.lit(fraction) * F.col("_n"))
    ranks = {"split": k}
    if max_val is not None:
        ranks["val"] = F.least(F.lit(max_val), k)
    if max_train is not None:
        ranks["train"] = F.least(k + max_train, F.col("_n"))
    cuts = cum.agg(*[F.min(F.when(F.col("_cum") >= rank, F.struct(
        "_b", (F.col("_cum") - F.col("_c")).alias("before"), F.col("_c").alias("size"), rank.alias("rank")))).alias(end)
        for end, rank in ranks.items()]).first()
    if cuts["split"] is None:  # no rows
        return keyed.withColumn(name, F.lit("train")).drop("_h", "_b")
    held = {c["_b"]: c for c in cuts}

    def label(past: Callable[[str], Column]) -> Column:
        """The label of a row by the ranks it lies at or past; null beyond a cap."""
        val_end, train_end = "val" if "val" in ranks else "split", "train" if "train" in ranks else None
        train = past("split") & ~past(train_end) if train_end else past("split")
        return F.when(~past(val_end), "val").when(train, "train")

    # Rows of the buckets that hold a cut only (about n / 65,536 each, unless one
    # id is repeated massively). They are ranked by a range-partitioned sort
    # whose key ends in a per-row tiebreaker, so even a hot id is split over
    # many tasks, then by the partition-offset ordinal -- no single-task window.
    # These rows (few) are checkpointed with their tiebreaker: the
    # ranking below reads them several times (range sampling, sort, ordinal
    # offsets) without rescanning the input, and the tiebreaker is fixed once.
    inside = cut_lineage(keyed.where(F.col("_b").isin(*held)).withColumn("_tie", F.monotonically_increasing_id()))
    ranked = with_ordinal(inside.orderBy("_h", id_col, "_tie"), "_rk")
    earlier, rank = 0, F.lit(None)
    for bucket in sorted(held):
        rank = F.when(F.col("_b") == bucket, F.col("_rk") + (held[bucket]["before"] - earlier)).otherwise(rank)
        earlier += held[bucket]["size"]
    inside_lbl = ranked.withColumn("_rk", rank).withColumn(
        name, label(lambda end: F.col("_rk") >= cuts[end]["rank"])).drop("_rk", "_tie")
    outside = keyed.where(~F.col("_b").isin(*held)).withColumn(name, label(lambda end: F.col("_b") > cuts[end]["_b"]))
    out = outside.unionByName(inside_lbl).drop("_h", "_b")
    return out if len(ranks) == 1 else out.where(F.col(name).isNotNull())


def cap_rows(df: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """First ``n`` rows in input order (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(order).limit(n)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible random peek of ``n`` rows."""
    return df.orderBy(split_key(F.col(id_col), seed), id_col).limit(n)


# --------------------------------------------------------------------------
# Prompts (D1-D3, D5)
# --------------------------------------------------------------------------

def prompt_open_qa(question="question", answer="answer") -> Column:
    return F.concat(F.lit(QUESTION_HEADER), T.fill_strip(question), F.lit("\n\n"),
                    F.lit(ANSWER_MARKER), T.fill_strip(answer))


def prompt_mcq(include_answer: bool = True) -> Column:
    """Question, options A-D, option E only when non-empty, answer marker,
    and the answer letter when ``include_answer``."""
    opts = F.concat(*[F.concat(F.lit(f"{L}) "), T.fill_strip(f"option_{L.lower()}"), F.lit("\n" if L != "D" else ""))
                      for L in "ABCD"])
    e = T.fill_strip("option_e")
    opts = F.when(F.length(e) > 0, F.concat(opts, F.lit("\nE) "), e)).otherwise(opts)
    prompt = F.concat(F.lit(QUESTION_HEADER), T.fill_strip("question"), F.lit("\n\n"), F.lit(OPTIONS_HEADER),
                      opts, F.lit("\n\n"), F.lit(ANSWER_MARKER))
    if include_answer:
        return F.concat(prompt, T.fill_strip("answer"))
    return prompt


def prompt_and_answer(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``prompt_text`` (text through the LAST answer marker) and
    ``answer_text`` (the rest). Without a marker the cut falls where a failed
    search (-1) puts it."""
    t = F.col(text)
    rest = F.substring_index(t, ANSWER_MARKER, -1)
    has = F.locate(ANSWER_MARKER, t) > 0
    cut = F.when(has, F.length(t) - F.length(rest)).otherwise(F.lit(len(ANSWER_MARKER) - 1))
    big = F.lit(2 ** 31 - 1)
    return df.withColumn("_cut", cut).select(
        "*", t.substr(F.lit(1), F.col("_cut")).alias("prompt_text"),
        t.substr(F.col("_cut") + 1, big).alias("answer_text")).drop("_cut")


FORMATTERS: Mapping[str, Callable[[], Column]] = {
    "open_qa": lambda: prompt_open_qa(),
    "mcq": lambda: prompt_mcq(include_answer=True),
}


def build_examples(df: DataFrame, formatter: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rendered training text per row; source columns are dropped."""
    if formatter not in FORMATTERS:
        raise ValueError(f"Unknown formatter {formatter!r}; choose one of {sorted(FORMATTERS)}")
    return df.select(*keep, FORMATTERS[formatter]().alias("text"))


# --------------------------------------------------------------------------
# Tokenise + label mask
# --------------------------------------------------------------------------

class CharTokenizer:
    """Built-in tokenizer: BOS, then one id per character (code point +
    offset); EOS id for end of sequence. JVM-side as array functions, and the
    same rule in Python for the ``mapInPandas`` path and tests."""

    def __init__(self, bos: int = 1, eos: int = 2, offset: int = 3):
        self.bos, self.eos, self.offset = bos, eos, offset
        self.eos_token_id = eos

    # Column form
    def ids(self, text: Column) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)
        return F.concat(F.array(F.lit(self.bos)), F.transform(chars, lambda c: F.ascii(c) + self.offset))

    def count(self, text: Column) -> Column:
        """Number of ids without building them: BOS + one per code point
        (equal to size(ids(text)); Spark's character split and length both
        count code points)."""
        return F.length(text) + 1

    # Python form
    def encode(self, text: str) -> list[int]:
        return [self.bos] + [ord(c) + self.offset for c in text]


def tokenise_and_mask(prompt_ids: Column, full_ids: Column, max_len: int, eos: int) -> tuple[Column, Column, Column]:
    """(input_ids, attention_mask, labels) from untruncated prompt ids and
    full ids: truncate to max_len, append EOS unless already last (then cut
    again), mask the prompt positions with -100, cut labels to length."""
    cut = F.slice(full_ids, 1, max_len)
    last = F.element_at(cut, -1)
    ids = F.when(F.size(cut) == 0, F.array(F.lit(eos))).when(
        last == eos, cut).otherwise(F.slice(F.concat(cut, F.array(F.lit(eos))), 1, max_len))
    n_prompt = F.size(prompt_ids)
    labels_full = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), n_prompt),
                           F.slice(ids, n_prompt + 1, F.greatest(F.size(ids) - n_prompt, F.lit(0))))
    labels = F.slice(labels_full, 1, F.size(ids))
    mask = F.array_repeat(F.lit(1), F.size(ids))
    return ids, mask, labels


def tokenise(df: DataFrame, text: str = "text", max_len: int = 512,
             tokenizer: CharTokenizer | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """JVM-side tokenise + mask with a Column tokenizer."""
    tok = tokenizer or CharTokenizer()
    pa = prompt_and_answer(df.select(*keep, text), text)
    ids, mask, labels = tokenise_and_mask(tok.ids(F.col("prompt_text")), tok.ids(F.col(text)), max_len, tok.eos)
    return pa.select(*keep, ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def _mask_python(prompt_ids: list[int], full_ids: list[int], max_len: int, eos: int):
    ids = full_ids[:max_len]
    if not ids or ids[-1] != eos:
        ids = (ids + [eos])[:max_len]
    masked = len(prompt_ids)
    return ids, [1] * len(ids), [IGNORE_INDEX if at < masked else token for at, token in enumerate(ids)]


def tokenise_with(df: DataFrame, tokenizer_factory: Callable[[], object], text: str = "text",
                  max_len: int = 512, keep: Sequence[str] = ()) -> DataFrame:
    """Tokenise + mask with a caller-supplied Python tokenizer (anything with
    ``encode(str) -> list[int]`` and ``eos_token_id``), one instance per task."""
    pa = prompt_and_answer(df.select(*keep, text), text).select(*keep, text, "prompt_text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
                       + ["input_ids array<int>", "attention_mask array<int>", "labels array<int>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer_factory()
        for pdf in batches:
            out = [_mask_python(tok.encode(p), tok.encode(t), max_len, tok.eos_token_id)
                   for p, t in zip(pdf["prompt_text"], pdf[text])]
            res = pdf[list(keep)].copy()
            res["input_ids"] = [o[0] for o in out]
            res["attention_mask"] = [o[1] for o in out]
            res["labels"] = [o[2] for o in out]
            yield res

    return pa.mapInPandas(run, schema)


# --------------------------------------------------------------------------
# Batches and padding
# --------------------------------------------------------------------------

def pad_batches(df: DataFrame, ids: str = "input_ids", batch_size: int = 16, pad_id: int = 0,
                order: str | None = None) -> DataFrame:
    """Fixed-size batches in input order, each sequence left-padded to the
    longest in its batch, with the attention mask. Batch ids come from the
    partition-offset ordinal; the max length is a window per batch (a batch
    holds ``batch_size`` rows, so no partition grows with the data)."""
    if order is None:
        df = with_ordinal(df, "_pos")
        order = "_pos"
    b = df.withColumn("batch_id", F.floor(F.col(order) / batch_size).cast("bigint"))
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    b = b.withColumn("_pad", longest - F.size(ids))
    return b.select(
        *[c for c in df.columns if c not in (ids, "_pos")], "batch_id",
        F.concat(F.array_repeat(F.lit(pad_id), F.col("_pad")), F.col(ids)).alias("padded_ids"),
        F.concat(F.array_repeat(F.lit(0), F.col("_pad")), F.array_repeat(F.lit(1), F.size(ids))).alias("attention_mask"),
    )


# --------------------------------------------------------------------------
# Answer-token resolution
# --------------------------------------------------------------------------

def resolve_label_tokens(vocab: DataFrame, letters: Sequence[str] = ("A", "B", "C", "D", "E"),
                         variants: Sequence[str] = ("{letter}", " {letter}")) -> DataFrame:
    """Per letter: the first variant that is exactly one vocabulary token.
    ``vocab``: (token string, token_id). Output rows (letter, variant,
    token_id, status) where status is 'ok', 'missing' (no variant is a single
    token) or 'collision' (id shared with another letter)."""
    cand = F.array(*[F.struct(F.lit(L).alias("letter"), F.lit(i).alias("ord"),
                              F.lit(v.format(letter=L)).alias("variant"))
                     for L in letters for i, v in enumerate(variants)])
    spark = vocab.sparkSession
    c = spark.range(1).select(F.inline(cand))
    vocab = vocab.where(F.col("token").isin([v.format(letter=L) for L in letters for v in variants]))
    # Candidates are a few strings: the filter above keeps only their rows of
    # the vocabulary, and moves below a distinct that made it.
    hit = c.join(vocab.select(F.col("token").alias("variant"), "token_id"), "variant", "inner")
    best = hit.groupBy("letter").agg(F.min_by(F.struct("variant", "token_id"), F.col("ord")).alias("b"))
    allc = c.select("letter").distinct().join(best, "letter", "left")
    n_share = F.count(F.lit(1)).over(Window.partitionBy("b.token_id"))
    return allc.select(
        "letter", F.col("b.variant").alias("variant"), F.col("b.token_id").alias("token_id"),
        F.when(F.col("b").isNull(), "missing").when(n_share > 1, "collision").otherwise("ok").alias("status"))
