"""Experiment-catalog queries.

Run records, planned runs and result files are small dimension tables next
to the large prediction fact table, but the same rules hold: every choice is
an aggregation with a deterministic tiebreak (``min_by`` over a struct), every
"already done?" test is an anti/semi join, and matrices are built by
exploding literal arrays (generators), not by cross joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stage methods accepted in run names.
STAGE1_METHODS = ("none", "lora", "full", "full3ep")
STAGE2_METHODS = ("none", "lora", "full", "qlora")
RUN_NAME_PATTERN = r"^(.+)_s1-(none|lora|full|full3ep)_s2-(none|lora|full|qlora)(_.*)?$"
# Report group order and titles.
GROUP_ORDER = ("zero-shot", "stage2-only", "two-stage", "stage1-only", "sweep", "qlora",
               "multi-seed", "new-models")
GROUP_TITLES = {
    "zero-shot": "Zero-shot baselines",
    "stage2-only": "Stage 2 only",
    "two-stage": "Two-stage (Stage 1 + Stage 2)",
    "stage1-only": "Stage 1 only (forgetting test)",
    "sweep": "LoRA hyperparameter sweep",
    "qlora": "QLoRA",
    "multi-seed": "Multi-seed reruns",
    "new-models": "New base models",
}
# Short names of the models added later in the study.
NEW_MODEL_PREFIXES = ("fanar", "silma", "qwen")
# Sweep grids and the fallback configuration.
RANKS = (8, 16, 32, 64)
BASE_RANK = 16
LEARNING_RATES = ("2e-4", "1e-4", "4e-4")
DROPOUTS = ("0.05", "0.0", "0.1")
FALLBACK = {"r": 16, "alpha": 32, "lr": "2e-4", "dropout": "0.05"}
FALLBACK_NOTE = "NOTE: using fallback Table 2 values for unresolved factors"
TRANSFER_FALLBACK_NOTE = "Task 3 sweep not finished -> fallback r=16/alpha=32/lr=2e-4/dropout=0.05 all-linear (noted)"
ATTENTION_MODULES = "q_proj,k_proj,v_proj,o_proj"


# --------------------------------------------------------------------------
# Run log (C4)
# --------------------------------------------------------------------------

def dedupe_run_log(log: DataFrame, seq: str = "event_id") -> DataFrame:
    """One record per run name: finished with accuracy beats finished without,
    which beats any other state; otherwise the first seen (lowest ``seq``)."""
    rank = (F.when((F.col("state") == "finished") & F.col("accuracy").isNotNull(), 0)
            .when(F.col("state") == "finished", 1).otherwise(2))
    best = F.min_by(F.struct(*[F.col(c) for c in log.columns]), F.struct(rank, F.col(seq)))
    return log.groupBy("run_name").agg(best.alias("_r")).select("_r.*")


def finished_accuracy(records: DataFrame) -> DataFrame:
    """run_name -> accuracy for finished runs (null accuracy kept as null)."""
    return records.where(F.col("state") == "finished").select("run_name", "accuracy")


# --------------------------------------------------------------------------
# Run names
# --------------------------------------------------------------------------

def parse_run_name(runs: DataFrame, models: DataFrame, name: str = "run_name") -> DataFrame:
    """``{short}_s1-{m1}_s2-{m2}{suffix}`` -> model, stage methods, qlora flag.
    Unknown short names drop out (inner join with the model dimension, which
    is a registry-sized table and is broadcast). full3ep -> full; qlora -> lora
    plus the flag. The first group is greedy, as in a backtracking regex."""
    n = F.col(name)
    parsed = runs.where(n.rlike(RUN_NAME_PATTERN)).select(
        n.alias("run_name"),
        F.regexp_extract(n, RUN_NAME_PATTERN, 1).alias("short_name"),
        F.regexp_extract(n, RUN_NAME_PATTERN, 2).alias("_s1"),
        F.regexp_extract(n, RUN_NAME_PATTERN, 3).alias("_s2"),
        F.regexp_extract(n, RUN_NAME_PATTERN, 4).alias("suffix"),
    )
    j = parsed.join(F.broadcast(models.select("short_name", "model_id")), "short_name", "inner")
    return j.select(
        "run_name", "model_id", "short_name",
        F.when(F.col("_s1") == "full3ep", "full").otherwise(F.col("_s1")).alias("stage1_method"),
        F.when(F.col("_s2") == "qlora", "lora").otherwise(F.col("_s2")).alias("stage2_method"),
        (F.col("_s2") == "qlora").alias("qlora"),
        F.when(F.col("suffix") == "", None).otherwise(F.col("suffix")).alias("suffix"),
    )


#: What the names of swept runs put before the value of a rank, a learning rate or a dropout rate.
RANK_MARK, LR_MARK, DROPOUT_MARK = "_r", "_lr", "_do"
ATTENTION_ONLY = "_attnonly"


def rank_run_name(short: Column, r: Column) -> Column:
    base = F.concat(short, F.lit("_s1-none_s2-lora"))
    return F.when(r == BASE_RANK, base).otherwise(F.concat(base, F.lit(RANK_MARK), r.cast("string")))


def lr_run_name(short: Column, lr: Column) -> Column:
    return F.concat(short, F.lit("_s1-none_s2-lora" + LR_MARK), lr)


def dropout_run_name(short: Column, do: Column) -> Column:
    return F.concat(short, F.lit("_s1-none_s2-lora" + DROPOUT_MARK), do)


def is_sweep(name: Column) -> Column:
    """Does the name end in a swept value, as the functions above write it: a
    mark and a whole number (rank) or a decimal number (rates), or attention only?"""
    last = F.concat(F.lit("_"), F.substring_index(name, "_", -1))

    def value(mark: str, kind: str) -> Column:
        text = F.substring(last, len(mark) + 1, 1 << 20)
        number = text.try_cast(kind)
        return last.startswith(mark) & F.coalesce(number >= 0, F.lit(False))

    ends = (last == ATTENTION_ONLY) | value(RANK_MARK, "long") | value(LR_MARK, "double") | value(DROPOUT_MARK, "double")
    return name.contains("_") & ends


def run_group(name: Column) -> Column:
    """Report group of a run name: the first rule that holds, else two-stage."""
    stage2_none, stage1_none = name.endswith("_s2-none"), name.contains("_s1-none_")
    new_model = F.lit(False)
    for p in NEW_MODEL_PREFIXES:
        new_model = new_model | name.startswith(p)
    rules = (("multi-seed", name.contains("_seed")), ("qlora", name.endswith("_s2-qlora")), ("sweep", is_sweep(name)),
             ("new-models", new_model), ("zero-shot", stage2_none & stage1_none), ("stage1-only", stage2_none),
             ("stage2-only", stage1_none))
    out = F.lit("two-stage")
    for group, holds in reversed(rules):
        out = F.when(holds, group).otherwise(out)
    return out


# --------------------------------------------------------------------------
# Matrices (J4) -- literal arrays exploded per model row
# --------------------------------------------------------------------------

def _explode_literal(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def build_run_matrix(models: DataFrame) -> DataFrame:
    """Planned runs that depend on no result: seeds, rank / lr / dropout /
    attention-only sweep, QLoRA and new models. ``run_plan`` adds arguments,
    notes and the stage-1 diagnostic. Columns: run_name, short_name, model_id,
    stage1_method, stage2_method, phase, train."""
    m = models.select("short_name", "model_id", "existing", "new")
    s = F.col("short_name")
    ex = m.where("existing")
    parts = []
    seeds = _explode_literal(_explode_literal(ex, ["lora", "full"], "s2"), [1337, 2024], "seed")
    parts.append(seeds.select(
        F.concat(s, F.lit("_s1-none_s2-"), F.col("s2"), F.lit("_seed"), F.col("seed").cast("string")).alias("run_name"),
        "short_name", "model_id", F.lit("none").alias("stage1_method"), F.col("s2").alias("stage2_method"),
        F.lit("seeds").alias("phase"), F.lit(True).alias("train")))
    ranks = _explode_literal(ex, [8, 32, 64], "r")
    parts.append(ranks.select(rank_run_name(s, F.col("r")).alias("run_name"), "short_name", "model_id",
                              F.lit("none").alias("stage1_method"), F.lit("lora").alias("stage2_method"),
                              F.lit("sweep").alias("phase"), F.lit(True).alias("train")))
    lrs = _explode_literal(ex, ["1e-4", "4e-4"], "lr")
    parts.append(lrs.select(lr_run_name(s, F.col("lr")).alias("run_name"), "short_name", "model_id",
                            F.lit("none").alias("stage1_method"), F.lit("lora").alias("stage2_method"),
                            F.lit("sweep").alias("phase"), F.lit(True).alias("train")))
    dos = _explode_literal(ex, ["0.0", "0.1"], "do")
    parts.append(dos.select(dropout_run_name(s, F.col("do")).alias("run_name"), "short_name", "model_id",
                            F.lit("none").alias("stage1_method"), F.lit("lora").alias("stage2_method"),
                            F.lit("sweep").alias("phase"), F.lit(True).alias("train")))
    for suffix, s2, phase in (("_s1-none_s2-lora_attnonly", "lora", "sweep"), ("_s1-none_s2-qlora", "lora", "sweep")):
        parts.append(ex.select(F.concat(s, F.lit(suffix)).alias("run_name"), "short_name", "model_id",
                               F.lit("none").alias("stage1_method"), F.lit(s2).alias("stage2_method"),
                               F.lit(phase).alias("phase"), F.lit(True).alias("train")))
    new = _explode_literal(m.where("new"), ["none", "lora", "full"], "s2")
    parts.append(new.select(F.concat(s, F.lit("_s1-none_s2-"), F.col("s2")).alias("run_name"), "short_name",
                            "model_id", F.lit("none").alias("stage1_method"), F.col("s2").alias("stage2_method"),
                            F.lit("newmodels").alias("phase"), (F.col("s2") != "none").alias("train")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def existing_conditions(models: DataFrame) -> DataFrame:
    """The seven pre-existing (stage 1, stage 2) conditions per existing model."""
    pairs = [("none", "none"), ("none", "lora"), ("none", "full"), ("lora", "lora"),
             ("lora", "full"), ("full", "lora"), ("full", "full")]
    arr = F.array(*[F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2")) for a, b in pairs])
    m = models.where("existing").select("short_name", "model_id", F.explode(arr).alias("c"))
    return m.select(
        F.concat(F.col("short_name"), F.lit("_s1-"), F.col("c.s1"), F.lit("_s2-"), F.col("c.s2")).alias("run_name"),
        "short_name", "model_id", F.col("c.s1").alias("stage1_method"), F.col("c.s2").alias("stage2_method"),
        F.lit("reinfer").alias("phase"), F.lit(False).alias("train"))


# --------------------------------------------------------------------------
# Resume logic
# --------------------------------------------------------------------------

def skip_completed(planned: DataFrame, log_finished: DataFrame, local_done: DataFrame) -> DataFrame:
    """status = SKIP(<reason>) when the run finished in the log or has a local
    result, else LAUNCH. Log evidence wins the reason. Semi/anti joins only."""
    ev_log = log_finished.select("run_name").distinct().withColumn("_r1", F.lit("tracker finished run"))
    ev_loc = local_done.select("run_name").distinct().withColumn("_r2", F.lit("local eval results"))
    j = planned.join(ev_log, "run_name", "left").join(ev_loc, "run_name", "left")
    reason = F.coalesce(F.col("_r1"), F.col("_r2"))
    return j.select(*planned.columns, F.when(reason.isNull(), "LAUNCH")
                    .otherwise(F.concat(F.lit("SKIP("), reason, F.lit(")"))).alias("status"))


def collect_specs(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """Known conditions plus scanned names not already known (first wins)."""
    extra = scanned.join(known.select("run_name"), "run_name", "left_anti")
    return known.unionByName(extra, allowMissingColumns=True)


def reinfer_plan(specs: DataFrame, has_predictions: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per condition: SKIP (predictions exist), MISSING CHECKPOINT (a trained
    stage is needed but absent) or REINFER. ``checkpoints``: (run_name, stage)."""
    needs = (F.col("stage1_method") != "none") | (F.col("stage2_method") != "none")
    stage = F.when(F.col("stage2_method") != "none", "stage2").otherwise("stage1")
    s = specs.withColumn("_stage", stage).withColumn("_needs", needs)
    p = has_predictions.select("run_name").distinct().withColumn("_pred", F.lit(True))
    c = checkpoints.select("run_name", F.col("stage").alias("_stage")).distinct().withColumn("_ckpt", F.lit(True))
    j = s.join(p, "run_name", "left").join(c, ["run_name", "_stage"], "left")
    action = (F.when(F.col("_pred"), "SKIP").when(F.col("_needs") & F.col("_ckpt").isNull(), "MISSING CHECKPOINT")
              .otherwise("REINFER"))
    return j.select(*specs.columns, action.alias("action"))


def plan_summary(plan: DataFrame, status: str = "status") -> DataFrame:
    st = F.col(status)
    return plan.agg(F.count(F.lit(1)).alias("planned"),
                    F.count_if(st == "LAUNCH").alias("launch"),
                    F.count_if(st.startswith("SKIP")).alias("skip"))


# --------------------------------------------------------------------------
# Best configuration (H2-H4)
# --------------------------------------------------------------------------

@F.pandas_udf(StringType())
def _four_places(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else f"{float(v):.4f}")


def _pick(cands: DataFrame, acc: DataFrame, key: str, value: str, n_expected: int) -> DataFrame:
    """Per key: best candidate by accuracy (ties -> lowest ``ord``), whether all
    candidates have a finished accuracy, and the missing values in order."""
    j = cands.join(acc, "run_name", "left")
    best = F.min_by(F.col(value), F.struct(-F.col("accuracy"), F.col("ord")))
    missing = F.array_sort(F.collect_list(F.when(F.col("accuracy").isNull(), F.struct("ord", value))))
    return j.groupBy(key).agg(
        best.alias("best"), F.max("accuracy").alias("best_accuracy"), F.count("accuracy").alias("n_found"),
        F.transform(missing, lambda x: x[value]).alias("missing"),
    ).withColumn("resolved", F.col("n_found") == n_expected)


def best_rank(models: DataFrame, acc: DataFrame) -> DataFrame:
    """Rank in {8, 16, 32, 64} with the best accuracy; if any rank run is
    unfinished: 16, unresolved, with the missing ranks listed; ties -> smaller.
    ``accuracy`` is that of the best run, null when unresolved."""
    r = _explode_literal(models.select("short_name"), list(RANKS), "r")
    cands = r.select("short_name", "r", F.col("r").alias("ord"),
                     rank_run_name(F.col("short_name"), F.col("r")).alias("run_name"))
    p = _pick(cands, acc, "short_name", "r", len(RANKS))
    rank = F.when(F.col("resolved"), F.col("best")).otherwise(F.lit(BASE_RANK))
    note = F.when(F.col("resolved"), F.concat(F.lit("best rank r="), F.col("best").cast("string"), F.lit(" (acc="),
                                              _four_places("best_accuracy"), F.lit(")"))).otherwise(
        F.concat(F.lit("rank sweep incomplete (missing r="),
                 F.array_join(F.transform("missing", lambda x: x.cast("string")), ","),
                 F.lit("); falling back to r=16")))
    return p.select("short_name", rank.alias("r"), "resolved", note.alias("note"),
                    F.when(F.col("resolved"), F.col("best_accuracy")).alias("accuracy"))


def best_config(models: DataFrame, acc: DataFrame) -> DataFrame:
    """One factor at a time: rank, then learning rate and dropout, each against
    the best-rank run as the baseline candidate (listed first, so it wins
    ties); any unfinished candidate -> that factor's fallback value. ``notes``
    says how each factor was found."""
    br = best_rank(models, acc)
    base = br.select("short_name", "r", rank_run_name(F.col("short_name"), F.col("r")).alias("base_run"))

    def factor(values, name_fn, col, sweep, label):
        arr = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias(col)) for i, v in enumerate(values)])
        c = base.select("short_name", "base_run", F.inline(arr))
        c = c.withColumn("run_name", F.when(F.col("ord") == 0, F.col("base_run"))
                         .otherwise(name_fn(F.col("short_name"), F.col(col))))
        p = _pick(c.select("short_name", "ord", col, "run_name"), acc, "short_name", col, len(values))
        note = F.when(F.col("resolved"), F.concat(F.lit(f"best {label}="), F.col("best"))).otherwise(
            F.lit(f"{sweep} sweep incomplete; falling back to {label}={values[0]}"))
        return p.select("short_name", F.when(F.col("resolved"), F.col("best")).otherwise(F.lit(values[0])).alias(col),
                        F.col("resolved").alias(f"{col}_resolved"), note.alias(f"{col}_note"))

    lr = factor(LEARNING_RATES, lr_run_name, "lr", "LR", "lr")
    do = factor(DROPOUTS, dropout_run_name, "dropout", "dropout", "dropout")
    every = F.col("resolved") & F.col("lr_resolved") & F.col("dropout_resolved")
    out = br.join(lr, "short_name").join(do, "short_name")
    return out.select("short_name", "r", (F.col("r") * 2).alias("alpha"), "lr", "dropout", every.alias("resolved"),
                      F.col("resolved").alias("rank_resolved"), "lr_resolved", "dropout_resolved",
                      F.concat_ws("; ", "note", "lr_note", "dropout_note", F.when(~every, F.lit(FALLBACK_NOTE))).alias("notes"),
                      F.col("note").alias("rank_note"))


def transfer_config(models: DataFrame, acc: DataFrame) -> DataFrame:
    """The resolved configuration of the existing model whose best-rank run
    scored highest; the documented fallback when none is resolved."""
    cfg = best_config(models.where("existing"), acc)
    cand = cfg.where("resolved").withColumn("run_name", rank_run_name(F.col("short_name"), F.col("r"))).join(
        acc, "run_name", "left")
    best = cand.agg(F.min_by(F.struct("short_name", "r", "alpha", "lr", "dropout", "notes"),
                             F.struct(-F.coalesce(F.col("accuracy"), F.lit(0.0)), F.col("short_name"))).alias("b"))
    fb = F.struct(F.lit(None).cast("string").alias("short_name"), F.lit(FALLBACK["r"]).alias("r"),
                  F.lit(FALLBACK["alpha"]).alias("alpha"), F.lit(FALLBACK["lr"]).alias("lr"),
                  F.lit(FALLBACK["dropout"]).alias("dropout"), F.lit(None).cast("string").alias("notes"))
    taken = F.concat(F.lit("transferred from "), F.col("c.short_name"), F.lit(" sweep ("), F.col("c.notes"), F.lit(")"))
    return best.select(F.coalesce(F.col("b"), fb).alias("c"), F.col("b").isNotNull().alias("resolved")).select(
        F.col("c.short_name").alias("source_model"), "c.r", "c.alpha", "c.lr", "c.dropout", "resolved",
        F.coalesce(taken, F.lit(TRANSFER_FALLBACK_NOTE)).alias("notes"))


# --------------------------------------------------------------------------
# The plan from results (J4 with H2-H4)
# --------------------------------------------------------------------------

def _texts(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _plain(rate: Column) -> Column:
    """A rate as an argument: 2e-4 -> 0.0002, 0.0 as it is."""
    return F.when(rate.contains("e"), rate.cast("decimal(10,4)").cast("string")).otherwise(rate)


def _overrides(cfg: str) -> Column:
    """The arguments of a resolved configuration."""
    c = lambda f: F.col(f"{cfg}.{f}")
    return _texts("--lora_r", c("r"), "--lora_alpha", c("alpha"), "--learning_rate", _plain(c("lr")), "--lora_dropout", c("dropout"))


def run_plan(models: DataFrame, acc: DataFrame, diagnostic: str) -> DataFrame:
    """The planned runs with what follows from the runs finished so far: each
    model's best rank and configuration, and the configuration that new models
    take over, are joined to the model and become arguments and notes of its
    runs. ``acc``: (run_name, accuracy) of finished runs. ``diagnostic`` is the
    short name of the model of the stage-1 diagnostic.

    Columns: those of ``build_run_matrix`` (whose runs are planned, and the
    diagnostic), extra_args array<string>, note."""
    cfg = best_config(models.where("existing"), acc).select("short_name", F.struct("r", "alpha", "lr", "dropout", "notes", "rank_note").alias("best"))
    taken = transfer_config(models, acc).select(F.struct("r", "alpha", "lr", "dropout", "notes").alias("taken"))
    ranked = _texts("--lora_r", F.col("best.r"), "--lora_alpha", F.col("best.alpha"))
    existing = models.where("existing").join(cfg, "short_name")
    # The transferred configuration is one row.
    new = models.where("new").withColumn("_one", F.lit(1)).join(F.broadcast(taken.withColumn("_one", F.lit(1))), "_one")

    def specs(of: DataFrame, suffix: Column, stage2: Column | str, phase: str, args: Column, note: Column, stage1: str = "none",
              train: Column | None = None) -> DataFrame:
        return of.select(F.concat("short_name", suffix).alias("run_name"), "short_name", "model_id", F.lit(stage1).alias("stage1_method"),
                         (F.lit(stage2) if isinstance(stage2, str) else stage2).alias("stage2_method"), F.lit(phase).alias("phase"),
                         (F.lit(True) if train is None else train).alias("train"), args.alias("extra_args"), note.alias("note"))

    def swept(values: Sequence, name: Callable[[Column, Column], Column], args: Callable[[Column], Column],
              note: Callable[[Column], Column]) -> DataFrame:
        v, none = F.col("_value"), F.lit("")
        return specs(_explode_literal(existing, values, "_value"), name(none, v), "lora", "sweep", args(v), note(v))

    seeds = _explode_literal(_explode_literal(existing, ["lora", "full"], "_method"), [1337, 2024], "_seed")
    methods = _explode_literal(new, ["none", "lora", "full"], "_method")
    method, seed, none = F.col("_method"), F.col("_seed"), F.array().cast("array<string>")
    at_rank = F.col("best.rank_note")
    parts = [
        specs(seeds, _said("_s1-none_s2-", method, "_seed", seed), method, "seeds", _texts("--seed", seed),
              _said("multi-seed rerun (seed ", seed, ")")),
        swept([r for r in RANKS if r != BASE_RANK], rank_run_name, lambda r: _texts("--lora_r", r, "--lora_alpha", r * 2),
              lambda r: _said("rank sweep r=", r, ", alpha=", r * 2)),
        swept(LEARNING_RATES[1:], lr_run_name, lambda lr: F.concat(ranked, _texts("--learning_rate", _plain(lr))),
              lambda _: _said("LR ablation at ", at_rank)),
        swept(DROPOUTS[1:], dropout_run_name, lambda do: F.concat(ranked, _texts("--lora_dropout", do)),
              lambda _: _said("dropout ablation at ", at_rank)),
        specs(existing, F.lit("_s1-none_s2-lora" + ATTENTION_ONLY), "lora", "sweep",
              F.concat(ranked, _texts("--lora_target_modules", ATTENTION_MODULES)), _said("attention-only ablation at ", at_rank)),
        specs(existing, F.lit("_s1-none_s2-qlora"), "lora", "sweep", F.concat(_texts("--qlora"), _overrides("best")),
              _said("QLoRA; ", F.col("best.notes"))),
        specs(methods, _said("_s1-none_s2-", method), method, "newmodels",
              F.when(method == "lora", _overrides("taken")).otherwise(none),
              F.when(method == "none", "zero-shot baseline").when(method == "lora", _said("Stage-2 LoRA; ", F.col("taken.notes")))
              .otherwise("Stage-2 full fine-tuning (Table 2 conventions)"), train=method != "none"),
        specs(models.where(F.col("short_name") == diagnostic), F.lit("_s1-full3ep_s2-full"), "full", "stage1diag",
              _texts("--stage1_epochs", "3"), F.lit("multi-epoch Stage 1 ablation (3 epochs vs existing 1)"), stage1="full"),
    ]
    return reduce(DataFrame.unionByName, parts)


def sorted_report(config: DataFrame) -> DataFrame:
    """Rows with their group, ordered by group order then run name; empty
    groups simply have no rows."""
    order = F.array(*[F.lit(g) for g in GROUP_ORDER])
    g = run_group(F.col("run_name"))
    return (config.withColumn("group", g)
            .withColumn("group_pos", F.array_position(order, F.col("group")))
            .orderBy("group_pos", "run_name"))
