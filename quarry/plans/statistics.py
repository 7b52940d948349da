"""Registered queries: inferential statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import inference as I
from quarry.operators import metrics as M
from quarry.plans import sqlgen as S
from quarry.sources import fixtures as X

# Replicates that ``bootstrap_hash_200`` compares with DuckDB, whose join multiplies questions by
# replicates and runs. ``bootstrap_hash`` runs the operator's default of 10,000, as ``bootstrap_ci``.
HASH_REPLICATES = 200


def _preds(spark, sf):
    return X.predictions(spark, sf)


def _contrasts(spark, sf):
    return I.find_contrasts(_preds(spark, sf), X.models(spark))


def _mcnemar(spark, sf):
    c = _contrasts(spark, sf)
    paired = I.paired_predictions(_preds(spark, sf), c)
    return I.mcnemar(paired, with_chi2_p=False).join(c.select("contrast", "model", "stage1"), "contrast")


def _hash_ci(ci):
    return ci.select("run_name", "n_boot", *[F.round(c, 9).alias(c) for c in ("acc_ci_lo", "acc_ci_hi", "f1_ci_lo", "f1_ci_hi")])


def _statistics(spark, sf):
    preds = _preds(spark, sf)
    config = I.bootstrap_ci(preds)
    # Seed aggregates need point estimates only: no second bootstrap.
    seeds = M.seed_aggregates(M.run_metrics(preds).select("run_name", "accuracy", "macro_f1"))
    return I.statistics_table(config, I.contrast_report(preds, X.models(spark)), seeds)


QUERIES = {
    "find_contrasts": _contrasts,
    "align_pair": lambda spark, sf: I.align_pair(_preds(spark, sf), "alpha-8b_s1-none_s2-full",
                                                 "alpha-8b_s1-none_s2-lora"),
    "mcnemar": _mcnemar,
    "bootstrap_hash": lambda spark, sf: _hash_ci(I.bootstrap_hash(_preds(spark, sf))),
    "bootstrap_hash_200": lambda spark, sf: _hash_ci(I.bootstrap_hash(_preds(spark, sf), HASH_REPLICATES)),
    "bootstrap_hash_rep0": lambda spark, sf: I.bootstrap_hash_replicates(_preds(spark, sf), 1).select(
        "run_name", "rep", F.col("n").alias("weighted_n"), F.col("n_correct").alias("weighted_correct")),
    "bootstrap_ci": lambda spark, sf: I.bootstrap_ci(_preds(spark, sf)),
    "config_report": lambda spark, sf: I.bootstrap_ci(_preds(spark, sf)).orderBy("run_name"),
    "paired_bootstrap_delta": lambda spark, sf: I.paired_bootstrap_delta(
        I.paired_predictions(_preds(spark, sf), _contrasts(spark, sf))),
    "joint_counts": lambda spark, sf: I.joint_counts(
        I.paired_predictions(_preds(spark, sf), _contrasts(spark, sf))),
    "contrast_report": lambda spark, sf: I.contrast_report(_preds(spark, sf), X.models(spark)),
    "statistics_table": _statistics,
}

PAIRS = """
runs as (select distinct run_name from predictions),
parsed as (select run_name, regexp_extract(run_name, '^(.+)_s1-(none|lora|full|full3ep)_s2-(full|lora)$', 1) as model,
             regexp_extract(run_name, '^(.+)_s1-(none|lora|full|full3ep)_s2-(full|lora)$', 2) as stage1,
             regexp_extract(run_name, '^(.+)_s1-(none|lora|full|full3ep)_s2-(full|lora)$', 3) as s2
           from runs where regexp_matches(run_name, '^(.+)_s1-(none|lora|full|full3ep)_s2-(full|lora)$')
             and regexp_extract(run_name, '^(.+)_s1-(none|lora|full|full3ep)_s2-(full|lora)$', 1)
                 in (select short_name from models)),
contrasts as (select f.model, f.stage1, f.run_name || ' vs ' || l.run_name as contrast,
                f.run_name as run_full, l.run_name as run_lora
              from parsed f join parsed l on f.model = l.model and f.stage1 = l.stage1
              where f.s2 = 'full' and l.s2 = 'lora'),
paired as (select c.contrast, a.question_id, a.gold_label as gold_a, a.pred_label as pred_a, b.pred_label as pred_b
           from contrasts c join predictions a on a.run_name = c.run_full
             join predictions b on b.run_name = c.run_lora and b.question_id = a.question_id)"""


def _binom_sql(b: str, c: str) -> str:
    m, n = f"least({b}, {c})", f"({b} + {c})"
    total = (f"cast(list_sum(list_transform(range(0, {m} + 1), "
             f"lambda i: factorial(cast({n} as integer)) // (factorial(cast(i as integer)) * factorial(cast({n} - i as integer))))) as double)")
    return f"least(1.0, 2.0 * {total} / pow(2.0, {n}))"


_W_HASH = """
q as (select distinct question_id from predictions),
w as (select question_id, rep, w from (
        select question_id, rep,
          (select count(*) from (values {th}) t(x)
            where ('0x' || substr(md5(cast(question_id as varchar) || ':' || cast(rep as varchar)), 1, 8))::bigint >= x) as w
        from q, range(0, {b}) r(rep)) where w > 0),
j as (select p.run_name, w.rep, w.w, p.gold_label, p.pred_label from predictions p join w using (question_id))"""


def _hash_cte(b: int) -> str:
    th = ", ".join(f"({t})" for t in I.POISSON_THRESHOLDS)
    return _W_HASH.format(th=th, b=b)


def _weighted_wide(src: str) -> str:
    cells = ",\n  ".join(
        f"sum(case when gold_label = '{a}' and pred_label = '{b}' then w else 0 end) as n_{a}{b}"
        for a in S.LETTERS for b in S.LETTERS)
    return (f"cm as (select run_name, rep, sum(w) as n, sum(case when gold_label = pred_label then w else 0 end) "
            f"as n_correct,\n  {cells}\n from {src} group by run_name, rep)")


ORACLE = {
    "find_contrasts": X.with_fixtures(f"with {PAIRS} select * from contrasts", "predictions", "models"),
    "align_pair": X.with_fixtures("""
with a as (select * from predictions where run_name = 'alpha-8b_s1-none_s2-full'),
     b as (select * from predictions where run_name = 'alpha-8b_s1-none_s2-lora')
select 'alpha-8b_s1-none_s2-full' as run_a, 'alpha-8b_s1-none_s2-lora' as run_b,
  (select count(*) from a) as rows_a, (select count(*) from b) as rows_b, count(*) as aligned,
  count(*) filter (where a.gold_label is distinct from b.gold_label) as gold_disagreements
from a join b using (question_id)""", "predictions"),
    "mcnemar": X.with_fixtures(f"""with {PAIRS},
cnt as (select contrast, count(*) as n,
          count(*) filter (where pred_a = gold_a and pred_b <> gold_a) as b,
          count(*) filter (where pred_a <> gold_a and pred_b = gold_a) as c
        from paired group by contrast)
select cnt.contrast, n, b as mcnemar_b, c as mcnemar_c,
  case when b + c = 0 then 0.0 when b + c < 25 then cast(least(b, c) as double)
       else pow(abs(b - c) - 1, 2) / (b + c) end as mcnemar_stat,
  case when b + c < 25 then 'exact' else 'chi2_cc' end as mcnemar_kind,
  case when b + c = 0 then 1.0 when b + c < 25 then {_binom_sql('b', 'c')} end as mcnemar_p_exact,
  contrasts.model, contrasts.stage1
from cnt join contrasts using (contrast)""", "predictions", "models"),
    "joint_counts": X.with_fixtures(f"""with {PAIRS}
select contrast, gold_a as gold, pred_a, pred_b, count(*) as n from paired group by all""", "predictions", "models"),
    "bootstrap_hash_200": X.with_fixtures(f"""with {_hash_cte(HASH_REPLICATES)}, {_weighted_wide('j')},
reps as (select run_name, rep, {S.accuracy()} as acc, {S.macro_fixed()} as f1 from cm)
select run_name, count(*) as n_boot,
  round(quantile_cont(acc, 0.025), 9) as acc_ci_lo, round(quantile_cont(acc, 0.975), 9) as acc_ci_hi,
  round(quantile_cont(f1, 0.025), 9) as f1_ci_lo, round(quantile_cont(f1, 0.975), 9) as f1_ci_hi
from reps group by run_name""", "predictions"),
    "bootstrap_hash_rep0": X.with_fixtures(f"""with {_hash_cte(1)}
select run_name, rep, cast(sum(w) as bigint) as weighted_n,
  cast(sum(case when gold_label = pred_label then w else 0 end) as bigint) as weighted_correct
from j group by run_name, rep""", "predictions"),
}
