"""Registered queries: evaluation aggregates on the predictions view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.plans import sqlgen as S
from quarry.sources import fixtures as X


def _preds(spark, sf):
    return X.predictions(spark, sf)


QUERIES = {
    "confusion_matrix": lambda spark, sf: M.confusion_matrix(_preds(spark, sf)),
    "accuracy": lambda spark, sf: M.accuracy(_preds(spark, sf)),
    "macro_f1_fixed": lambda spark, sf: M.macro_f1_fixed(_preds(spark, sf)),
    "macro_f1_present": lambda spark, sf: M.macro_f1_present(_preds(spark, sf)),
    "best_run": lambda spark, sf: M.best_run(_preds(spark, sf)),
    "run_metrics": lambda spark, sf: M.run_metrics(_preds(spark, sf)),
    "classwise_report": lambda spark, sf: M.classwise_report(_preds(spark, sf)),
    "confusion_row_normalised": lambda spark, sf: M.confusion_row_normalised(_preds(spark, sf)),
    "per_group_metrics": lambda spark, sf: M.per_group_metrics(_preds(spark, sf), "specialty"),
    "accuracy_pivot_level": lambda spark, sf: M.accuracy_pivot(_preds(spark, sf), "level", M.LEVELS),
    "accuracy_pivot_gold": lambda spark, sf: M.accuracy_pivot(_preds(spark, sf), "gold_label", M.LETTERS),
    "accuracy_pivot_umbrella": lambda spark, sf: M.accuracy_pivot(_preds(spark, sf), "umbrella_specialty", []),
    "f1_pivot": lambda spark, sf: M.f1_pivot(_preds(spark, sf)),
    "seed_aggregates": lambda spark, sf: M.seed_aggregates(M.run_metrics(_preds(spark, sf))).select(
        "kind", "run_name", "seeds", "n_seeds",
        *[F.round(c, 9).alias(c) for c in ("accuracy", "acc_std", "macro_f1", "f1_std")]),
    "perplexity": lambda spark, sf: M.perplexity(X.token_loss(spark, sf)).select(
        "model", "variant", "n_tokens", F.round("perplexity", 6).alias("perplexity")),
    "perplexity_before_after": lambda spark, sf: M.perplexity_before_after(X.token_loss(spark, sf), "O").select(
        "model", "stage1_method", F.round("ppl_before", 6).alias("ppl_before"),
        F.round("ppl_after", 6).alias("ppl_after")),
}


_W = S.wide_cte("predictions", ["run_name"])
_LET = "(values ('A'), ('B'), ('C'), ('D'), ('E'))"

ORACLE = {
    "confusion_matrix": X.with_fixtures(f"""
with cells as (select run_name, gold_label, pred_label, count(*) as n from predictions group by all),
grid as (select r.run_name, g.l as gold_label, p.l as pred_label
         from (select distinct run_name from predictions) r, {_LET} g(l), {_LET} p(l))
select grid.run_name, grid.gold_label, grid.pred_label, coalesce(cells.n, 0) as n
from grid left join cells using (run_name, gold_label, pred_label)""", "predictions"),
    "accuracy": X.with_fixtures("""
select run_name, count(*) as n, count(*) filter (where gold_label = pred_label) as n_correct,
  cast(count(*) filter (where gold_label = pred_label) as double) / count(*) as accuracy
from predictions group by run_name""", "predictions"),
    "macro_f1_fixed": X.with_fixtures(f"with {_W} select run_name, {S.macro_fixed()} as macro_f1 from cm", "predictions"),
    "macro_f1_present": X.with_fixtures(f"with {_W} select run_name, {S.macro_present()} as macro_f1 from cm",
                                        "predictions"),
    "best_run": X.with_fixtures("""
select run_name, cast(count(*) filter (where gold_label = pred_label) as double) / count(*) as accuracy
from predictions group by run_name order by accuracy desc, run_name limit 1""", "predictions"),
    "run_metrics": X.with_fixtures(f"""with {_W}
select run_name, n, n_correct, {S.accuracy()} as accuracy, {S.macro_fixed()} as macro_f1,
  {S.macro_present()} as macro_f1_present from cm""", "predictions"),
    "classwise_report": X.with_fixtures(f"with {_W}\n" + "\nunion all\n".join(
        f"select run_name, '{L}' as letter, {S.precision(L)} as precision, {S.recall(L)} as recall, "
        f"{S.f1(L)} as f1, {S.support(L)} as support from cm" for L in S.LETTERS), "predictions"),
    "confusion_row_normalised": X.with_fixtures(f"with {_W}\n" + "\nunion all\n".join(
        f"select run_name, '{a}' as gold_label, '{b}' as pred_label, n_{a}{b} as n, "
        f"{S.safe_div(f'n_{a}{b}', S.support(a))} as share from cm"
        for a in S.LETTERS for b in S.LETTERS), "predictions"),
    "per_group_metrics": X.with_fixtures(
        f"with {S.wide_cte('predictions', ['run_name', 'specialty'])}\n"
        f"select run_name, specialty, {S.accuracy()} as accuracy, {S.macro_present()} as macro_f1, n as count from cm",
        "predictions"),
    "accuracy_pivot_level": X.with_fixtures("""
with a as (select run_name, level, count(*) filter (where gold_label = pred_label) / count(*) as acc
           from predictions group by all)
pivot a on level in ('Y1', 'Y2', 'Y3', 'Y4', 'Y5') using first(acc) group by run_name""", "predictions"),
    "accuracy_pivot_gold": X.with_fixtures("""
with a as (select run_name, gold_label, count(*) filter (where gold_label = pred_label) / count(*) as acc
           from predictions group by all)
pivot a on gold_label in ('A', 'B', 'C', 'D', 'E') using first(acc) group by run_name""", "predictions"),
    "accuracy_pivot_umbrella": X.with_fixtures("""
with a as (select run_name, umbrella_specialty, count(*) filter (where gold_label = pred_label) / count(*) as acc
           from predictions group by all)
pivot a on umbrella_specialty in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')
  using first(acc) group by run_name""", "predictions"),
    "f1_pivot": X.with_fixtures(
        f"with {_W} select run_name, " + ", ".join(f"{S.f1(L)} as {L}" for L in S.LETTERS) + " from cm",
        "predictions"),
    "seed_aggregates": X.with_fixtures(f"""with {_W},
cfg as (select run_name, {S.accuracy()} as accuracy, {S.macro_fixed()} as macro_f1 from cm),
seeded as (select regexp_extract(run_name, '^(.+)_seed(\\d+)$', 1) as base,
                  cast(regexp_extract(run_name, '^(.+)_seed(\\d+)$', 2) as bigint) as seed, accuracy, macro_f1
           from cfg where regexp_matches(run_name, '^(.+)_seed(\\d+)$')),
plain as (select run_name as base, cast(42 as bigint) as seed, accuracy, macro_f1 from cfg
          where not regexp_matches(run_name, '^(.+)_seed(\\d+)$')
            and run_name in (select base from seeded)
            and run_name not in (select base from seeded where seed = 42)),
allr as (select * from seeded union all select * from plain)
select 'seed_agg' as kind, base as run_name, array_to_string(list_sort(list(seed)), ',') as seeds,
  count(*) as n_seeds, round(avg(accuracy), 9) as accuracy, round(stddev_samp(accuracy), 9) as acc_std,
  round(avg(macro_f1), 9) as macro_f1, round(stddev_samp(macro_f1), 9) as f1_std
from allr group by base having count(*) >= 2""", "predictions"),
    "perplexity": X.with_fixtures("""
select model, variant, cast(coalesce(sum(case when n_target > 0 then n_target end), 0) as bigint) as n_tokens,
  round(case when coalesce(sum(case when n_target > 0 then n_target end), 0) = 0 then 'nan'::double
       else exp(sum(case when n_target > 0 then loss * n_target end) / sum(case when n_target > 0 then n_target end)) end, 6)
       as perplexity
from token_loss group by model, variant""", "token_loss"),
    "perplexity_before_after": X.with_fixtures("""
with p as (select model, variant,
             exp(sum(case when n_target > 0 then loss * n_target end) / sum(case when n_target > 0 then n_target end)) as ppl
           from token_loss group by model, variant)
select a.model, a.variant as stage1_method, round(b.ppl, 6) as ppl_before, round(a.ppl, 6) as ppl_after
from p a join p b on a.model = b.model and b.variant = 'O' where a.variant <> 'O'""", "token_loss"),
}
