"""Registered queries: loading and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import catalog as K
from quarry.operators import cleaning as C
from quarry.plans import sqlgen as S
from quarry.sources import fixtures as X
from quarry.sources.tables import table

# The fixture already uses standard lower-case names.
FIXTURE_MCQ_COLUMNS = {c: c for c in (
    "question", "option_a", "option_b", "option_c", "option_d", "option_e", "answer",
    "specialty", "umbrella_specialty", "level")}


def loaded_mcq(spark, sf):
    raw = X.mcq_raw(spark, sf)
    return C.load_mcq(raw, order="question_number", natural="question_number", mapping=FIXTURE_MCQ_COLUMNS)


def loaded_open_qa(spark, sf):
    raw = X.open_qa_raw(spark, sf)
    return C.load_open_qa(raw, "question_description", "question_title", "answer_details_1", keep=("row_idx",))


def _overview(spark, sf):
    """Dataset sizes from one pass per source: the open-QA raw and loaded
    counts in one aggregation, the MCQ raw and clean counts from the cleaning
    counters (one aggregation); the four size rows are a generator, no union
    of separate scans."""
    oq = X.open_qa_raw(spark, sf)
    q = C.coalesce_question("question_description", "question_title")
    a = T.fill_strip("answer_details_1")
    oq_sizes = oq.agg(F.count(F.lit(1)).alias("raw"),
                      F.count_if((F.length(q) > 0) & (F.length(a) > 0)).alias("loaded"))
    counters = C.clean_mcq_with_counters(loaded_mcq(spark, sf))
    sizes = oq_sizes.select(F.inline(F.array(
        F.struct(F.lit("open_qa").alias("dataset"), F.lit("train_raw").alias("split"), F.col("raw").alias("samples")),
        F.struct(F.lit("open_qa").alias("dataset"), F.lit("train").alias("split"), F.col("loaded").alias("samples"))
    ))).unionByName(counters.select(F.inline(F.array(
        F.struct(F.lit("mcq").alias("dataset"), F.lit("train_raw").alias("split"), F.col("original").alias("samples")),
        F.struct(F.lit("mcq").alias("dataset"), F.lit("train_clean").alias("split"), F.col("final").alias("samples"))))))
    return C.dataset_overview(sizes)


def _profile(spark, sf):
    d = X.mcq_raw(spark, sf)
    n_cols = len(d.columns)
    return d.groupBy("umbrella_specialty").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("umbrella_specialty").alias("value"), "n",
        d.select(F.count(F.lit(1))).scalar().alias("total_rows"),
        F.lit(n_cols).alias("total_columns"))


QUERIES = {
    "load_mcq": loaded_mcq,
    "assign_question_id": lambda spark, sf: C.assign_question_id(
        table(spark, sf, "documents").select("doc_id", "lang"), natural="lang").select("doc_id", "question_id"),
    "load_open_qa": loaded_open_qa,
    "normalize_answer": lambda spark, sf: X.mcq_raw(spark, sf).select(
        "question_number", "answer", T.normalize_answer("answer").alias("answer_clean"),
        T.reject_reason("answer").alias("reason")),
    "clean_mcq": lambda spark, sf: C.clean_mcq(loaded_mcq(spark, sf)),
    "clean_mcq_with_counters": lambda spark, sf: C.clean_mcq_with_counters(loaded_mcq(spark, sf)),
    "label_domain_violations": lambda spark, sf: C.label_domain_violations(
        loaded_mcq(spark, sf), ["answer"]),
    "dedupe_run_log": lambda spark, sf: K.dedupe_run_log(X.run_log(spark, sf)),
    "dataset_overview": _overview,
    "profile_table": _profile,
}


def _mcq_sql() -> str:
    fs = S.fill_strip
    return f"""
mcq as (select case when (select count(*) - count(question_number) <= 1
                             and count(question_number) = count(distinct question_number) from mcq_raw)
                    then cast(question_number as varchar) end as question_id,
          question_number as row_idx,
          {fs('question')} as question, {fs('option_a')} as option_a, {fs('option_b')} as option_b,
          {fs('option_c')} as option_c, {fs('option_d')} as option_d, {fs('option_e')} as option_e,
          {fs('answer')} as answer, specialty, umbrella_specialty, level
        from mcq_raw)"""


def _steps_sql() -> str:
    na = S.normalize_answer("answer")
    return f"""
steps as (select * replace ({na} as answer),
            case when {na} is null then 'invalid_answer'
                 when length({S.fill_strip('question')}) = 0 then 'empty_question'
                 when {na} = 'E' and length({S.fill_strip('option_e')}) = 0 then 'missing_option_e' end as step
          from mcq)"""


_CLEAN = f"""{_steps_sql()},
clean as (select * exclude (step) from steps where step is null
          qualify row_number() over (partition by question order by row_idx) = 1)"""

_OPEN_QA = f"""
oq as (select row_idx, {S.strip("coalesce(question_description, question_title, '')")} as question,
         {S.fill_strip('answer_details_1')} as answer from open_qa_raw),
loaded_oq as (select * from oq where length(question) > 0 and length(answer) > 0)"""

ORACLE = {
    "load_mcq": X.with_fixtures(f"with {_mcq_sql()} select * from mcq", "mcq_raw"),
    "assign_question_id": """
select doc_id, case when (select count(*) - count(lang) <= 1 and count(lang) = count(distinct lang) from documents)
                    then lang else cast(row_number() over (order by doc_id) - 1 as varchar) end as question_id
from documents""",
    "load_open_qa": X.with_fixtures(f"with {_OPEN_QA} select * from loaded_oq", "open_qa_raw"),
    "normalize_answer": X.with_fixtures(
        f"select question_number, answer, {S.normalize_answer('answer')} as answer_clean, "
        f"{S.reject_reason('answer')} as reason from mcq_raw", "mcq_raw"),
    "clean_mcq": X.with_fixtures(f"with {_mcq_sql()}, {_CLEAN} select * from clean", "mcq_raw"),
    "clean_mcq_with_counters": X.with_fixtures(f"""with {_mcq_sql()}, {_steps_sql()}
select count(*) as original, count(*) filter (where step = 'invalid_answer') as invalid_answers,
  count(*) filter (where step = 'empty_question') as empty_questions,
  count(*) filter (where step = 'missing_option_e') as missing_option_e,
  count(*) filter (where step is null) - count(distinct case when step is null then question end) as duplicates,
  count(*) - count(distinct case when step is null then question end) as total_removed,
  count(distinct case when step is null then question end) as final
from steps""", "mcq_raw"),
    "label_domain_violations": X.with_fixtures(f"""with {_mcq_sql()}
select 'answer' as "column", answer as bad_value, count(*) as n_bad
from mcq where answer is null or answer not in ('A', 'B', 'C', 'D', 'E') group by answer""", "mcq_raw"),
    "dedupe_run_log": X.with_fixtures("""
select * from run_log
qualify row_number() over (partition by run_name order by
  case when state = 'finished' and accuracy is not null then 0 when state = 'finished' then 1 else 2 end,
  event_id) = 1""", "run_log"),
    "dataset_overview": X.with_fixtures(f"""with {_OPEN_QA}, {_mcq_sql()}, {_CLEAN},
sizes as (select 'open_qa' as dataset, 'train_raw' as split, count(*) as samples from open_qa_raw
  union all select 'open_qa', 'train', count(*) from loaded_oq
  union all select 'mcq', 'train_raw', count(*) from mcq
  union all select 'mcq', 'train_clean', count(*) from clean)
select s.dataset, s.split, s.samples,
  case when s.split = 'train_clean' then r.samples - s.samples end as removed,
  round(case when s.split = 'train_clean' then (r.samples - s.samples) * 100.0 / r.samples end, 2) as removal_pct
from sizes s left join sizes r on r.dataset = s.dataset and r.split = 'train_raw'""", "open_qa_raw", "mcq_raw"),
    "profile_table": X.with_fixtures("""
select umbrella_specialty as value, count(*) as n, cast(sum(count(*)) over () as bigint) as total_rows, 11 as total_columns
from mcq_raw group by umbrella_specialty""", "mcq_raw"),
}
