"""Registered queries: example building and scoring (SURVEY 2.6 C1-C3, 2.7 D1-D7,
D13, 2.8 E1-E4, C5, F15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cleaning as C
from quarry.operators import examples as E
from quarry.operators import inference as I
from quarry.operators import metrics as M
from quarry.operators import scoring as R
from quarry.operators.rows import with_ordinal
from quarry.plans import sqlgen as S
from quarry.plans.cleaning import _CLEAN, _OPEN_QA, _mcq_sql, loaded_mcq, loaded_open_qa
from quarry.session import cut_lineage
from quarry.sources import evaluation as V
from quarry.sources import files as FS
from quarry.sources import fixtures as X
from quarry.sources import ordered as O
from quarry.sources.tables import table

MAX_LEN = 512
CAP = 100
SAMPLE = 10
EMBED_DIM = 64


def _oq_text(spark, sf):
    return E.build_examples(loaded_open_qa(spark, sf), "open_qa", keep=("row_idx",))


def _tokenised(spark, sf):
    return E.tokenise(_oq_text(spark, sf), "text", MAX_LEN, keep=("row_idx",))


def _pad(spark, sf):
    tok = _tokenised(spark, sf).select("row_idx", "input_ids")
    # A distributed range sort, then the partition-offset ordinal: batches
    # follow input (row_idx) order without a single-task window.
    ordered = with_ordinal(tok.orderBy("row_idx"), "pos")
    return E.pad_batches(ordered, "input_ids", 16, 0, order="pos").drop("pos")


def _lengths(spark, sf):
    tok = E.CharTokenizer()
    oq = _oq_text(spark, sf).select(F.lit("open_qa").alias("corpus"), tok.count(F.col("text")).alias("n_tokens"))
    mcq = E.build_examples(C.clean_mcq(loaded_mcq(spark, sf)), "mcq").select(
        F.lit("mcq").alias("corpus"), tok.count(F.col("text")).alias("n_tokens"))
    prof = M.token_length_profile(oq.unionByName(mcq), MAX_LEN)
    return prof.select("corpus", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "share_truncated")],
                       "max_len")


def _export(spark, sf):
    """Clean -> render -> split. The rendered corpus is the table this step
    writes anyway; it is checkpointed into the shared folder first, because
    the exact split reads its input three times (histogram, bulk, boundary)."""
    rendered = E.build_examples(C.clean_mcq(loaded_mcq(spark, sf)), "mcq", keep=("question_id",))
    return E.split_exact(cut_lineage(rendered), "question_id", 0.05, 42)


def _vocab(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    words = docs.select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return words.select("token", I.hash_value(F.col("token"), F.lit("vocab")).alias("token_id"))


def _scored(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    scored = R.score_choices(emb, lambda: R.LinearScorer(EMBED_DIM), "embedding", keep=("vec_id", "label"))
    return scored


EVAL_KEEP = ("question_id", "answer", "specialty", "umbrella_specialty", "level")


def _mcq_predictions(spark, sf, extra=()):
    """Clean MCQ -> evaluation prompt -> batched text scorer -> argmax ->
    prediction rows (the evaluation path with a built-in scorer)."""
    clean = C.clean_mcq(loaded_mcq(spark, sf))
    prompts = clean.select(*EVAL_KEEP, *extra, E.prompt_mcq(include_answer=False).alias("prompt"))
    scored = R.score_choices(prompts, R.OptionLengthScorer, "prompt", keep=(*EVAL_KEEP, *extra))
    return R.assemble_predictions(scored, R.argmax_letter(), ["question_id", "specialty", "umbrella_specialty",
                                                              "level"], extra)


def _prompt_scores(spark, sf):
    """Evaluation prompts cut to 2,048 tokens, scored in batches of like length."""
    prompts = C.clean_mcq(loaded_mcq(spark, sf)).select("question_id", E.prompt_mcq(include_answer=False).alias("prompt"))
    return R.score_prompts(prompts, R.TokenSumScorer, E.CharTokenizer, "prompt", keep=("question_id",)).drop("padded_to")


RUN = "stand-in_s1-none_s2-none"


def _stored_evaluation(spark, sf):
    """The evaluation of the multiple-choice corpus with all its sinks; returns the folder of its reports."""
    out = FS.scratch_path(spark, "evaluation")
    tokens = E.resolve_label_tokens(_vocab(spark, sf)).where("status = 'ok'").select("letter", "token_id")
    V.evaluate_run(spark, RUN, lambda: _mcq_predictions(spark, sf, ("question",)), f"{out}/report", f"{out}/predictions", tokens)
    return f"{out}/report"


def _export_both(spark, sf):
    """Both training corpora rendered, split, written as JSON lines with sizes
    counted on the write, and read back with those sizes. A rendered corpus is
    written as Parquet first: of its three reads by the split, the histogram
    reads ids only."""
    corpora = {"open_qa": (_oq_text(spark, sf), "row_idx", 0.02),
               "mcq": (E.build_examples(C.clean_mcq(loaded_mcq(spark, sf)), "mcq", keep=("question_id",)), "question_id", 0.05)}
    out = []
    for corpus, (rendered, key, share) in corpora.items():
        path = FS.scratch_path(spark, f"sft-{corpus}")
        rendered.select(F.col(key).cast("string").alias("id"), "text").write.parquet(f"{path}/rendered")
        examples = E.split_exact(spark.read.parquet(f"{path}/rendered"), "id", share, 42)
        FS.write_sft_corpus(examples, path, facts={"corpus": corpus})
        out.append(FS.read_sft_corpus(spark, path, "id string, text string, split string").select(F.lit(corpus).alias("corpus"), "*"))
    return out[0].unionByName(out[1])


def _evaluate(spark, sf):
    s = _scored(spark, sf).withColumn("question_id", F.col("vec_id").cast("string")).withColumn(
        "answer", F.substring(F.lit("ABCDE"), (F.col("label") % 5).cast("int") + 1, 1)).withColumn(
        "specialty", F.concat(F.lit("group_"), (F.col("label") % 3).cast("string")))
    preds = R.assemble_predictions(s, R.argmax_letter(), ["question_id", "specialty"])
    tokens = E.resolve_label_tokens(_vocab(spark, sf)).where("status = 'ok'").select("letter", "token_id")
    return R.eval_results(preds, token_map=tokens)


QUERIES = {
    "split_exact": lambda spark, sf: E.split_exact(
        X.mcq_raw(spark, sf).select("question_number"), "question_number", 0.05, 42),
    "split_exact_open_qa": lambda spark, sf: E.split_exact(
        loaded_open_qa(spark, sf).select("row_idx"), "row_idx", 0.02, 42),
    "cap_rows": lambda spark, sf: E.cap_rows(C.clean_mcq(loaded_mcq(spark, sf)), CAP).select(
        "question_id", "row_idx", "answer"),
    "sample_rows": lambda spark, sf: E.sample_rows(
        X.mcq_raw(spark, sf).select("question_number", "umbrella_specialty"), "question_number", SAMPLE),
    "prompt_open_qa": _oq_text,
    "prompt_mcq": lambda spark, sf: C.clean_mcq(loaded_mcq(spark, sf)).select(
        "question_id", E.prompt_mcq(include_answer=True).alias("text")),
    "prompt_mcq_eval": lambda spark, sf: C.clean_mcq(loaded_mcq(spark, sf)).select(
        "question_id", E.prompt_mcq(include_answer=False).alias("text")),
    "split_at_answer": lambda spark, sf: E.prompt_and_answer(_oq_text(spark, sf), "text").select(
        "row_idx", "prompt_text", "answer_text"),
    "build_examples": lambda spark, sf: E.build_examples(loaded_open_qa(spark, sf), "open_qa"),
    "tokenise_and_mask": _tokenised,
    "pad_batches": _pad,
    "token_length_profile": _lengths,
    "export_sft_corpus": _export,
    "export_both_corpora": _export_both,
    "resolve_label_tokens": lambda spark, sf: E.resolve_label_tokens(_vocab(spark, sf)),
    "argmax_letter": lambda spark, sf: X.choice_logits(spark, sf).select(
        "vec_id", "gold_label", R.argmax_letter().alias("pred_label")),
    "score_choices": lambda spark, sf: _scored(spark, sf).select(
        "vec_id", *[F.round(f"logit_{L}", 6).alias(f"logit_{L}") for L in M.LETTERS]),
    "active_letters": lambda spark, sf: R.active_letters(
        C.clean_mcq(loaded_mcq(spark, sf)),
        E.resolve_label_tokens(_vocab(spark, sf)).where("status = 'ok'")).select(
        F.array_join("letters", ",").alias("letters")),
    "evaluate_run": _evaluate,
    "evaluate_run_json": lambda spark, sf: V.result_rows(FS.read_eval_results(spark, f"{_stored_evaluation(spark, sf)}/results")),
    "evaluate_run_csv": lambda spark, sf: O.read_csv_quoted(spark, f"{_stored_evaluation(spark, sf)}/predictions"),
    "score_prompts": _prompt_scores,
    "evaluate_mcq_predictions": _mcq_predictions,
    "evaluate_mcq": lambda spark, sf: R.eval_results(_mcq_predictions(spark, sf)).select(
        "accuracy", "macro_f1", "total_samples"),
    "evaluate_mcq_groups": lambda spark, sf: M.per_group_metrics(_mcq_predictions(spark, sf), "specialty", ()),
}


# ---- oracle SQL ---------------------------------------------------------

def _ids(t: str) -> str:
    return (f"list_concat([1], list_transform(list_filter(string_split({t}, ''), lambda c: length(c) > 0), "
            f"lambda c: unicode(c) + 3))")


_OQ_TEXT = f"""{_OPEN_QA},
oq_text as (select row_idx, '### Question:\n' || {S.fill_strip('question')} || '\n\n' || '### Answer:\n'
              || {S.fill_strip('answer')} as text from loaded_oq)"""

_SPLIT = """
pa as (select *, case when p = 0 then 11 else length(text) - p + 1 end as cut
       from (select *, strpos(reverse(text), reverse('### Answer:\n')) as p from oq_text)),
parts as (select row_idx, text, substr(text, 1, cut) as prompt_text, substr(text, cut + 1) as answer_text from pa)"""

_TOK = f"""{_SPLIT},
ids as (select row_idx, {_ids('prompt_text')} as prompt_ids, {_ids('text')} as full_ids from parts),
cut as (select row_idx, prompt_ids, full_ids[1:{MAX_LEN}] as c from ids),
eos as (select row_idx, prompt_ids,
          case when len(c) = 0 then [2] when c[-1] = 2 then c else list_concat(c, [2])[1:{MAX_LEN}] end as input_ids
        from cut),
tok as (select row_idx, input_ids, list_transform(input_ids, lambda x: 1) as attention_mask,
          list_concat(list_transform(range(len(prompt_ids)), lambda x: -100), input_ids[len(prompt_ids) + 1:])[1:len(input_ids)]
            as labels
        from eos)"""


def _mcq_prompt(include_answer: bool) -> str:
    fs = S.fill_strip
    opts = (f"'A) ' || {fs('option_a')} || '\n' || 'B) ' || {fs('option_b')} || '\n' || 'C) ' || {fs('option_c')}"
            f" || '\n' || 'D) ' || {fs('option_d')}")
    opts = f"(case when length({fs('option_e')}) > 0 then {opts} || '\nE) ' || {fs('option_e')} else {opts} end)"
    p = f"'### Question:\n' || {fs('question')} || '\n\n' || '### Options:\n' || {opts} || '\n\n' || '### Answer:\n'"
    return f"({p} || {fs('answer')})" if include_answer else f"({p})"


def _split_sql(src: str, idc: str, frac: float) -> str:
    return (f"select {idc}, case when row_number() over (order by md5('42:' || cast({idc} as varchar)), {idc}) "
            f"<= ceil({frac} * count(*) over ()) then 'val' else 'train' end as split from {src}")


_W = "list_sum(list_transform(range({d}), lambda i: ((((3 * i + 7 * {j}) % 11) - 5) / 10.0) * cast(embedding[i + 1] as double)))"

ORACLE = {
    "split_exact": X.with_fixtures(_split_sql("mcq_raw", "question_number", 0.05), "mcq_raw"),
    "split_exact_open_qa": X.with_fixtures(f"with {_OPEN_QA} {_split_sql('loaded_oq', 'row_idx', 0.02)}",
                                           "open_qa_raw"),
    "cap_rows": X.with_fixtures(f"with {_mcq_sql()}, {_CLEAN} select question_id, row_idx, answer from clean "
                                f"order by row_idx limit {CAP}", "mcq_raw"),
    "sample_rows": X.with_fixtures(
        f"select question_number, umbrella_specialty from mcq_raw "
        f"order by md5('42:' || cast(question_number as varchar)), question_number limit {SAMPLE}", "mcq_raw"),
    "prompt_open_qa": X.with_fixtures(f"with {_OQ_TEXT} select * from oq_text", "open_qa_raw"),
    "prompt_mcq": X.with_fixtures(f"with {_mcq_sql()}, {_CLEAN} select question_id, {_mcq_prompt(True)} as text "
                                  f"from clean", "mcq_raw"),
    "prompt_mcq_eval": X.with_fixtures(f"with {_mcq_sql()}, {_CLEAN} select question_id, {_mcq_prompt(False)} as text"
                                       f" from clean", "mcq_raw"),
    "split_at_answer": X.with_fixtures(f"with {_OQ_TEXT}, {_SPLIT} select row_idx, prompt_text, answer_text from parts",
                                       "open_qa_raw"),
    "build_examples": X.with_fixtures(f"with {_OQ_TEXT} select text from oq_text", "open_qa_raw"),
    "tokenise_and_mask": X.with_fixtures(f"with {_OQ_TEXT}, {_TOK} select * from tok", "open_qa_raw"),
    "pad_batches": X.with_fixtures(f"""with {_OQ_TEXT}, {_TOK},
pos as (select row_idx, input_ids, (row_number() over (order by row_idx) - 1) // 16 as batch_id from tok),
mx as (select *, max(len(input_ids)) over (partition by batch_id) - len(input_ids) as pad from pos)
select row_idx, batch_id,
  list_concat(list_transform(range(pad), lambda x: 0), input_ids) as padded_ids,
  list_concat(list_transform(range(pad), lambda x: 0), list_transform(input_ids, lambda x: 1)) as attention_mask
from mx""", "open_qa_raw"),
    "token_length_profile": X.with_fixtures(f"""with {_OQ_TEXT}, {_mcq_sql()}, {_CLEAN},
l as (select 'open_qa' as corpus, len({_ids('text')}) as n_tokens from oq_text
      union all select 'mcq', len({_ids(_mcq_prompt(True))}) from clean)
select corpus, count(*) as n, round(quantile_cont(n_tokens, 0.5), 6) as p50,
  round(quantile_cont(n_tokens, 0.95), 6) as p95, round(quantile_cont(n_tokens, 0.99), 6) as p99,
  round(avg(case when n_tokens > {MAX_LEN} then 1.0 else 0.0 end), 6) as share_truncated,
  cast(max(n_tokens) as integer) as max_len
from l group by corpus""", "open_qa_raw", "mcq_raw"),
    "export_sft_corpus": X.with_fixtures(f"""with {_mcq_sql()}, {_CLEAN},
t as (select question_id, {_mcq_prompt(True)} as text from clean)
select question_id, text, case when row_number() over (order by md5('42:' || question_id), question_id)
  <= ceil(0.05 * count(*) over ()) then 'val' else 'train' end as split from t""", "mcq_raw"),
    "resolve_label_tokens": """
with vocab as (select distinct unnest(string_split(text, ' ')) as token from documents),
v as (select token, ('0x' || substr(md5(token || ':' || 'vocab'), 1, 8))::bigint as token_id from vocab),
cand as (select l.letter, o.ord, case when o.ord = 0 then l.letter else ' ' || l.letter end as variant
         from (values ('A'), ('B'), ('C'), ('D'), ('E')) l(letter), (values (0), (1)) o(ord)),
hit as (select c.letter, c.ord, c.variant, v.token_id from cand c join v on v.token = c.variant),
best as (select letter, arg_min(variant, ord) as variant, arg_min(token_id, ord) as token_id from hit group by letter),
allc as (select l.letter, b.variant, b.token_id from (values ('A'), ('B'), ('C'), ('D'), ('E')) l(letter)
         left join best b using (letter))
select letter, variant, token_id,
  case when token_id is null then 'missing'
       when count(*) over (partition by token_id) > 1 then 'collision' else 'ok' end as status
from allc""",
    "active_letters": None,
    "argmax_letter": X.with_fixtures("""
select vec_id, gold_label,
  substr('ABCDE', list_position([logit_A, logit_B, logit_C, logit_D, logit_E],
                                list_max([logit_A, logit_B, logit_C, logit_D, logit_E])), 1) as pred_label
from choice_logits""", "choice_logits"),
    "score_choices": "select vec_id, " + ", ".join(
        f"round({_W.format(d=EMBED_DIM, j=j)}, 6) as logit_{L}" for j, L in enumerate(M.LETTERS)) + " from embeddings",
}

_RESOLVED = ORACLE["resolve_label_tokens"].strip()
ORACLE["active_letters"] = X.with_fixtures(f"""with {_mcq_sql()}, {_CLEAN},
resolved as ({_RESOLVED})
select array_to_string(list_sort(list(distinct letter)), ',') as letters from (
  select answer as letter from clean where answer in ('A', 'B', 'C', 'D', 'E')
  union all select letter from resolved where status = 'ok')""", "mcq_raw")


def _mcq_eval_sql() -> str:
    fs = S.fill_strip
    lens = ", ".join(f"cast(length({fs('option_' + L.lower())}) as double) as logit_{L}" for L in M.LETTERS)
    arr = "[logit_A, logit_B, logit_C, logit_D, logit_E]"
    return f"""{_mcq_sql()}, {_CLEAN},
lg as (select question_id, answer, specialty, umbrella_specialty, level, {lens} from clean),
mp as (select question_id, upper({fs('answer')}) as gold_label,
         substr('ABCDE', list_position({arr}, list_max({arr})), 1) as pred_label,
         specialty, umbrella_specialty, level, logit_A, logit_B, logit_C, logit_D, logit_E from lg),
mcq_preds as (select question_id, gold_label, pred_label, pred_label = gold_label as correct, specialty,
                umbrella_specialty, level, logit_A, logit_B, logit_C, logit_D, logit_E from mp)"""


ORACLE["evaluate_mcq_predictions"] = X.with_fixtures(f"with {_mcq_eval_sql()} select * from mcq_preds", "mcq_raw")
ORACLE["evaluate_mcq"] = X.with_fixtures(f"""with {_mcq_eval_sql()},
{S.wide_cte('mcq_preds', ['1'])}
select {S.accuracy()} as accuracy, {S.macro_present()} as macro_f1, n as total_samples from cm""", "mcq_raw")
ORACLE["evaluate_mcq_groups"] = X.with_fixtures(f"""with {_mcq_eval_sql()},
{S.wide_cte('mcq_preds', ['specialty'])}
select specialty, {S.accuracy()} as accuracy, {S.macro_present()} as macro_f1, n as count from cm""", "mcq_raw")
ORACLE["evaluate_run_csv"] = X.with_fixtures(f"""with {_mcq_eval_sql()}
select nullif(question, '') as question, gold_label as reference, pred_label as prediction,
  case when correct then 'True' else 'False' end as correct, nullif(mcq_preds.specialty, '') as specialty
from mcq_preds join clean using (question_id)""", "mcq_raw")
ORACLE["evaluate_run_json"] = X.with_fixtures(f"""with {_mcq_eval_sql()},
{S.wide_cte('mcq_preds', ['1'], 'overall')},
groups as (select * replace (coalesce(specialty, 'None') as specialty) from mcq_preds),
{S.wide_cte('groups', ['specialty'], 'per_group')},
resolved as ({_RESOLVED})
select '{RUN}' as run_name, o.accuracy, o.macro_f1, o.total_samples,
  (select coalesce(string_agg(letter || '=' || token_id, ',' order by letter), '') from resolved where status = 'ok') as answer_tokens,
  specialty, {S.accuracy()} as group_accuracy, {S.macro_present()} as group_macro_f1, n as group_count
from per_group, (select {S.accuracy()} as accuracy, {S.macro_present()} as macro_f1, n as total_samples from overall) o""", "mcq_raw")
ORACLE["score_prompts"] = X.with_fixtures(f"""with {_mcq_sql()}, {_CLEAN},
ids as (select question_id, {_ids(_mcq_prompt(False))}[1:{R.PROMPT_TOKENS}] as ids from clean)
select question_id, cast(len(ids) as integer) as n_tokens, """ + ", ".join(
    f"cast(list_sum(list_transform(ids, lambda i: (i * {2 * j + 3}) % 97)) as double) as logit_{L}" for j, L in enumerate(M.LETTERS))
    + " from ids", "mcq_raw")
ORACLE["export_both_corpora"] = X.with_fixtures(f"""with {_OQ_TEXT}, {_mcq_sql()}, {_CLEAN},
t as (select 'open_qa' as corpus, cast(row_idx as varchar) as id, text, 0.02 as share from oq_text
  union all select 'mcq', cast(question_id as varchar), {_mcq_prompt(True)}, 0.05 from clean),
s as (select corpus, id, text, case when row_number() over (partition by corpus order by md5('42:' || id), id)
        <= ceil(share * count(*) over (partition by corpus)) then 'val' else 'train' end as split from t)
select *, count(*) over (partition by corpus, split) as split_samples from s""", "open_qa_raw", "mcq_raw")
