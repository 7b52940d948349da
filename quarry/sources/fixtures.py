"""Views over the driver tables shaped like the pipeline's real inputs.

The experiment pipeline consumes a raw multiple-choice table, an open-QA
table, per-run prediction files, per-example token losses, a tracker run log
and choice logits. The driver ships TPC-H-style tables instead, so each input
is derived from them with plain column expressions (FIXTURES.md, part 2).
Each builder has a twin SQL text (``FIXTURE_SQL``) used as a CTE by the DuckDB
oracle, so both engines read exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

# The prediction runs of the fixture (index, run name, percent
# of questions answered with the gold letter).
PREDICTION_RUNS = [
    (0, "alpha-8b_s1-none_s2-none", 38),
    (1, "alpha-8b_s1-none_s2-lora", 50),
    (2, "alpha-8b_s1-none_s2-full", 52),
    (3, "alpha-8b_s1-lora_s2-lora", 46),
    (4, "alpha-8b_s1-lora_s2-full", 51),
    (5, "alpha-8b_s1-none_s2-lora_seed1337", 51),
    (6, "alpha-8b_s1-none_s2-lora_seed2024", 49),
    (7, "alpha-8b_s1-none_s2-lora_r32", 52),
    (8, "beta-8b_s1-none_s2-none", 42),
    (9, "beta-8b_s1-none_s2-lora", 50),
    (10, "beta-8b_s1-none_s2-full", 50),
    (11, "beta-8b_s1-lora_s2-none", 27),
]

# Model dimension of the fixture (model id, short name used in
# run names, existing model, model added later).
MODELS = [
    ("org/alpha-8B", "alpha-8b", True, False),
    ("org/beta-8B", "beta-8b", True, False),
    ("org/gamma-7B", "gamma-7b", False, True),
]

# Raw answer cells of the MCQ fixture, by doc_id % 16.
RAW_ANSWERS = [
    "A", "b", " C ", "D.", "E", "A+B", "C or D", "AorB", "F", "?", None,
    "None of the above", "e ", "C, A", "B", "D",
]


def models(spark: SparkSession) -> DataFrame:
    """Model registry as a dimension table (a handful of rows)."""
    return spark.createDataFrame(MODELS, "model_id string, short_name string, existing boolean, new boolean")


def _letter(code: Column) -> Column:
    """0..4 -> 'A'..'E' (same text as substr('ABCDE', code + 1, 1))."""
    return F.substring(F.lit("ABCDE"), code.cast("int") + 1, 1)


def _str(c: Column) -> Column:
    return c.cast("string")


def mcq_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    doc, n = F.col("doc_id"), F.col("n_chars")
    answer = F.lit(None).cast("string")
    for k in range(len(RAW_ANSWERS) - 1, -1, -1):
        answer = F.when(doc % 16 == k, F.lit(RAW_ANSWERS[k])).otherwise(answer)
    return d.select(
        doc.alias("question_number"),
        F.when(doc % 50 == 7, F.lit("   ")).when(doc % 50 == 8, F.lit(None))
        .otherwise(F.col("text")).alias("question"),
        F.concat(F.lit("a"), _str(doc % 7)).alias("option_a"),
        F.concat(F.lit("b"), _str(doc % 11)).alias("option_b"),
        F.lit("c").alias("option_c"),
        F.lit("d").alias("option_d"),
        F.when(n % 3 == 0, F.lit(None).cast("string")).when(n % 3 == 1, F.lit("  "))
        .otherwise(F.concat(F.lit("e"), _str(doc % 5))).alias("option_e"),
        answer.alias("answer"),
        F.col("source").alias("specialty"),
        F.col("lang").alias("umbrella_specialty"),
        F.concat(F.lit("Y"), _str(1 + n % 5)).alias("level"),
    )


def open_qa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = conv.where(F.col("role") == "user").alias("u")
    a = conv.where(F.col("role") == "assistant").alias("a")
    # Reply = the assistant turn right after the user turn: an equi-join on
    # (conv_id, turn + 1), shuffled on conv_id only once per side.
    j = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1), "left")
    cid, turn = F.col("u.conv_id"), F.col("u.turn")
    return j.select(
        (cid * 100 + turn).alias("row_idx"),
        F.concat(F.lit("title "), _str(cid)).alias("question_title"),
        F.when((cid + turn) % 5 == 0, F.lit(None).cast("string"))
        .when((cid + turn) % 7 == 0, F.lit("   "))
        .otherwise(F.col("u.text")).alias("question_description"),
        F.when(cid % 9 == 0, F.lit("")).otherwise(F.col("a.text")).alias("answer_details_1"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 runs x every order. The run dimension is a literal array exploded per
    row (a generator, no cross join); at scale the real table is read from
    parquet partitioned by ``run_name`` instead (``sources.files``)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    # Each order fans out to 12 rows. The given file is a single split: dealing
    # its four narrow columns is cheaper than the fan-out in one task.
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    runs = F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(name).alias("run_name"), F.lit(pct).alias("pct"))
        for i, name, pct in PREDICTION_RUNS
    ])
    t = o.select("*", F.explode(runs).alias("r"))
    g = F.col("o_custkey") % 5
    u = (F.col("o_orderkey") * 7919 + F.col("r.idx") * 104729 + F.col("o_custkey") * 31) % 100
    pred = F.when(u < F.col("r.pct"), g).otherwise((g + 1 + u % 4) % 5)
    return t.select(
        F.col("r.run_name").alias("run_name"),
        F.col("o_orderkey").alias("question_id"),
        _letter(g).alias("gold_label"),
        _letter(pred).alias("pred_label"),
        F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_orderstatus")).alias("specialty"),
        F.col("o_orderpriority").alias("umbrella_specialty"),
        F.concat(F.lit("Y"), _str(1 + F.col("o_orderkey") % 5)).alias("level"),
    )


def token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("example_id"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("variant"),
        (F.col("l_quantity").cast("bigint") % 8).alias("n_target"),
        (F.col("l_discount") * 40 + F.col("l_tax")).alias("loss"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    et = F.col("event_type")
    state = (F.when(et == "purchase", "finished").when(et == "signup", "finished")
             .when(et == "error", "failed").when(et == "click", "crashed").otherwise("running"))
    return ev.select(
        "event_id",
        F.concat(F.lit("run_"), _str(F.col("user_id"))).alias("run_name"),
        state.alias("state"),
        F.when(et == "purchase", F.col("value")).alias("accuracy"),
    )


# Finished runs of the sweep fixture. The first model has every candidate; the second lacks a dropout run.
SWEEP_RUNS = [f"{m}_s1-none_s2-lora{v}" for m, values in (
    ("alpha-8b", ("", "_r8", "_r32", "_r64", "_lr1e-4", "_lr4e-4", "_do0.0", "_do0.1")),
    ("beta-8b", ("", "_r8", "_r32", "_r64", "_lr1e-4", "_lr4e-4", "_do0.0"))) for v in values]


def sweep_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per answered question of a finished sweep run: (run_name, correct)."""
    names = F.array(*[F.lit(n) for n in SWEEP_RUNS])
    li = table(spark, sf_dir, "lineitem")
    return li.select(names[(F.col("l_orderkey") % len(SWEEP_RUNS)).cast("int")].alias("run_name"),
                     ((F.col("l_partkey") + F.col("l_suppkey")) % 7 < 3).alias("correct"))


def choice_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    cols = [F.element_at("embedding", i + 1).cast("double").alias(f"logit_{L}")
            for i, L in enumerate("ABCDE")]
    return e.select("vec_id", *cols, _letter(F.col("label") % 5).alias("gold_label"))


# --------------------------------------------------------------------------
# The same views as DuckDB SQL (oracle side). Text from FIXTURES.md.
# --------------------------------------------------------------------------

_RUNS_VALUES = ", ".join(f"({i},'{n}',{p})" for i, n, p in PREDICTION_RUNS)
_ANSWER_CASE = " ".join(
    f"when {k} then {'null' if v is None else repr(v)}" for k, v in enumerate(RAW_ANSWERS)
)

_MODEL_VALUES = ", ".join(f"('{a}', '{b}', {str(c).lower()}, {str(d).lower()})" for a, b, c, d in MODELS)

FIXTURE_SQL = {
    "models": f"select * from (values {_MODEL_VALUES}) as t(model_id, short_name, existing, new)",
    "mcq_raw": f"""
select doc_id as question_number,
  case when doc_id % 50 = 7 then '   ' when doc_id % 50 = 8 then null else text end as question,
  'a' || cast(doc_id % 7 as varchar) as option_a, 'b' || cast(doc_id % 11 as varchar) as option_b,
  'c' as option_c, 'd' as option_d,
  case when n_chars % 3 = 0 then null when n_chars % 3 = 1 then '  ' else 'e' || cast(doc_id % 5 as varchar) end as option_e,
  case doc_id % 16 {_ANSWER_CASE} end as answer,
  source as specialty, lang as umbrella_specialty, 'Y' || cast(1 + n_chars % 5 as varchar) as level
from documents""",
    "open_qa_raw": """
select u.conv_id * 100 + u.turn as row_idx, 'title ' || cast(u.conv_id as varchar) as question_title,
  case when (u.conv_id + u.turn) % 5 = 0 then null when (u.conv_id + u.turn) % 7 = 0 then '   ' else u.text end as question_description,
  case when u.conv_id % 9 = 0 then '' else a.text end as answer_details_1
from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'""",
    "predictions": f"""
select run_name, question_id, substr('ABCDE', cast(g as int) + 1, 1) as gold_label,
  substr('ABCDE', cast(case when u < pct then g else (g + 1 + u % 4) % 5 end as int) + 1, 1) as pred_label,
  specialty, umbrella_specialty, level
from (select r.run_name, r.pct, o.o_orderkey as question_id, o.o_custkey % 5 as g,
    (o.o_orderkey * 7919 + r.idx * 104729 + o.o_custkey * 31) % 100 as u,
    o.o_orderpriority || '/' || o.o_orderstatus as specialty, o.o_orderpriority as umbrella_specialty,
    'Y' || cast(1 + o.o_orderkey % 5 as varchar) as level
  from orders o cross join (values {_RUNS_VALUES}) as r(idx, run_name, pct)) t""",
    "token_loss": """
select l_orderkey as example_id, l_returnflag as model, l_linestatus as variant,
  cast(l_quantity as bigint) % 8 as n_target, l_discount * 40 + l_tax as loss
from lineitem""",
    "run_log": """
select event_id, 'run_' || cast(user_id as varchar) as run_name,
  case event_type when 'purchase' then 'finished' when 'signup' then 'finished' when 'error' then 'failed'
    when 'click' then 'crashed' else 'running' end as state,
  case when event_type = 'purchase' then value end as accuracy
from events""",
    "sweep_results": f"""
select [{', '.join(f"'{n}'" for n in SWEEP_RUNS)}][1 + l_orderkey % {len(SWEEP_RUNS)}] as run_name,
  (l_partkey + l_suppkey) % 7 < 3 as correct
from lineitem""",
    "choice_logits": """
select vec_id, cast(embedding[1] as double) as logit_A, cast(embedding[2] as double) as logit_B,
  cast(embedding[3] as double) as logit_C, cast(embedding[4] as double) as logit_D,
  cast(embedding[5] as double) as logit_E, substr('ABCDE', label % 5 + 1, 1) as gold_label
from embeddings""",
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture views as CTEs."""
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]}\n)" for n in names)
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
