"""Registered queries of the pipeline operators: key -> (spark, sf_dir) ->
DataFrame, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.rule_ensemble import classify

    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return classify(documents(spark, sf_dir, "doc_id", "text"), labels)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.exact_dedup import dedup_groups

    return dedup_groups(documents(spark, sf_dir, "doc_id", "text")).drop("text_hash")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.histogram_shards import shard_documents

    return shard_documents(documents(spark, sf_dir, "doc_id", "text"), shards=40)


def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secret_links import digest, find_secrets

    return digest(find_secrets(documents(spark, sf_dir, "doc_id", "text"), reach=None))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.dp_packing import digest, pack

    docs = documents(spark, sf_dir, "doc_id", "text")
    return digest(pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, length=2048))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.robust_outliers import digest, judge

    return digest(judge(documents(spark, sf_dir, "doc_id", "lang", "source", "text")))


def op7_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.duckdb_bpe import encode_decode_digest

    docs = documents(spark, sf_dir, "doc_id", "text")
    return encode_decode_digest(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_zstd_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.zstd_ids import digest, round_trip

    return digest(round_trip(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op5_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash_gph import digest, near_duplicates

    return digest(near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3, distance=2))


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii_anchors import digest, find_private

    return digest(find_private(documents(spark, sf_dir, "doc_id", "text")))


def op11_ptolemy_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.ptolemy_kmeans import cluster_vectors

    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return cluster_vectors(vectors, k=8, rounds=10, seed=3, size=64)


def op12_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.merkle_manifest import document_manifest, verify

    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    return verify(document_manifest(docs)).withColumnRenamed("id", "doc_id")


def op13_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.kernel_langid import identify

    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


QUERIES = {f.__name__: f for f in (
    op1_rule_ensemble, op2_exact_dedup, op3_histogram_shards, op4_dp_packing, op5_simhash_gph, op6_robust_outliers,
    op7_duckdb_bpe, op8_zstd_ids, op9_pii_anchors, op10_secret_links, op11_ptolemy_kmeans,
    op12_merkle_climb, op13_kernel_langid)}

#: Equal texts are grouped by the normalised text itself: SQL needs no hash.
_OP2_SQL = r"""
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept,
       sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') as t from documents)
window g as (partition by t)
"""

#: A round joins all vectors with all centroids: SQL needs no bounds. ``d * 8 + j`` orders by distance, then number.
_OP11_SQL = """
with recursive
vecs as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
km as (
  select 0 as round, (row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1)::bigint as j, v as c
  from vecs qualify j < 8
  union all
  (with near as (
     select v.rid, any_value(v.v) as v,
            (min(list_sum(list_transform(list_zip(v.v, km.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 8
                 + km.j) % 8)::bigint as j
     from vecs v, km where km.round < 10 group by v.rid),
   parts as (select j, unnest(v) as x, unnest(range(1, 65)) as i from near),
   sums as (select j, i, sum(x)::hugeint as s, count(*)::hugeint as n from parts group by j, i),
   fresh as (select j, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from sums group by j)
   select km.round + 1, km.j, coalesce(fresh.c, km.c) from km left join fresh on fresh.j = km.j where km.round < 10)),
ends as (
  select v.rid, any_value(v.vec_id) as vec_id,
         min(list_sum(list_transform(list_zip(v.v, km.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 8
             + km.j) as best
  from vecs v, km where km.round = 10 group by v.rid),
found as (select vec_id, (best % 8)::int as cluster, (best // 8)::bigint as distance from ends)
select f.vec_id, f.cluster, f.distance, (sum(f.distance) over (partition by f.cluster))::bigint as cluster_inertia,
       (sum(f.distance) over ())::bigint as inertia, sha256(array_to_string(km.c, ',')) as centroid_sha256
from found f join km on km.round = 10 and km.j = f.cluster
"""

#: Levels by a recursion over whole levels, a climb per leaf by a second one. CRC-32 is written out bit by bit.
_OP12_SQL = """
with recursive
docs as (
  select row_number() over () as rid, doc_id, lang, source, n_chars, text,
         list_reduce(list_prepend(4294967295::bigint, list_transform(
             range(1, length(doc_id::text) + 1), lambda i: ascii(substr(doc_id::text, i, 1))::bigint)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from documents),
fields as (
  select rid, doc_id, lang, xor(crc, 4294967295) % 3 = 0 as tampered, text,
         coalesce(strlen(doc_id::text) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::text) || ':' || n_chars, '-') as head
  from docs),
leaves as (
  select rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when tampered then sha256(head || coalesce(strlen(text) || ':' || translate(text,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as bad
  from fields),
placed as (
  select rid, doc_id, dense_rank() over (order by encode(lang) nulls first) - 1 as tree, leaf, coalesce(bad, leaf) as bad,
         row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 as pos,
         count(*) over (partition by lang) as n
  from leaves),
levels as (
  select tree, 0 as level, pos, n, leaf as h from placed
  union all
  select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from levels where n > 1
  group by tree, level, pos // 8, n),
subroots as (select tree, h as subroot from levels where n = 1),
tops as (
  select 0 as level, tree as pos, (select count(*) from subroots) as n, subroot as h from subroots
  union all
  select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from tops where n > 1
  group by level, pos // 8, n),
runs as (
  select tree, level, pos // 8 as run, n, list(h order by pos) as kids from levels where n > 1 group by all
  union all
  select -1, level, pos // 8, n, list(h order by pos) from tops where n > 1 group by all),
parents as (
  select r.*, r.n <= 8 and r.tree >= 0 as last from runs r),
climb as (
  select p.rid, case when p.n = 1 then -1 else p.tree end as tree, 0 as level,
         case when p.n = 1 then p.tree else p.pos end as pos, p.bad as h, '' as proof
  from placed p
  union all
  select c.rid, case when p.last then -1 else c.tree end, case when p.last then 0 else c.level + 1 end,
         case when p.last then c.tree else c.pos // 8 end,
         sha256(array_to_string(p.kids[:c.pos % 8] || [c.h] || p.kids[c.pos % 8 + 2:], '')),
         c.proof || array_to_string(p.kids[:c.pos % 8] || p.kids[c.pos % 8 + 2:], '')
  from climb c join parents p on p.tree = c.tree and p.level = c.level and p.run = c.pos // 8),
ends as (select rid, arg_max(h, length(proof)) as h, max(proof) as proof from climb group by rid)
select p.doc_id, p.leaf, s.subroot, t.h as root, sha256(e.proof) as proof_sha256, e.h as folded_root,
       e.h = t.h as verified
from placed p join ends e using (rid) join subroots s using (tree), (select h from tops where n = 1) t
"""

ORACLE: dict[str, str] = {"op2_exact_dedup": _OP2_SQL, "op11_ptolemy_kmeans": _OP11_SQL,
                          "op12_merkle_climb": _OP12_SQL}
