"""Merkle manifest of a document table, and proofs by a recursive query.

A row is a leaf: the hash of its fields, each ``-`` if null, else its UTF-8
length, ``:`` and the value. Per language, leaves ascend by id; runs of ``FAN``
consecutive nodes become their hash until one node, the subroot, remains. The
subroots, in the order of their language (null first, then by UTF-8 bytes),
give the root in the same way. All hashes are SHA-256; an inner node hashes the
hex text of its children.

``build`` stores every level as parent-linked node rows: the hashes of a node's
children, its parent and its place there. ``climb`` runs Spark's recursive
query: leaves ascend one link per round, append the siblings to their proof and
fold their own (perhaps tampered) hash with them. The leaves of a run have the
same siblings above it, so a run travels as one row: one proof, and a folded
hash for each of its leaves. Spark keeps the rows of every round of a recursion
until its end; sharing the proof makes them several times smaller.

Near the root a few nodes are met by all leaves. A node with at least one in
``HEAVY`` of all leaves below it is heavy. Heavy nodes are closed upwards and
each height has at most HEAVY of them, so the table of all heavy nodes has a
proven bound and is broadcast in a second climb. Below it, the first climb
joins by shuffle, and no key there has more than one in HEAVY of the rows.

Positions come from one range partitioning by (language, id, leaf, row tag): a
sorted task numbers its rows, the row counts of earlier tasks (one row per
task) are added. Texts are read once and never shuffled, only hashes are.

Defined cases: null fields hash as ``-``; a null id orders first and is never
tampered; rows equal in language and id ascend by leaf hash, and fully equal
rows are leaves of their own; a language of one row has its leaf as subroot, a
single language its subroot as root; an empty table gives an empty result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import attach, materialise

FAN = 8
HEAVY = 10_000
#: Trees of languages have numbers from 0; the tree over their subroots has this.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINK = "tree int, level int, pos long, slot int"


@dataclass
class Manifest:
    """``runs``: tree, level, ids, kids (the leaf hashes, joined), bads (what proofs fold), up
    (link to the parent node, null at the root), light (that node is not heavy).
    ``nodes``: tree, level, pos, kids (the children's hashes, joined), hash,
    leaves, up, heavy, light. ``trees``: tree, key, n, subroot. ``root`` is hex
    text, None for an empty table."""

    runs: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    rows: int


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def inner_hash(kids: Column) -> Column:
    """Hash of the hex text of joined child hashes."""
    return F.unhex(F.sha2(F.lower(F.hex(kids)), 256))


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """A stored copy of ``df`` with the 0-based position in the order of ``by``.
    ``by`` has to end in a column that tells equal rows apart."""
    tagged = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("_q_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_q_pid", F.shiftright("_q_mid", 33))
    counts = tagged.groupBy("_q_pid").agg(F.count(F.lit(1)).alias("_q_cnt"))
    before = Window.orderBy("_q_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = counts.select("_q_pid", F.coalesce(F.sum("_q_cnt").over(before), F.lit(0)).alias("_q_off"))
    own = F.col("_q_mid") - F.shiftleft("_q_pid", 33)
    return tagged.join(F.broadcast(offsets), "_q_pid").withColumn(name, F.col("_q_off") + own).drop(
        "_q_pid", "_q_mid", "_q_off")


def _link(present: Column, tree: Column, level: Column, place: Column) -> Column:
    return F.when(present, F.struct(
        tree.cast("int").alias("tree"), level.cast("int").alias("level"), F.floor(place / FAN).cast("long").alias("pos"),
        F.pmod(place, F.lit(FAN)).cast("int").alias("slot")))


def _with_link(nodes: DataFrame, trees: int) -> DataFrame:
    """``up``: within the tree while its level has several nodes, then from a
    subroot into the tree of subroots."""
    own = _link(F.col("n") > 1, F.col("tree"), F.col("level") + 1, F.col("pos"))
    over = _link((F.col("tree") != TOP) & F.lit(trees > 1), F.lit(TOP), F.lit(1), F.col("tree"))
    return nodes.withColumn("up", F.coalesce(own, over))


def _joined(hashes: Column) -> Column:
    return F.aggregate(hashes, F.unhex(F.lit("")), lambda a, h: F.concat(a, h))


def _runs(leaves: DataFrame) -> DataFrame:
    """The lowest level: tree, n (its nodes in the tree), level, pos, ids, kids,
    bads, hash, leaves. A tree of one leaf has that leaf as its node, on level 0."""
    g = leaves.groupBy("tree", "n", F.floor(F.col("pos") / FAN).cast("long").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "leaf", "bad", "id"))).alias("g"))
    runs = g.select("tree", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.when(F.col("n") > 1, 1).otherwise(0).alias("level"),
                    F.col("run").alias("pos"), F.col("g.id").alias("ids"), _joined(F.col("g.leaf")).alias("kids"),
                    F.col("g.bad").alias("bads"), F.size("g").cast("long").alias("leaves"))
    return runs.withColumn("hash", F.when(F.col("level") == 1, inner_hash(F.col("kids"))).otherwise(F.col("kids")))


def _climbed(level: DataFrame) -> DataFrame:
    """The nodes over a level: tree, n (nodes of that level in the tree), level, pos, kids, hash, leaves."""
    runs = level.where("n > 1").groupBy("tree", "n", "level", F.floor(F.col("pos") / FAN).cast("long").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("g"), F.sum("leaves").alias("leaves"))
    joined = runs.select("tree", F.ceil(F.col("n") / FAN).cast("long").alias("n"), (F.col("level") + 1).alias("level"),
                         F.col("run").alias("pos"), _joined(F.col("g.hash")).alias("kids"), "leaves")
    return joined.withColumn("hash", inner_hash(F.col("kids")))


def _tree(leaves: DataFrame, most: int) -> list[DataFrame]:
    """All levels over ``leaves`` (tree, n, level, pos, hash, leaves); ``most``: leaves of the largest tree."""
    levels, cur = [], leaves
    while most > 1:
        cur = materialise(_climbed(cur))
        levels.append(cur)
        most = -(-most // FAN)
    return levels


def build(docs: DataFrame, fields: list[str], id_col: str, group_col: str, bad: Column | None = None,
          heavy: int = HEAVY) -> Manifest:
    """The manifest of ``docs``: leaves of ``fields`` in their order, one tree
    per value of ``group_col``. ``bad``: the leaf that a proof folds instead of
    the row's own (``leaf_hash`` of changed fields)."""
    leaf = leaf_hash([F.col(f"`{c}`") for c in fields])
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("key")
    hashed = materialise(docs.select(
        F.col(f"`{id_col}`").alias("id"), key, leaf.alias("leaf"), (leaf if bad is None else bad).alias("bad"),
        F.monotonically_increasing_id().alias("tag")))
    placed = materialise(numbered(hashed, ["key", "id", "leaf", "tag"], "g").drop("tag"))
    groups = materialise(placed.groupBy("key").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")))
    trees = materialise(numbered(groups, ["key"], "tree").withColumn("tree", F.col("tree").cast("int")))
    rows, count, most = trees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.max("n")).first()
    leaves = attach(placed, trees, "key", "n", rows).select(
        "id", "tree", "n", (F.col("g") - F.col("start")).alias("pos"), "leaf", "bad")
    runs = materialise(_runs(leaves))
    levels = _tree(runs.select("tree", "n", "level", "pos", "hash", "leaves"), -(-(most or 0) // FAN))
    subroots = None
    for x in [runs, *levels]:
        x = x.where("n = 1").select("tree", "hash", "leaves")
        subroots = x if subroots is None else subroots.unionByName(x)
    subroots = materialise(subroots)
    top = subroots.select(F.lit(TOP).alias("tree"), F.lit(count).cast("long").alias("n"), F.lit(0).alias("level"),
                          F.col("tree").cast("long").alias("pos"), "hash", "leaves")
    over = _tree(top, count)
    root = (over[-1] if over else subroots).select(F.lower(F.hex("hash"))).first() if rows else None
    # The parent of a node with as many leaves below as a heavy one is heavy, too.
    least = -(-rows // heavy)
    columns = ["tree", "level", "pos", "kids", "hash", "leaves", "up"]
    nodes = None
    for x in levels + over:
        x = _with_link(x, count).select(*columns)
        nodes = x if nodes is None else nodes.unionByName(x)
    if nodes is None:
        nodes = docs.sparkSession.createDataFrame(
            [], f"tree int, level int, pos long, kids binary, hash binary, leaves long, up struct<{_LINK}>")
    nodes = materialise(nodes.withColumn("heavy", F.col("leaves") >= least))
    tops = nodes.where("heavy").select(F.struct("tree", "level", "pos").alias("top"))

    def flagged(df: DataFrame) -> DataFrame:
        """``light``: the link leads to a node that is not heavy."""
        named = F.struct("up.tree", "up.level", "up.pos")
        return df.join(F.broadcast(tops), named == F.col("top"), "left").withColumn(
            "light", F.col("up").isNotNull() & F.col("top").isNull()).drop("top")

    named = trees.join(subroots.select("tree", F.lower(F.hex("hash")).alias("subroot")), "tree")
    climbers = flagged(_with_link(runs, count).select("tree", "level", "ids", "kids", "bads", "up"))
    return Manifest(climbers, flagged(nodes), materialise(named.select("tree", "key", "n", "subroot")), root and root[0], rows)


#: One round: the link names a node and the place among its children. Every
#: hash is 32 bytes, so children before and after that place are cut by position.
#: ``limit all`` lifts Spark's default limit on the rows of a recursion.
_CLIMB = """
with recursive climb(tree, ids, kids, hashes, proof, up, light) as (
  select tree, ids, kids, hashes, proof, up, light from {start}
  union all
  select %s c.tree, c.ids, c.kids,
         transform(c.hashes, h -> unhex(sha2(lower(concat(
           hex(substring(p.kids, 1, 32 * c.up.slot)), hex(h), hex(substring(p.kids, 32 * c.up.slot + 33)))), 256))),
         concat(c.proof, substring(p.kids, 1, 32 * c.up.slot), substring(p.kids, 32 * c.up.slot + 33)),
         p.up, p.light
  from climb c join {nodes} p on p.tree = c.up.tree and p.level = c.up.level and p.pos = c.up.pos
)
select * from climb where %s limit all
"""


def _others(kids: Column, i: Column) -> Column:
    """``kids`` without its i-th hash."""
    return F.concat(F.substring(kids, F.lit(1), 32 * i), F.substring(kids, 32 * i + 33, F.length(kids)))


def climb(m: Manifest) -> DataFrame:
    """id, tree, leaf, hash (the folded root) and proof (siblings, joined): one row per leaf."""
    spark = m.runs.sparkSession

    def own(h: Column, i: Column) -> Column:
        # The lowest fold, inside the run; a lone leaf is its node itself.
        kids = F.col("kids")
        return inner_hash(F.concat(F.substring(kids, F.lit(1), 32 * i), h, F.substring(kids, 32 * i + 33, F.length(kids))))

    first = F.when(F.col("level") == 0, F.col("bads")).otherwise(F.transform("bads", own))
    start = m.runs.select("tree", "ids", "kids", first.alias("hashes"), F.unhex(F.lit("")).alias("proof"), "up", "light")
    light, heavy = (m.nodes.where(c).select("tree", "level", "pos", "kids", "up", "light")
                    for c in ("not heavy", "heavy"))
    if not light.isEmpty():
        # Up to the last light node; rows that start below a heavy one are done at once.
        start = materialise(spark.sql(_CLIMB % ("", "not light"), start=start, nodes=light))
    ends = spark.sql(_CLIMB % ("/*+ broadcast(p) */", "up is null"), start=start, nodes=heavy)
    leaf = ends.select("tree", "kids", "hashes", "proof", F.posexplode("ids").alias("i", "id"))
    return leaf.select("id", "tree", F.substring(F.col("kids"), 32 * F.col("i") + 1, F.lit(32)).alias("leaf"),
                       F.col("hashes")[F.col("i")].alias("hash"),
                       F.concat(_others(F.col("kids"), F.col("i")), "proof").alias("proof"))


def verify(m: Manifest) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root (hex text), verified."""
    up = attach(climb(m), m.trees.select("tree", "n", "subroot"), "tree", "n", m.rows)
    folded = F.lower(F.hex("hash"))
    return up.select("id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"),
                     F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"),
                     (folded == F.lit(m.root).cast("string")).alias("verified"))


def document_manifest(docs: DataFrame) -> Manifest:
    """Leaves of doc_id, source, lang, n_chars and text, a tree per lang. Where
    3 divides crc32 of the decimal id, A-Z of the text are lower-cased in the
    leaf that the proof folds."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    changed = [F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")) if c == "text" else F.col(c)
               for c in names]
    return build(docs.select(*names), names, "doc_id", "lang", bad=leaf_hash(changed))
