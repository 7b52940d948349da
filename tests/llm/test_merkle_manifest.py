import hashlib
import zlib

from pyspark.sql import functions as F

from quarry.llm.merkle_manifest import build, document_manifest, leaf_hash, verify
from tests.llm.conftest import bag

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(t):
    return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i: i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, pos):
    """(before, after) of each level above ``pos``."""
    for nodes in tree[:-1]:
        run = pos // 8 * 8
        yield nodes[run:pos], nodes[pos + 1: run + 8]
        pos //= 8


def brute(rows):
    groups = {}
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        own = leaf([r[c] for c in FIELDS])
        changed = leaf([lowered(r[c]) if c == "text" and bad else r[c] for c in FIELDS])
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, own, changed, r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[g])]) for g in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for i, g in enumerate(order):
        for pos, (_, _, own, changed, doc_id) in enumerate(sorted(groups[g])):
            proof, folded = "", changed
            for before, after in [*path(trees[i], pos), *path(top, i)]:
                proof += "".join(before + after)
                folded = h("".join([*before, folded, *after]))
            root = top[-1][0]
            out.append((doc_id, own, trees[i][-1][0], root, h(proof), folded, folded == root))
    return bag(out)


def found(manifest):
    return bag(tuple(r) for r in verify(manifest).collect())


def test_whole_table(docs):
    want = brute(docs.collect())
    got = found(document_manifest(docs))
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_light_and_heavy_climbs_agree(docs):
    """With room for one heavy node per height, most links are climbed by shuffle."""
    bad = leaf_hash([F.lower(c) if c == "text" else F.col(c) for c in FIELDS])
    parts = [build(docs, list(FIELDS), "doc_id", "lang", bad, heavy=n) for n in (1, 10_000)]
    assert not parts[0].nodes.where("light").isEmpty()
    assert found(parts[0]) == found(parts[1])
    for m, n in zip(parts, (1, 10_000), strict=True):
        # The bound of the broadcast: at every height at most n heavy nodes.
        most = m.nodes.where("heavy").groupBy("level").count().agg(F.max("count")).first()[0] or 0
        assert most <= 2 * n


def test_lone_leaf_one_language_and_empty(spark, empty):
    one = spark.createDataFrame([(3, "S", None, 1, "AbC")], "doc_id long, source string, lang string, n_chars long, text string")
    assert found(document_manifest(one)) == brute(one.collect())
    same = spark.createDataFrame([(i // 2, "s", "en", 1, f"T{i}") for i in range(70)], one.schema)
    assert found(document_manifest(same)) == brute(same.collect())
    copies = spark.createDataFrame([(7, "s", "en", 1, "T")] * 100 + [(8, "s", "de", 1, "")], one.schema)
    assert found(document_manifest(copies)) == brute(copies.collect())
    assert found(document_manifest(empty)) == []


def test_many_languages(spark):
    rows = [(i, "s", f"l{i % 83:03d}" if i % 83 else None, i, f"Text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(document_manifest(df)) == brute(df.collect())


def test_clashing_columns(clash, docs):
    extra = clash.withColumn("tree", F.lit(1)).withColumn("key", F.lit("k")).withColumn("hash", F.lit("h"))
    assert found(document_manifest(extra)) == found(document_manifest(docs))


def test_long_text_and_no_python_worker(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "A" * 5_000_000), (6, "s", "en", 1, "Bé" * 1_000_000)],
                               "doc_id long, source string, lang string, n_chars long, text string")
    assert found(document_manifest(df)) == brute(df.collect())
