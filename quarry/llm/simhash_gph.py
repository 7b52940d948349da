"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words outside ``[\\x20\\x09-\\x0D]``, every shingle
of ``shingle`` words joined by spaces (fewer words: the whole sequence; none: 0),
hashed with XXH64, seed 42; a bit is 1 when set in over half of the hashes.
Fingerprints link at ``distance`` or fewer differing bits; a class is a
connected component.

Search, on distinct fingerprints only, so copies are never expanded:

1. ``correlated_parts``: bit pair counts over all fingerprints (one 64 x 64 table)
   group correlated bits into parts.
2. A pair within ``distance`` D over m parts differs in at most T_i bits in some
   part, for any thresholds with sum D - m + 1. ``allocate`` picks them for each
   fingerprint by dynamic programming over the parts: T_i = -1 skips a part, and
   the cost is the estimated number of candidates and probes. The number of
   fingerprints that share a part's value is counted; of neighbouring values it
   is estimated from the bit frequencies.
3. Each fingerprint probes the chosen neighbourhood of its part values, and
   every candidate is verified by its bit distance.
4. Values that more than ``BUCKET`` fingerprints share are not paired. Their
   members, and whoever probes them, meet at midpoints instead: two fingerprints
   differ in at most 2 bits exactly when they share a point among themselves and
   their 64 one-bit flips (in general D is even and D / 2 bits flip). A point has
   few members by construction, and each links to the smallest one.
5. Links are contracted to components (``connected_components``).

Defined cases: a null text counts as empty (fingerprint 0, linked like any
other); a null id belongs to its class but never names it unless all ids are
null; repeated rows share a class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, connected_components, keep_rows, materialise

SEED = 42
PARTS = 3
#: Fingerprints of one part value that are paired with a probe.
BUCKET = 64
#: Cost of a probe relative to a candidate.
PROBE_COST = 0.25
#: Hashes that are counted at once.
COUNT_STEP = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64 bits of a whole text, unsigned."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        pieces = [line]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        last = begin[shingle - 1:] + size[shingle - 1:]
        pieces = [line[a:b] for a, b in zip(begin[: len(last)].tolist(), last.tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_STEP):
        part = hashes[at: at + COUNT_STEP].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, text_hash and fp (the 64 bits as a signed long) per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp)],
                                             names=["doc_id", "rid", "text_hash", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                       F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, rid long, text_hash long, fp long")


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each pair of bits is set together (diagonal: each bit), over
    all fingerprints, and their number."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((64, 64)), 0
        for f in frames:
            x = np.unpackbits(f["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        i, j = np.meshgrid(range(64), range(64), indexing="ij")
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "c": both.ravel().astype(np.int64), "n": n})

    out, n = np.zeros((64, 64)), 0
    for r in fps.mapInPandas(run, "i int, j int, c long, n long").groupBy("i", "j").agg(
            F.sum("c").alias("c"), F.sum("n").alias("n")).collect():  # 4096 rows whatever the input
        out[r["i"], r["j"]], n = r["c"], r["n"]
    return out, n


def correlated_parts(both: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each bit joins the group
    with whose bits it is most correlated."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def neighbour_masks(bits: list[int], distance: int) -> list[int]:
    """XOR masks that flip at most ``distance`` of the bits."""
    return [_mask(c) for k in range(distance + 1) for c in combinations(bits, k)]


def allocate(shared: np.ndarray, values: np.ndarray, p: np.ndarray, groups: list[list[int]], n: int,
             distance: int) -> np.ndarray:
    """Thresholds per fingerprint (rows) and part, each from -1 to ``distance``,
    with sum ``distance`` - parts + 1 and the least estimated cost.

    ``shared``: fingerprints with the same value of a part; ``values``: the
    fingerprints; ``p``: share of fingerprints with each bit set.
    """
    rows, m = shared.shape
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    clipped = np.clip(p, 0.01, 0.99)
    levels = distance + 2  # threshold + 1: 0 skips
    cost = np.zeros((rows, m, levels))
    for k, group in enumerate(groups):
        odds = np.where(bits[:, group] == 1, (1 - clipped[group]) / clipped[group], clipped[group] / (1 - clipped[group]))
        likely = n * np.prod(np.where(bits[:, group] == 1, clipped[group], 1 - clipped[group]), axis=1)
        # Elementary symmetric sums of the odds: the weight of all values t flips away.
        flips = [np.ones(rows)] + [np.zeros(rows) for _ in range(distance)]
        for j in range(len(group)):
            for t in range(distance, 0, -1):
                flips[t] += flips[t - 1] * odds[:, j]
        estimate, probes = shared[:, k].astype(float), 1.0
        cost[:, k, 1] = estimate + PROBE_COST
        for t in range(1, distance + 1):
            estimate = estimate + likely * flips[t]
            probes += len(list(combinations(group, t)))
            cost[:, k, t + 1] = estimate + PROBE_COST * probes
    total = distance + 1  # the sum of thresholds + 1 over the parts
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((rows, m, total + 1), np.int8)
    for k in range(m):
        nxt = np.full_like(best, np.inf)
        for s in range(total + 1):
            for t in range(min(levels - 1, s) + 1):
                c = best[:, s - t] + cost[:, k, t]
                better = c < nxt[:, s]
                nxt[better, s] = c[better]
                choice[better, k, s] = t
        best = nxt
    out, left = np.zeros((rows, m), np.int8), np.full(rows, total)
    for k in range(m - 1, -1, -1):
        out[:, k] = choice[np.arange(rows), k, left]
        left = left - out[:, k]
    return out - 1


def _links(fps: DataFrame, distance: int, parts: int, bucket: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of
    the graph of all pairs within ``distance``."""
    both, n = bit_counts(fps)
    groups = correlated_parts(both, n, parts)
    p = np.diag(both) / max(1, n)
    masks = [_mask(g) for g in groups]
    keys = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
        .alias("x")).select("fp", F.col("x.part").alias("part"), F.col("x.key").alias("key"))
    keys = keys.withColumn("pk", F.struct("part", "key"))
    sizes = keys.groupBy("pk").agg(F.count(F.lit(1)).alias("shared"))
    resident = materialise(attach(keys, sizes, "pk", "shared", 3 * n).select("fp", "part", "key", "shared"))

    wide = resident.groupBy("fp").pivot("part", list(range(parts))).agg(F.first("shared"))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy()
            t = allocate(f[[str(k) for k in range(parts)]].to_numpy(), fp, p, groups, n, distance)
            for k in range(parts):
                yield pd.DataFrame({"fp": fp, "part": np.int32(k), "t": t[:, k].astype(np.int32)})[t[:, k] >= 0]

    # One row per probe: the neighbourhood masks of a part and threshold are constants.
    flips = F.create_map(*[x for k in range(parts) for t in range(distance + 1) for x in (
        F.lit(k * 16 + t), F.array(*[F.lit(m) for m in neighbour_masks(groups[k], t)]))])
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("part") + 1)
    probes = wide.mapInPandas(choose, "fp long, part int, t int").select(
        "fp", "part", F.col("fp").bitwiseAND(mask).alias("own"), F.explode(flips[F.col("part") * 16 + F.col("t")]).alias("flip"))
    probes = probes.select(F.col("fp").alias("x"), "part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    probes = materialise(probes)

    small = resident.where(F.col("shared") <= bucket).select(F.col("fp").alias("y"), "part", "key")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance
    pairs = probes.join(small, ["part", "key"]).where((F.col("y") < F.col("x")) & near).select(
        F.col("x").alias("u"), F.col("y").alias("v"))

    hot = materialise(resident.where(F.col("shared") > bucket).select("part", "key").distinct())
    if hot.isEmpty():
        return pairs
    members = resident.where(F.col("shared") > bucket).select("fp")
    asking = probes.join(hot, ["part", "key"], "left_semi").select(F.col("x").alias("fp"))
    return pairs.unionByName(_midpoint_links(members.unionByName(asking).distinct(), distance))


def _midpoint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links by shared points within distance / 2 flips of a fingerprint."""
    if distance % 2:
        raise ValueError("midpoints are exact for even distances")
    flips = neighbour_masks(list(range(64)), distance // 2)
    met = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips])).alias("point"))
    least = met.groupBy("point").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return met.join(least.select("point", "least"), "point").where("fp > least").select(
        F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int = PARTS, bucket: int = BUCKET,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, text_hash, fp, component_id (smallest id of the class) and kept (true
    for one row of each class, the first by id, then input order)."""
    marked = materialise(fingerprints(docs, shingle, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("rid").alias("rid")))
    distinct = materialise(marked.groupBy("fp").agg(first.alias("f"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(_links(distinct.select("fp"), distance, parts, bucket))
    classed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    heads = materialise(classed.groupBy("root").agg(F.min("f").alias("head"), F.sum("n").alias("class_size")))
    lookup = classed.select("fp", "root", "n").join(heads, "root").select(
        "fp", "n", F.col("head.id").alias("component_id"), F.col("head.rid").alias("head_rid"), "class_size")
    out = attach(marked, lookup, "fp", "n", marked.count())
    return out.select("doc_id", "rid", "text_hash", "fp", "component_id", (F.col("rid") == F.col("head_rid")).alias("kept"), "class_size")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns kept. A row is known by
    its id and the hash of its text; of rows equal in both, one stays."""
    verdict = near_duplicates(docs, shingle, distance, id_col=id_col, text_col=text_col)
    return keep_rows(docs, verdict.select(F.col("doc_id").alias("id"), "text_hash", "kept"), id_col, text_col)
