"""Sharding by histogram sort: equal bytes per shard, one exchange.

Rows are ordered by the 128-bit key (content hash, hash of the row). Splitters
cut that order into shards of equal bytes. They are found by probing: each
round counts the exact bytes below evenly spaced candidate boundaries inside
the intervals that still hold a splitter, and a splitter is fixed when a
candidate lies within ``tolerance`` of its target. An interval that holds one
row takes the nearer edge. Then the rows move once, to (shard, slice).

Equal texts share the first half of the key, so they stay together unless
their group is larger than a splitter's tolerance; a text that a third of all
rows repeat is cut by the second half. All counting is by column expressions
over a written narrow table; a round brings at most (shards - 1) x 2^bits
sums to the driver.

Defined cases: a null text has no bytes, and its size is ``overhead``; a null
id is an ordinary row; rows that agree in all columns are told apart by a
stored row id; with fewer rows than shards some shards are empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialise

#: A splitter's error may be this share of a shard's mean bytes.
TOLERANCE = 0.001
#: Candidate boundaries per interval and round: 2 ** PROBE_BITS.
PROBE_BITS = 10
#: Rows of one shard that one slice (window partition) holds on average.
SLICE_ROWS = 50_000

_LOW, _HIGH = -(1 << 63), 1 << 63


@dataclass
class _Interval:
    """Keys whose first (part 0) or second (part 1) half lies in
    [low, low + 2 ** bits); part 1 is within one value of the first half."""
    part: int
    first: int
    low: int
    bits: int
    below: int  # exact bytes of the rows before this interval


def _levels(bits: int) -> int:
    return max(0, bits - PROBE_BITS)


def _count(rows: DataFrame, part: int, bits: int, intervals: dict[tuple, _Interval]) -> dict[tuple, list]:
    """Rows and bytes between neighbouring candidate boundaries of the
    intervals, which all have the same part and bits."""
    shift = _levels(bits)
    key = F.col("h1") if part == 0 else F.col("h2")
    if part == 0:
        sel, group = rows, F.lit(0).cast("long")
        if bits < 64:
            sel = sel.where(F.shiftright("h1", bits).isin([i.low >> bits for i in intervals.values()]))
    else:
        sel, group = rows.where(F.col("h1").isin([i.first for i in intervals.values()])), F.col("h1")
        if bits < 64:
            pairs = [F.lit(f"{i.first}:{i.low >> bits}") for i in intervals.values()]
            sel = sel.where(F.concat_ws(":", "h1", F.shiftright("h2", bits)).isin(*pairs))
    got = sel.groupBy(group.alias("g"), F.shiftright(key, shift).alias("probe")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("h1").alias("lo1"), F.max("h1").alias("hi1"))
    out: dict[tuple, list] = {}
    for r in got.collect():
        low = (r["probe"] << shift) >> bits << bits if bits < 64 else _LOW
        out.setdefault((r["g"] if part else 0, low), []).append(r)
    for v in out.values():
        v.sort(key=lambda r: r["probe"])
    return out


def find_splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Lower bounds (h1, h2) of shards 1 .. shards - 1 over ``rows`` (h1, h2,
    size)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    active = {i: _Interval(0, 0, _LOW, 64, 0) for i in range(1, shards)} if total else {}
    while active:
        # One job per kind of interval that is still open.
        for part, bits in sorted({(v.part, v.bits) for v in active.values()}):
            mine = {i: v for i, v in active.items() if (v.part, v.bits) == (part, bits)}
            keyed = {(v.first if part else 0, v.low): v for v in mine.values()}
            counted = _count(rows, part, bits, keyed)
            shift = _levels(bits)
            for i, v in mine.items():
                target = i * total / shards
                below = v.below
                for r in counted[(v.first if part else 0, v.low)]:
                    if below + r["bytes"] > target or r is counted[(v.first if part else 0, v.low)][-1]:
                        break
                    below += r["bytes"]
                low, above = r["probe"] << shift, below + r["bytes"]
                near = min((abs(target - below), 0), (abs(target - above), 1))
                high = low + (1 << shift)
                if near[0] <= slack or r["rows"] == 1 or (part == 1 and shift == 0):
                    if part == 0:
                        bound = (low, _LOW) if near[1] == 0 else (high, _LOW)
                    else:
                        bound = (v.first, low) if near[1] == 0 else (v.first, high)
                    found[i] = bound
                    del active[i]
                elif part == 0 and r["lo1"] == r["hi1"]:
                    active[i] = _Interval(1, r["lo1"], _LOW, 64, below)  # one content hash: cut among its rows
                else:
                    active[i] = _Interval(part, v.first, low, shift, below)
    return [found[i] for i in sorted(found)]


def _at_least(bound: tuple[int, int]) -> Column:
    first, second = bound
    if first >= _HIGH:
        return F.lit(False)
    above = F.col("h1") >= first if second == _LOW else F.col("h1") > first
    if second == _LOW:
        return above
    if second >= _HIGH:
        return F.col("h1") > first
    return above | ((F.col("h1") == first) & (F.col("h2") >= second))


def shard_of(splitters: list[tuple[int, int]]) -> Column:
    """The shard of a key: binary search over the splitters as one nested
    CASE expression."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_at_least(splitters[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(splitters))


def shard_rows(df: DataFrame, size: Column, content: Column, identity: Column, shards: int,
               tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``size``: bytes of a row; ``content``: equal values stay together where
    the law allows; ``identity``: tells rows of equal content apart. The
    columns of ``df`` travel through one exchange: pass the columns to keep.
    """
    names = [f"c{i}" for i in range(len(df.columns))]  # caller's names cannot clash with ours
    cols = [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)]
    keyed = df.select(*cols, size.cast("long").alias("size"), F.xxhash64(content).alias("h1"),
                      identity.alias("_id"), F.monotonically_increasing_id().alias("rid"))
    keyed = materialise(keyed.select(*names, "size", "h1", F.xxhash64("_id", "rid").alias("h2")))
    splitters = find_splitters(keyed, shards, tolerance)
    slices = max(1, -(-keyed.count() // (shards * SLICE_ROWS)))
    placed = keyed.withColumn("shard", shard_of(splitters)).withColumn(
        "slice", F.pmod(F.xxhash64("h2"), F.lit(slices)).cast("int"))
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("h1", "h2"))
    out = placed.withColumn("_q_n", within).join(bases, ["shard", "slice"])
    slot = (F.col("base") + F.col("_q_n") - 1).cast("long")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)], F.col("shard").cast("int").alias("shard"),
                      slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, by law
    ``bytes``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + overhead).cast("long").alias("size"),
                         F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("content"))
    out = shard_rows(narrow, F.col("size"), F.col("content"), F.col("doc_id"), shards, tolerance)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
