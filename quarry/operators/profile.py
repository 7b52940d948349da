"""Table profiles and mergeable length sketches.

Exact and sketched forms are separate operators; none changes its way with the
size of the table.

* ``column_profile``, ``heavy_values``: exact, for all columns at once. Cells are
  counted by (column, SHA-256 of the text), so one scan feeds one shuffle of
  digests, combined map-side: a value held by a third of all rows is one row per
  task, and long texts are never shuffled or sorted.
* ``column_sketch``: one aggregation whose state has a fixed size per column.
* ``length_sketch``, ``merge_length_sketches``: quantile sketches that can be
  stored per slice of a corpus and merged later without reading it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

#: Relative standard error of the distinct estimate of ``column_sketch``.
DISTINCT_RSD = 0.02
#: Size parameter of the quantile sketch: ranks are off by less than 0.2% (single quantile, 99% of the time).
KLL_K = 2000


def _text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.hex(c) if isinstance(df.schema[name].dataType, BinaryType) else c.cast("string")


def _names(df: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(df.schema)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _cells(df: DataFrame) -> DataFrame:
    """(column, value, digest) of every cell; the digest of a null is null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in df.columns])
    return df.select(F.inline(cells)).withColumn("digest", F.unhex(F.sha2("value", 256)))


def _counted(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column", "digest").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column, also of an empty table: position, column, type, rows,
    nulls, distinct (values that are not null, compared as text)."""
    per = _counted(_cells(df)).groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("digest").isNull(), F.col("n"))).alias("nulls"), F.count("digest").alias("distinct"))
    zero = F.lit(0).cast("bigint")
    return _names(df).join(per, "column", "left").select(
        "position", "column", "type", *[F.coalesce(c, zero).alias(c) for c in ("rows", "nulls", "distinct")])


def heavy_values(df: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` most frequent values of every column (ties: smaller SHA-256 of
    the text): column, rank from 1, value as text, n. Nulls are no value. The
    values of the few digests found are taken from a second scan."""
    cells = _cells(df).where("digest is not null")
    # Spark cuts each task to the first rows of a column before the window's shuffle.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "digest"))
    best = _counted(cells).withColumn("rank", rank).where(F.col("rank") <= top)
    # ``top`` rows per column; all values of a digest are alike, so a set holds one.
    found = cells.join(F.broadcast(best), ["column", "digest"])
    return found.groupBy("column", "rank", "n").agg(F.collect_set("value")[0].alias("value")).select("column", "rank", "value", "n")


def column_sketch(df: DataFrame, rsd: float = DISTINCT_RSD) -> DataFrame:
    """One row per column: position, column, rows, nulls, distinct_estimate
    (HyperLogLog, standard error ``rsd``). State per column is fixed in size."""
    stats = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
                      (F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias("nulls"),
                      F.approx_count_distinct(_text(df, c), rsd).alias("distinct_estimate")) for i, c in enumerate(df.columns)]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def length_sketch(lengths: DataFrame, limit: int, keys: Sequence[str] = ("corpus",), length: str = "n_tokens") -> DataFrame:
    """Per key: n, n_over (above ``limit``), max_len and a quantile sketch of the
    lengths. Rows of this table from several slices merge with
    ``merge_length_sketches``. Null lengths are left out."""
    n = F.col(length)
    return lengths.where(n.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n > limit).alias("n_over"), F.max(n).cast("long").alias("max_len"),
        F.kll_sketch_agg_bigint(n.cast("long"), F.lit(KLL_K)).alias("sketch"))


def merge_length_sketches(sketches: DataFrame, keys: Sequence[str] = ("corpus",)) -> DataFrame:
    """Per key over all slices: n, p50, p95, p99 (lengths that occur, of a rank
    near the asked one), share_truncated, max_len; all but the quantiles are exact."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_over").alias("n_over"), F.max("max_len").alias("max_len"),
                                         F.kll_merge_agg_bigint("sketch").alias("sketch"))
    at = F.kll_sketch_get_quantile_bigint("sketch", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return merged.select(*keys, "n", *[at[i].alias(p) for i, p in enumerate(("p50", "p95", "p99"))],
                         (F.col("n_over") / F.col("n")).alias("share_truncated"), "max_len")
