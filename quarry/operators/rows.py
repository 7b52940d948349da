"""Row-position helpers: a dense 0-based ordinal without a global sort.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead each row gets ``monotonically_increasing_id()`` (partition index in the
high bits, position in the low 33 bits), and the tagged rows are checkpointed.
The tags are then stored values: counting them per partition and adding the
counts of earlier partitions cannot meet another partitioning of the same plan,
as it would if sampled range bounds or coalescing were worked out again. The
count table has one row per partition, which bounds its broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import cut_lineage


def with_ordinal(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Append a consecutive 0-based position in the current row order, like
    zipWithIndex. Spark packs the splits of several files by size: sort by an
    explicit column first where their order matters."""
    mid = F.monotonically_increasing_id()
    tagged = cut_lineage(df.withColumn("_mid", mid)).withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: the window below runs on that small table only.
    offsets = counts.select(
        "_pid", (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid", "left")
    pos = F.coalesce(F.col("_off"), F.lit(0)) + (F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    return out.withColumn(name, pos).drop("_mid", "_pid", "_off")
