"""Tables in input order, read by many tasks.

* ``read_parquet_ordered``: a row's position is its place in its file, which
  Spark's reader knows, plus the rows of the files before it (by path). No sort,
  shuffle or checkpoint of the table.
* ``read_csv_quoted``: quoted CSV with line feeds inside cells, one file read by
  many tasks. A split of a file cannot know whether it starts inside a quoted
  cell, so a first pass follows both cases through each split and a scan along
  the splits of a file picks the true one. The second pass cuts records; the
  pieces of a record that reaches over splits are put together by its owner,
  the split where it begins.

Both need one row per file or per split, the size of Spark's own file listing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import na_to_null
from quarry.sources.files import ends_in_quotes


def read_parquet_ordered(spark: SparkSession, path: str, name: str = "row_idx") -> DataFrame:
    """Rows of a file or folder with their 0-based position in input order:
    files by path, rows as stored. ``name`` must not be a column of the files."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"),
                                           F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(base), "_file").withColumn(name, F.col("_base") + F.col("_at")).drop("_file", "_at", "_base")


def first_by_position(df: DataFrame, key: str, position: str = "row_idx") -> DataFrame:
    """The first row of each value of ``key`` (null is a value) by position. The
    aggregation holds a digest and a number per value; rows are then kept by
    their position, so no whole row is an aggregation buffer."""
    digest = F.coalesce(F.sha2(F.col(f"`{key}`").cast("string"), 256), F.lit("null"))
    first = df.groupBy(digest.alias("_k")).agg(F.min(position).alias("_first")).select("_first")
    return df.join(first, F.col(position) == F.col("_first"), "left_semi")


# --------------------------------------------------------------------------
# Quoted CSV
# --------------------------------------------------------------------------

def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # Carriage returns stay in the lines: those inside cells belong to them.
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
    """(file, split) and the rows of each batch part; a split may come in several parts."""
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        at, held = None, []
        for row in zip(*cols, strict=True):
            if row[:2] != at:
                if held:
                    yield at, held
                at, held = row[:2], []
            held.append(row)
        if held:
            yield at, held


def _empty(line: str) -> bool:
    return not line.rstrip("\r")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, for a start outside and inside a cell: whether a cell is open
    at its end, and how many records begin in it."""
    def row(at, state, begun) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [at[0]], "split": pa.array([at[1]], pa.int64()),
                                           "out_closed": [state[0]], "out_open": [state[1]],
                                           "n_closed": pa.array([begun[0]], pa.int64()), "n_open": pa.array([begun[1]], pa.int64())})

    last, state, begun = None, [False, True], [0, 0]
    for at, rows in _splits(batches):
        if at != last:
            if last is not None:
                yield row(last, state, begun)
            last, state, begun = at, [False, True], [0, 0]
        for _, _, line in rows:
            for k in (0, 1):
                begun[k] += not state[k] and not _empty(line)
            if '"' in line:
                state = [ends_in_quotes(line, s) for s in state]
    if last is not None:
        yield row(last, state, begun)


def split_states(lines: DataFrame) -> DataFrame:
    """(file, split, inside, base): does the split start inside a cell, and how
    many records of the file begin before it. The scan runs along one row per split."""
    followed = lines.mapInArrow(_follow, "file string, split long, out_closed boolean, out_open boolean, n_closed long, n_open long")
    zero = "struct(false as inside, 0L as base, cast(array() as array<struct<split:bigint,inside:boolean,base:bigint>>) as out)"
    step = """(a, s) -> struct(
        if(a.inside, s.out_open, s.out_closed) as inside,
        a.base + if(a.inside, s.n_open, s.n_closed) as base,
        concat(a.out, array(struct(s.split as split, a.inside as inside, a.base as base))) as out)"""
    return followed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(
        "split", "out_closed", "out_open", "n_closed", "n_open"))).alias("s")).select(
        "file", F.expr(f"inline(aggregate(s, {zero}, {step}, a -> a.out))"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in one split, and pieces of others: file, number of the
    record in its file, split, whole, text."""
    out: list[tuple] = []
    last, inside, number, held = None, False, 0, []

    def emit(at, whole: bool) -> None:
        if held:
            out.append((at[0], number, at[1], whole, "\n".join(held)))
            held.clear()

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        made = pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3]), pa.array(cols[4], pa.string())],
                                          names=["file", "number", "split", "whole", "record"])
        out.clear()
        return made

    begun_here = True
    for at, rows in _splits(batches):
        if at != last:
            if last is not None:
                emit(last, False)
            last, held = at, []
            inside, base = rows[0][3], rows[0][4]
            # A piece at the start belongs to the last record that began before this split.
            number, begun_here = base - 1, not inside
        for _, _, line, _, _ in rows:
            if not inside and not held:
                if _empty(line):
                    continue
                number, begun_here = number + 1, True
            held.append(line)
            if '"' in line:
                inside = ends_in_quotes(line, inside)
            if not inside:
                emit(at, begun_here)
        if out:
            yield batch()
    if last is not None:
        emit(last, False)
    if out:
        yield batch()


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, record): the records of every file with their 0-based
    number in it; the text of a record as it stands, without its line end."""
    lines = _lines(spark, path)
    known = lines.join(F.broadcast(split_states(lines)), ["file", "split"]).select("file", "split", "value", "inside", "base")
    cut = known.mapInArrow(_cut, "file string, number long, split long, whole boolean, record string")
    whole = cut.where("whole").select("file", "number", "record")
    # Only pieces at the borders of splits are shuffled.
    pieces = cut.where("not whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("split", "record"))).alias("p"))
    joined = pieces.select("file", "number", F.array_join(F.col("p.record"), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r$", ""))


def read_csv_quoted(spark: SparkSession, path: str | list[str], position: str | None = None) -> DataFrame:
    """Quoted CSV (line feeds and doubled quotes in cells), all columns STRING,
    missing-value markers null. A record with too few fields is padded with
    nulls, of one with too many the first ones are kept. ``position`` adds the
    input position: files by path, records as they stand. All files share the
    header of the first record of each."""
    columns = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).columns
    records = csv_records(spark, path)
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0001"}
    rows = records.where("number > 0")  # the header
    parsed = F.from_csv(F.col("record"), schema, options)
    if position is None:
        return rows.select(parsed.alias("r")).select(*[na_to_null(_field(c)).alias(c) for c in columns])
    files = records.groupBy("file").agg(F.max("number").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
    return rows.join(F.broadcast(base), "file").select(parsed.alias("r"), (F.col("b") + F.col("number") - 1).alias("_at")).select(
        *[na_to_null(_field(c)).alias(c) for c in columns], F.col("_at").alias(position))


def _field(name: str) -> Column:
    return F.col("r").getField(name)
