"""Readers that keep input order, against sequential readers."""

import csv
import os
import random

import duckdb
import pytest

from quarry.sources import ordered as O

CELLS = ["plain", "", "two\nlines", 'a "quoted" word', "comma, inside", "\n\n", '"', "é🙂", "x" * 300, "1,2\n3", 'ends with "', "\r\nreturn"]


def write(path, seed, n):
    rng = random.Random(seed)
    rows = [[str(i), rng.choice(CELLS), rng.choice(CELLS) * rng.choice([1, 1, 20])] for i in range(n)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerow(["id", "a", "b c"])
        w.writerows(rows)
    return rows


def plain(path):
    """Python's own sequential reader; empty cells are missing values."""
    with open(path, newline="", encoding="utf-8") as f:
        return [tuple((c.replace("\r\n", "\n") or None) for c in r) for r in list(csv.reader(f))[1:]]


@pytest.fixture
def split_size(spark):
    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("size", [61, 257, 1009, 1 << 20])
def test_splits_anywhere_give_the_records_of_the_file(spark, tmp_path, split_size, size):
    path = str(tmp_path / "one.csv")
    write(path, size, 120 if size > 100 else 40)
    split_size(size)
    got = sorted(O.read_csv_quoted(spark, path, "pos").collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(len(got)))
    assert [tuple((c.replace("\r\n", "\n") if c else c) for c in tuple(r)[:3]) for r in got] == plain(path)
    assert size > 2000 or O._lines(spark, path).rdd.getNumPartitions() > 10


def test_equal_to_the_multi_line_reader(spark, tmp_path, split_size):
    from quarry.sources import files as FS

    path = str(tmp_path / "one.csv")
    write(path, 3, 200)
    want = sorted(map(repr, FS.read_csv_two_pass(spark, path)[0].collect()))
    split_size(500)
    assert sorted(map(repr, O.read_csv_quoted(spark, path).collect())) == want


def test_positions_over_files_and_empty_files(spark, tmp_path, split_size):
    for i, n in enumerate((30, 0, 7, 55)):
        write(str(tmp_path / f"f{i}.csv"), i, n)
    split_size(300)
    got = sorted(O.read_csv_quoted(spark, str(tmp_path), "pos").collect(), key=lambda r: r["pos"])
    want = [r for i in range(4) for r in plain(tmp_path / f"f{i}.csv")]
    assert [r["pos"] for r in got] == list(range(92)) and [r["id"] for r in got] == [r[0] for r in want]


def test_parquet_positions_equal_duckdb(spark, tmp_path, split_size):
    for name, lo, n in (("b", 0, 900), ("a", 900, 5), ("c", 905, 2500)):
        spark.range(lo, lo + n).selectExpr("id", "id % 13 k").coalesce(1).write.parquet(str(tmp_path / "t" / name))
    os.makedirs(tmp_path / "all")
    for name in "abc":
        part = next((tmp_path / "t" / name).glob("part-*.parquet"))
        part.rename(tmp_path / "all" / f"{name}.parquet")
    split_size(2000)
    df = O.read_parquet_ordered(spark, str(tmp_path / "all"))
    want = duckdb.sql(f"select id from read_parquet('{tmp_path}/all/*.parquet', filename=true, file_row_number=true) "
                      "order by filename, file_row_number").fetchall()
    got = sorted(df.collect(), key=lambda r: r.row_idx)
    assert [r.row_idx for r in got] == list(range(3405)) and [r.id for r in got] == [w[0] for w in want]
    first = {r.k: r.row_idx for r in O.first_by_position(df, "k").collect()}
    assert first == {k: min(r.row_idx for r in got if r.k == k) for k in range(13)}
    plan = df._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan


def test_registered_csv_is_written_by_all_partitions(spark, tmp_path):
    """Four files whatever the size gave a task a quarter of the texts."""
    import glob

    from quarry.plans import io as plans

    rows = [(i, "en", f"text {i}\nline") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/scratch/quoted-csv-*"))
    got = plans.QUERIES["csv_quoted_splits"](spark, str(tmp_path))
    (path,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/scratch/quoted-csv-*")) - before
    assert len(glob.glob(f"{path}/part-*.csv")) >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 4
    assert sorted((r["row_idx"], r["doc_id"], r["lang"], r["text"]) for r in got.collect()) == [(i, str(i), a, t) for i, a, t in rows]
