"""Unicode strip, answer normalisation and reject reasons (edge rows)."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T

WS_CHARS = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", " ",
            " ", " ", " ", "　"]


def test_strip_matches_python(spark):
    texts = [c + "x" + c for c in WS_CHARS] + ["​x​", "‏x", "﻿x", "  a b  ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(T.ustrip("s")).collect()]
    assert got == [None if t is None else t.strip() for t in texts]
    for t in texts[:len(WS_CHARS)]:
        assert t.strip() == "x"


def test_whitespace_set_is_python_isspace():
    py = {c for c in map(chr, range(0x110000)) if c.isspace()}
    assert set(T.WHITESPACE) == py


NORMALIZE = [
    ("a", "A", None), (" C ", "C", None), ("D.", "D", None), ("e ", "E", None), ("B", "B", None),
    ("A+B", None, "multi_label"), ("C, A", None, "multi_label"), ("C or D", None, "multi_label"),
    ("A and B", None, "multi_label"), ("A & b", None, "multi_label"),
    ("AorB", None, "other"), ("F", None, "other"), ("?", None, "other"), ("A`", None, "other"),
    ("أ", None, "other"), ("", None, "empty"), (None, None, "empty"), ("nan", None, "empty"),
    ("NaN", None, "empty"), (" b　", "B", None), ("D .", "D", None),
]


@pytest.mark.parametrize("raw,letter,reason", NORMALIZE)
def test_normalize_answer(spark, raw, letter, reason):
    df = spark.createDataFrame([(raw,)], "a string")
    r = df.select(T.normalize_answer("a").alias("n"), T.reject_reason("a").alias("r")).first()
    assert r["n"] == letter
    assert r["r"] == reason


def test_na_markers(spark):
    vals = ["NA", "N/A", "null", "None", "nan", "", "#N/A", "<NA>", "keep", " NA"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(T.na_to_null("v")).collect()]
    assert got == [None] * 8 + ["keep", " NA"]


def test_fill_strip_null(spark):
    df = spark.createDataFrame([(None,), ("  x ",)], "v string")
    assert [r[0] for r in df.select(T.fill_strip(F.col("v"))).collect()] == ["", "x"]
