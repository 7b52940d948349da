"""Column-expression text helpers (all JVM-side, no UDFs).

Python's ``str.strip()`` removes Unicode white space plus U+001C..U+001F;
Spark's ``trim`` removes only U+0020 and Java's ``\\s`` is ASCII. The exact
character set is spelled out once here and used with ``btrim`` (no regex)
and inside regex classes, so Spark and the SQL oracle agree with Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.isspace() accepts (29 code points).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a regex class, valid in Java regex and RE2.
WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# Answer patterns.
SINGLE_LETTER = rf"^{WS}*([A-Ea-e]){WS}*\.?{WS}*$"
MULTI_LABEL = (rf"(?i)[A-Ea-e]{WS}*[+,&]{WS}*[A-Ea-e]"
               rf"|and{WS}+[A-Ea-e]"
               rf"|[A-Ea-e]{WS}+or{WS}+[A-Ea-e]")

# Cell texts pandas' CSV reader turns into a missing value.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Python-compatible strip of Unicode white space."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def fill_strip(c) -> Column:
    """null -> '' then strip (the loader's fill-and-strip step)."""
    return ustrip(F.coalesce(col(c).cast("string"), F.lit("")))


def is_blank(c) -> Column:
    return F.length(fill_strip(c)) == 0


def na_to_null(c) -> Column:
    """Null the whole list of pandas missing-value markers (exact match)."""
    c = col(c)
    return F.when(c.isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def normalize_answer(c) -> Column:
    """Raw answer -> one upper-case letter A..E, or null.

    Accepts 'a', ' C ', 'D.'; rejects multi-label, free text, empty and 'nan'.
    """
    s = fill_strip(c)
    letter = F.upper(F.regexp_extract(s, SINGLE_LETTER, 1))
    return (F.when((s == "") | (F.lower(s) == "nan"), F.lit(None).cast("string"))
            .when(s.rlike(MULTI_LABEL), F.lit(None).cast("string"))
            .when(letter == "", F.lit(None).cast("string"))
            .otherwise(letter))


def reject_reason(c) -> Column:
    """Why an answer is invalid: 'empty', 'multi_label', 'other'; null if valid."""
    s = fill_strip(c)
    return (F.when((s == "") | (F.lower(s) == "nan"), F.lit("empty"))
            .when(s.rlike(MULTI_LABEL), F.lit("multi_label"))
            .when(~s.rlike(SINGLE_LETTER), F.lit("other")))
