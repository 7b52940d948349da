"""Report-text operators.

Sanitising and hygiene checks are column expressions over any text column
(``translate``-style replaces, ``regexp_extract_all``, ``posexplode`` of
lines) and return violation rows instead of raising, so one job checks a
whole corpus. Percent formatting needs Python's rounding of the exact binary
value (2.675 -> 2.67, where Java's %.2f gives 2.68), so that one step is a
small pandas UDF; it runs on report tables (one row per run).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.text import WS

# Typographic replacements applied before the ASCII check.
REPLACEMENTS = [
    ("—", "---"),
    ("–", "--"),
    ("±", "$\\pm$"),
    ("→", "$\\rightarrow$"),
    ("‘", "`"),
    ("’", "'"),
    ("“", "``"),
    ("”", "''"),
    (" ", " "),
]
NON_ASCII = r"[^\x{0}-\x{7f}]"
# Python's str.splitlines() boundaries.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
BARE_PERCENT = r"(^|[^\\])%"


def sanitize(c: Column) -> Column:
    for a, b in REPLACEMENTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def non_ascii_chars(c: Column) -> Column:
    """Sorted distinct non-ASCII characters of a text (empty array if none)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(NON_ASCII), 0)))


def sanitize_text(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sanitised text plus the non-ASCII characters that remain."""
    s = sanitize(F.col(text))
    return df.select(*keep, s.alias("sanitized"), F.array_join(non_ascii_chars(s), "").alias("remaining_non_ascii"))


def lines(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line (1-based ``line_no``), split as str.splitlines()."""
    parts = F.split(F.col(text), LINE_BREAK, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(*keep, F.posexplode(parts).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).alias("line_no"), "line")


def text_hygiene_scan(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Violation rows (keys, line_no, issue): 'non_ascii' for a line with any
    non-ASCII character, 'bare_percent' for an unescaped % on a line that is
    not a comment line (first non-blank character %)."""
    ln = lines(df, text, keep)
    comment = F.regexp_replace("line", f"^{WS}+", "").startswith("%")
    issues = F.array(
        F.when(F.col("line").rlike(NON_ASCII), F.lit("non_ascii")),
        F.when(~comment & F.col("line").rlike(BARE_PERCENT), F.lit("bare_percent")))
    return ln.select(*keep, "line_no", F.explode(F.array_compact(issues)).alias("issue"))


@F.pandas_udf(StringType())
def _pct(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else f"{100 * float(v):.2f}")


def pct(c: Column) -> Column:
    """100 * x with two decimals, rounded as Python formats it."""
    return _pct(c.cast("double"))


def format_pct_ci(point: Column, lo: Column, hi: Column) -> Column:
    """'53.16 [51.77, 54.61]'."""
    return F.concat(pct(point), F.lit(" ["), pct(lo), F.lit(", "), pct(hi), F.lit("]"))


def latex_escape_name(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("\\_"))
