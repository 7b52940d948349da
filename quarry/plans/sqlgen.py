"""Small helpers that write the DuckDB oracle text for the confusion kernel.

The oracle must do the same arithmetic as the Spark expressions (same
operand order), so the shared pieces are generated here once.
"""

from __future__ import annotations

from collections.abc import Sequence

LETTERS = ("A", "B", "C", "D", "E")


def wide_cte(src: str, keys: Sequence[str], name: str = "cm") -> str:
    k = ", ".join(keys)
    cells = ",\n  ".join(
        f"count(*) filter (where gold_label = '{a}' and pred_label = '{b}') as n_{a}{b}"
        for a in LETTERS for b in LETTERS)
    return (f"{name} as (select {k}, count(*) as n, count(*) filter (where gold_label = pred_label) as n_correct,\n  "
            f"{cells}\n from {src} group by {k})")


def support(L: str) -> str:
    return "(" + " + ".join(f"n_{L}{b}" for b in LETTERS) + ")"


def predicted(L: str) -> str:
    return "(" + " + ".join(f"n_{a}{L}" for a in LETTERS) + ")"


def safe_div(num: str, den: str) -> str:
    return f"(case when {den} = 0 then 0.0 else cast({num} as double) / {den} end)"


def f1(L: str) -> str:
    return safe_div(f"2 * n_{L}{L}", f"({support(L)} + {predicted(L)})")


def precision(L: str) -> str:
    return safe_div(f"n_{L}{L}", predicted(L))


def recall(L: str) -> str:
    return safe_div(f"n_{L}{L}", support(L))


def accuracy() -> str:
    return safe_div("n_correct", "n")


def macro_fixed() -> str:
    return "((" + " + ".join(f1(L) for L in LETTERS) + ") / 5.0)"


def macro_present() -> str:
    present = "(" + " + ".join(
        f"(case when {support(L)} + {predicted(L)} > 0 then 1 else 0 end)" for L in LETTERS) + ")"
    total = "(" + " + ".join(f1(L) for L in LETTERS) + ")"
    return f"(case when {present} = 0 then 0.0 else {total} / {present} end)"


# ---- text (same character set and patterns as quarry.functions.text) ----

def _ws_chars() -> str:
    from quarry.functions.text import WHITESPACE
    return "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


WS_CHARS = _ws_chars()


def strip(expr: str) -> str:
    return f"trim({expr}, {WS_CHARS})"


def fill_strip(expr: str) -> str:
    return strip(f"coalesce(cast({expr} as varchar), '')")


def normalize_answer(expr: str) -> str:
    from quarry.functions.text import MULTI_LABEL, SINGLE_LETTER
    s = fill_strip(expr)
    letter = f"upper(regexp_extract({s}, '{SINGLE_LETTER}', 1))"
    return (f"(case when {s} = '' or lower({s}) = 'nan' then null "
            f"when regexp_matches({s}, '{MULTI_LABEL}') then null "
            f"when {letter} = '' then null else {letter} end)")


def reject_reason(expr: str) -> str:
    from quarry.functions.text import MULTI_LABEL, SINGLE_LETTER
    s = fill_strip(expr)
    return (f"(case when {s} = '' or lower({s}) = 'nan' then 'empty' "
            f"when regexp_matches({s}, '{MULTI_LABEL}') then 'multi_label' "
            f"when not regexp_matches({s}, '{SINGLE_LETTER}') then 'other' end)")
