"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus
signs, digits, URL schemes and cue words of identifiers. Deterministic parsers
expand an anchor to its boundaries and validate it:

* email: letters, digits and ``._%+-`` to the left of an at-sign, a dotted host
  to the right;
* ip: a run of digits that starts four dotted numbers, each at most 255;
* card: digits with single spaces or hyphens between, 13 to 19 of them, Luhn;
* phone: a plus sign, a digit, digits and ``().-`` or spaces, 9 to 15 digits;
* login (added): a URL with user information, ``scheme://user:password@host``;
* iban (added): country, check digits and 11 to 30 characters, modulus 97; it ends
  at its country's length, or, for a country not listed, at the last token boundary
  that passes, as more capitals or digits may follow;
* account (added): a cue word, then a number of 6 to 17 digits.

Within a kind, matches are leftmost and do not overlap; a match that fails its
test is dropped, and the search goes on behind it. Offsets are code points.

Defined cases: a null text counts as empty and has no spans; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.dp_packing import steps

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "account")

#: Anchors that are more than one character: URL schemes and cue words.
SCHEMES = ("://",)
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"[0-9][ ().0-9-]+[0-9]")
_USER = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]*[A-Za-z0-9]")
_IBAN = re.compile(r"[\s:#.-]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Characters of an IBAN by country (the public IBAN registry).
_IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
_ALNUM = re.compile(r"[A-Za-z0-9]")
_ACCOUNT = re.compile(r"(?i:s?\b[ ]?(?:no|nr|number|num|id)?\b)[.:#= ]{0,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")

_WORKER: list = []


def automaton():
    """The anchors of this worker. Cues are found in a lower-cased copy, which
    has the length of the text for the letters that matter."""
    if not _WORKER:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "@+0123456789":
            a.add_word(c, c)
        for s in SCHEMES:
            a.add_word(s, "scheme")
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, "cue")
        a.make_automaton()
        _WORKER.append(a)
    return _WORKER[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _back(text: str, at: int, low: int, allowed: frozenset) -> int:
    """Start of the run of ``allowed`` characters that ends before ``at``."""
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


def email_at(text: str, at: int, low: int) -> tuple[int, int, bool] | None:
    start = _back(text, at, low, _LOCAL)
    host = _HOST.match(text, at + 1)
    return (start, host.end(), True) if host and start < at else None


def ip_at(text: str, at: int, low: int) -> tuple[int, int, bool] | None:
    """``at`` is a digit that starts a run at or after ``low``."""
    end, parts = at, []
    for k in range(4):
        if k:
            if text[end: end + 1] != ".":
                return None
            end += 1
        number = _NUMBERS.match(text, end)
        if not number:
            return None
        parts.append(number[0])
        end = number.end()
    return at, end, all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def card_at(text: str, at: int, low: int) -> tuple[int, int, bool] | None:
    m = _CARD.match(text, at)
    if not m:
        return None
    digits = m[0].replace(" ", "").replace("-", "")
    return at, m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, at: int, low: int) -> tuple[int, int, bool] | None:
    m = _PHONE.match(text, at + 1)
    if not m:
        return None
    return at, m.end(), 9 <= sum(c in _DIGITS for c in m[0]) <= 15


def login_at(text: str, end: int, low: int) -> tuple[int, int, bool] | None:
    """``end``: the last character of ``://``."""
    start = end - 2
    while start > low and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+-."):
        start -= 1
    m = _USER.match(text, end + 1)
    return (start, m.end(), True) if m and start < end - 2 else None


def iban_at(text: str, end: int) -> tuple[int, int, bool] | None:
    m = _IBAN.match(text, end + 1)
    if not m:
        return None
    start, stop = m.span(1)
    ends = [i + 1 for i in range(start, stop) if text[i] != " "]
    own = _IBAN_LENGTH.get(text[start: start + 2])
    for n in (own,) if own else range(len(ends), 14, -1):
        if n <= len(ends) and not _ALNUM.match(text, ends[n - 1]):
            code = text[start: ends[n - 1]].replace(" ", "")
            digits = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
            if int(digits) % 97 == 1:
                return start, ends[n - 1], True
    # Nothing is dropped behind: a run without an IBAN may hold the next cue.
    return None


def account_at(text: str, end: int) -> tuple[int, int, bool] | None:
    m = _ACCOUNT.match(text, end + 1)
    return (m.start(1), m.end(1), True) if m else None


def find_spans(text: str) -> list[Span]:
    """All spans, by kind as listed in ``KINDS``, then start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    behind = dict.fromkeys(KINDS, 0)  # end of the last match, dropped ones too

    def take(kind: str, got: tuple[int, int, bool] | None) -> None:
        if got and got[0] >= behind[kind]:
            behind[kind] = got[1]
            if got[2]:
                found[kind].append((kind, got[0], got[1]))

    last = -2  # the last digit seen; a digit behind another does not start a run
    for at, what in automaton().iter(text):
        if what == "@":
            take("email", email_at(text, at, behind["email"]))
        elif what == "+":
            take("phone", phone_at(text, at, behind["phone"]))
        elif what == "scheme":
            take("login", login_at(text, at, behind["login"]))
        elif what == "cue":
            if text[at - 3: at + 1].lower() == "iban":
                take("iban", iban_at(text, at))
            else:
                take("account", account_at(text, at))
        else:
            # A run starts behind a character that is no digit, or behind the last match.
            if at >= behind["ip"] and (last != at - 1 or at == behind["ip"]):
                take("ip", ip_at(text, at, at))
            if at >= behind["card"] and (last != at - 1 or at == behind["card"]):
                take("card", card_at(text, at, at))
            last = at
    return [s for k in KINDS for s in found[k]]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array<struct<kind,start,end>> of every whole text, in
    the order of ``find_spans``."""
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in steps(b.column(1)):
                spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spans, pa.list_(kinds))],
                                                 names=["doc_id", "spans"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[number(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256)
                        .alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
