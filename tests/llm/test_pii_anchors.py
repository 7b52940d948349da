import random
import re

from quarry.llm.pii_anchors import BASE_KINDS, digest, find_private, find_spans, luhn, sha256, written
from tests.llm.conftest import EDGE, bag

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base(text):
    return [(k, m.start(), m.end()) for k in BASE_KINDS for m in re.finditer(PATTERNS[k][0], text) if PATTERNS[k][1](m[0])]


def test_base_kinds_equal_the_patterns(docs, rows, clash, empty):
    want = []
    for i, t in rows:
        b = base(t)
        want.append((i, *[sum(s[0] == k for s in b) for k in BASE_KINDS], sha256(written(b))))
    for df in (docs, clash):
        assert bag(tuple(r)[:6] for r in digest(find_private(df)).collect()) == bag(want)
    assert digest(find_private(empty)).count() == 0


def test_random_strings():
    rng = random.Random(11)
    parts = ["@", ".", "+", "-", " ", "(", ")", "1", "25", "255", "256", "4111 1111 1111 1111", "a", "b.c", "é", "٣", "\n",
             "x@y.z", "10.0.0.1", "+49 30", "00", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [s for s in find_spans(t) if s[0] in BASE_KINDS] == base(t), repr(t)
    for e in EDGE:
        assert [s for s in find_spans(e[1] or "") if s[0] in BASE_KINDS] == base(e[1] or "")


def test_added_kinds():
    def added(t):
        return [(k, t[s:e]) for k, s, e in find_spans(t) if k not in BASE_KINDS]

    assert added("see https://bill:pw123@db.example.com/x") == [("login", "https://bill:pw123@db.example.com")]
    assert added("see https://db.example.com/x") == []
    assert added("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN: DE88 3704 0044 0532 0130 00.") == []
    assert added("Account no. 12345678 is") == [("account", "12345678")]
    assert added("an account of 1234 words") == [] and added("Licensed under 3.0, version 12345678") == []


def test_iban_before_more_words():
    def ibans(t):
        return [t[s:e] for k, s, e in find_spans(t) if k == "iban"]

    de, no = "DE89 3704 0044 0532 0130 00", "NO9386011117947"
    for after in ("", ".", " BIC DEUTDEFF", " EUR 100", " 12 34", " DE89", " A", " and", " IBAN", "\n100", " BIC: X",
                  " Bank", " 1" * 20, " " + "ABCDEFGH " * 5):
        assert ibans(f"IBAN: {de}{after}") == [de], after
        assert ibans(f"IBAN {de.replace(' ', '')}{after}") == [de.replace(" ", "")], after
        assert ibans(f"IBAN {no}{after}") == [no], after
    malta = "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    assert ibans(f"IBAN {malta} SWIFT MALTMTMT") == [malta]
    assert ibans(f"IBAN: {de} IBAN {no} EUR") == [de, no]
    assert ibans(f"IBAN: {de.replace('89', '88')} IBAN {no} EUR") == [no]
    other = "ZZ20 0000 0000 0001"  # a country that is not listed
    code = next(f"ZZ{k:02d}{other[4:]}" for k in range(2, 99) if (1 * 10**6 + 3535 * 100 + k) % 97 == 1)
    assert ibans(f"IBAN {code} EUR") == [code]
    for wrong in ("DE88 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00x", "DE89 3704 0044 0532 0130 001"):
        assert ibans(f"IBAN: {wrong} BIC DEUTDEFF") == [], wrong
