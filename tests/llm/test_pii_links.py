"""Feistel pseudonyms against an independent implementation; probe strings and links across spellings."""
import datetime as dt
import hashlib
import re

from covenant.llm import pii

KEY = pii.KEY


def mix(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:12], 16)


def feistel(a, b, left, right, tag):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + mix(tag, i, right)) % a
        else:
            right = (right + mix(tag, i, left)) % b
    return left, right


def digits(s, tag):
    n = len(s)
    k = n // 2
    left, right = feistel(10 ** k, 10 ** (n - k), int(s[:k]), int(s[k:]), f"{tag}{n}")
    return f"{left:0{k}d}{right:0{n - k}d}"


def below(x, a, b, tag):
    left, right = feistel(a, b, x // b, x % b, tag)
    return left * b + right


def refill(shape, new):
    it = iter(new)
    return re.sub(r"\d", lambda _: next(it), shape)


def card(s):
    body = digits(re.sub(r"\D", "", s)[:-1], "card")
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(int(c) for c in reversed(body)))
    return refill(s, body + str(-total % 10))


def phone(s, code):
    d = re.sub(r"\D", "", s)
    return refill(s, code + digits(d[len(code):], "phone"))


def day(s):
    n = (dt.date.fromisoformat(s) - dt.date(1930, 1, 1)).days
    return str(dt.date(1930, 1, 1) + dt.timedelta(below(n, pii.DATE_SPAN // 100, 100, "date")))


def ip(s):
    x = int.from_bytes(bytes(map(int, s.split("."))), "big")
    return ".".join(map(str, below(x, 1 << 16, 1 << 16, "ipv4").to_bytes(4, "big")))


def mail(s):
    return "u" + hashlib.sha256(f"{KEY}|mail|{s.lower()}".encode()).hexdigest()[:16] + "@example.invalid"


CASES = {
    "no.4111 1111 1111 1111": "no." + card("4111 1111 1111 1111"), "card-4111111111111111": "card-" + card("4111111111111111"),
    "(555) 5551234": phone("(555) 5551234", ""), "at 1984-02-29T10:00:00Z": f"at {day('1984-02-29')}T10:00:00Z",
    "file_1984-02-29_x": f"file_{day('1984-02-29')}_x", "an ü.müller@example.com, ok": f"an {mail('ü.müller@example.com')}, ok",
    "+49 151 12345678": phone("+49 151 12345678", "49"), "+4915112345678": phone("+4915112345678", "49"),
    "+1 (555) 555-1234": phone("+1 (555) 555-1234", "1"), "+15555551234": phone("+15555551234", "1"),
    "+351 912 345 678": phone("+351 912 345 678", "351"), "from 10.1.2.3 on": f"from {ip('10.1.2.3')} on",
    "555-123-4567": phone("555-123-4567", ""), "born 2001-12-31.": f"born {day('2001-12-31')}.",
    "1.4111111111111111 and .4111111111111111": "1.4111111111111111 and .4111111111111111", "-4111111111111111": "-4111111111111111",
    "1984-02-30T10:00 and 12345-01-01 and 1984-01-011": "1984-02-30T10:00 and 12345-01-01 and 1984-01-011",
}


def test_equals_an_independent_feistel(spark, docs):
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(list(enumerate(CASES)))).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_equal_phones_are_linked_across_spellings(spark, docs):
    groups = (("+49 151 12345678", "+4915112345678", "+49-151-12345678"), ("+1 (555) 555-1234", "+15555551234", "(555) 555-1234"),
              ("+33 6 12 34 56 78", "+33612345678"))
    rows = [(10 * g + i, f"call {s} now") for g, group in enumerate(groups) for i, s in enumerate(group)]
    got = {r["doc_id"]: re.sub(r"\D", "", r["text"])[-9:] for r in pii.pseudonymise(docs(rows)).collect()}
    for g, group in enumerate(groups):
        assert len({got[10 * g + i] for i in range(len(group))}) == 1
    assert len({got[10 * g] for g in range(3)}) == 3


def test_empty_table_and_clashing_columns(spark, docs):
    from pyspark.sql import functions as F
    assert pii.pseudonymise(docs([]), found="n").collect() == []
    odd = docs([(1, "card 4111111111111111")]).withColumns({"pii_places": F.lit(1), "PII_pattern": F.lit("x")})
    out = pii.pseudonymise(odd)
    assert out.columns == odd.columns and out.first()["text"] == "card " + card("4111111111111111")
