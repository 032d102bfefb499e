"""Format-preserving Feistel pseudonyms for personal data. DataFrame functions only.

Numbers and dates are validated (Luhn for cards, octets below 256 for IPv4, real calendar days for dates, shape for
phones) and then permuted by a keyed Feistel network within their format: separators and length stay, card numbers keep
a valid check digit, dates stay dates, octets stay octets. Equal values get equal pseudonyms in every document and,
as it is a permutation, different values of a format different ones. The user part of an e-mail address is not a
number: it becomes a keyed token, its host a reserved one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.tables import free_name

KEY = "documented-default-key"
ROUNDS = 8
MAX_DIGITS = 18
DATE_SPAN = 36500     # days from DATE_FROM on: the domain of date pseudonyms
DATE_FROM = "1930-01-01"
DAYS = 3652425        # 0000-01-01 to 9999-12-31: days outside of the first domain are permuted in one of their own
FIRST_DAY = "0000-01-01"
FAR = (1325, 2729)    # its size as a product: DAYS - DATE_SPAN

# What is looked for, in order of precedence at one place.
EMAIL = r"[\p{L}\p{M}\p{N}._%+\-]{1,64}@[\p{L}\p{M}\p{N}\-]{1,63}(?:\.[\p{L}\p{M}\p{N}\-]{1,63})*\.[\p{L}\p{M}]{2,24}"
DATE = r"(?<!\d)(?<!\d-)\d{4}-\d{2}-\d{2}(?!\d)(?!-\d)"      # also within a time or a name
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
PHONE = r"(?:\+\d{1,3}[ \-.]?)?\(\d{2,4}\)[ \-.]?\d{3,4}[ \-.]?\d{4}(?!\d)|\+\d{1,3}(?:[ \-.]\d{2,4}){2,4}(?!\d)|(?<![\w\-.])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\w\-])"
PLUS = r"|(?<![\w.])\+(?=[1-9](?:[ \-()]*\d){7})"      # at least eight digits
PHONE += PLUS + r"\d{8,15}(?!\d)" + PLUS + r"\d{1,3}[ \-]?\(?\d{1,5}\)?[ \-]?\d{4,9}(?!\d)"
PHONE += PLUS + r"\d{1,3}[ \-]\d{1,5}[ \-]\d{3,9}(?:[ \-]\d{1,4}){0,2}(?!\d)" + PLUS + r"\d{1,3}[ \-]\d(?:[ \-]\d{2}){4}(?!\d)"
PHONE += r"|(?<![\w\-.+])(?<!\d )\d{3} \d{3} \d{4}(?![\w\-])(?! \d)"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
# A card starts a group of digits. It is looked for at every such place, in the layouts of 4-4-4-..., 4-4-4-4-1 to -3, 4-6-5
# and 4-6-4 (longest first); only those with a check digit become part of the pattern of their text.
# A dot or hyphen before it may follow a letter (no.4111..., card-4111...), else it would be a fraction or a sign.
CARD_FROM = r"(?<!\w)(?<![^\p{L}]\.)(?<!^\.)(?<![^\d\p{L}]-)(?<!^-)"
CARD_TO = r"(?!\w)"
CARDS = (r"\d{4}(?:[ \-]?\d{4}){3}[ \-]\d{1,3}", r"\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}", r"\d{4}[ \-]\d{6}[ \-]\d{4,5}")
CARD_AT = CARD_FROM + r"(?=(\d{4}[\w \-]{9,24}))"
# The country codes of E.164 (zones 1 and 7, the two-digit codes; every other one has three digits).
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ANY = "|".join((EMAIL, DATE, IPV4, SSN, PHONE))


def _mod_hash(key: Column, *parts: Column) -> Column:
    """A keyed number of up to 48 bits."""
    return F.conv(F.substr(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), F.lit(1), F.lit(12)), 16, 10).cast("long")


def _pow10(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10 ** i) for i in range(MAX_DIGITS + 1)]), n.cast("int") + 1)


def _rounds(a: Column, b: Column, left: Column, right: Column, tag: Column, key: str, end) -> Column:
    """A keyed Feistel network on the pair (left < a, right < b) of longs; ``end`` makes the result of the pair."""
    def one(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        mix = _mod_hash(F.lit(key), tag, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(F.when(even, (s["l"] + mix) % a).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise((s["r"] + mix) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), one, end)


def permute_below(x: Column, a: int, b: int, tag: str, key: str) -> Column:
    """A permutation of the longs 0 <= x < a * b."""
    a_, b_ = F.lit(a).cast("long"), F.lit(b).cast("long")
    x = x.cast("long")
    return _rounds(a_, b_, F.floor(x / b_).cast("long"), x % b_, F.lit(tag), key, lambda s: s["l"] * b_ + s["r"])


def permute_digits(digits: Column, tag: str, key: str) -> Column:
    """A string of 2 to MAX_DIGITS digits, permuted among the strings of its length (halves are the two Feistel sides)."""
    n = F.length(digits)
    k = (n / 2).cast("int")
    left, right = F.substr(digits, F.lit(1), k).cast("long"), F.substr(digits, k + 1).cast("long")
    a, b = _pow10(k), _pow10(n - k)

    def joined(s: Column) -> Column:
        return F.concat(F.lpad(s["l"].cast("string"), k, F.lit("0")), F.lpad(s["r"].cast("string"), n - k, F.lit("0")))

    return _rounds(a, b, left, right, F.concat(F.lit(tag), n.cast("string")), key, joined)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, doubling from the last but one."""
    ds = F.reverse(F.split(digits, "(?<=.)(?=.)"))
    return F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))), F.lit(0), lambda s, d: s + d)


def _refill(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced by ``digits`` in order: separators and grouping stay."""
    return F.array_join(F.zip_with(F.split(match, "[0-9]", -1), F.split(digits, "(?<=.)(?=.)"),
                                   lambda sep, d: F.concat(F.coalesce(sep, F.lit("")), F.coalesce(d, F.lit("")))), "")


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, the last becomes the check digit: valid numbers stay valid."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = permute_digits(body, "card", key)
    check = F.pmod(-luhn_sum(F.concat(new, F.lit("0"))), F.lit(10))
    return _refill(m, F.concat(new, check.cast("string")))


def _day(m: Column, start: str = DATE_FROM) -> Column:
    """Days from ``start`` on; null if there is no such calendar day."""
    return F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(start).cast("date"))


def _date(m: Column, key: str) -> Column:
    near = permute_below(_day(m), DATE_SPAN // 100, 100, "date", key).cast("int")
    # the days outside, numbered without a gap
    before = F.datediff(F.lit(DATE_FROM).cast("date"), F.lit(FIRST_DAY).cast("date"))
    n = _day(m, FIRST_DAY)
    far = permute_below(F.when(n < before, n).otherwise(n - DATE_SPAN), *FAR, "far-date", key).cast("int")
    far = F.when(far < before, far).otherwise(far + DATE_SPAN)
    new = F.when(_day(m).between(0, DATE_SPAN - 1), F.date_add(F.lit(DATE_FROM).cast("date"), near)).otherwise(
        F.date_add(F.lit(FIRST_DAY).cast("date"), far))
    return F.date_format(new, "yyyy-MM-dd")


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, "[.]"), lambda p: p.cast("long"))


def _ipv4(m: Column, key: str) -> Column:
    x = F.aggregate(_octets(m), F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    y = permute_below(x, 1 << 16, 1 << 16, "ipv4", key)
    return F.concat_ws(".", *[(F.shiftright(y, 8 * i) % 256).cast("string") for i in (3, 2, 1, 0)])


def _phone(m: Column, key: str) -> Column:
    """The digits of the national number are permuted, whatever the spelling: a country code, which only follows a plus,
    stays and is told from them by the table of codes."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY, 1)).otherwise(F.lit(""))
    national = F.substr(digits, F.length(code) + 1)
    return _refill(m, F.concat(code, permute_digits(national, "phone", key)))


def _is(m: Column, pattern: str) -> Column:
    return m.rlike(f"^(?:{pattern})$")


def _checked(m: Column) -> Column:
    return luhn_sum(F.regexp_replace(m, "[^0-9]", "")) % 10 == 0


def _cards(text: Column) -> Column:
    """The valid card numbers of a text as a pattern's alternatives, each behind a bar; empty if there are none."""
    near = F.regexp_extract_all(text, F.lit(CARD_AT), F.lit(1))
    here = F.flatten(F.transform(near, lambda s: F.array(*[F.regexp_extract(s, f"^(?:{c}){CARD_TO}", 0) for c in CARDS])))
    valid = F.array_distinct(F.filter(here, lambda c: F.when(c == "", False).otherwise(_checked(c))))
    # digits, blanks and hyphens only: nothing to quote; of several at one place the longest
    ordered = F.reverse(F.array_sort(F.transform(valid, lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))))
    return F.array_join(F.transform(ordered, lambda o: F.concat(F.lit("|" + CARD_FROM), o["c"], F.lit(CARD_TO))), "")


def _valid(m: Column) -> Column:
    """Whether a place holds what it looks like: a calendar day, octets below 256, a card's check digit."""
    card = _checked(m)
    return F.coalesce(F.when(m.contains("@"), True).when(_is(m, DATE), _day(m).isNotNull())
                      .when(_is(m, IPV4), F.array_max(_octets(m)) < 256).when(_is(m, SSN) | _is(m, PHONE), True)
                      .otherwise(card), F.lit(False))


def _pseudonym(m: Column, key: str) -> Column:
    mail = F.concat(F.lit("u"), F.substr(F.sha2(F.concat(F.lit(key + "|mail|"), F.lower(m)), 256), F.lit(1), F.lit(16)),
                    F.lit("@example.invalid"))
    return (F.when(~_valid(m), m).when(m.contains("@"), mail).when(_is(m, DATE), _date(m, key))
            .when(_is(m, IPV4), _ipv4(m, key))
            .when(_is(m, SSN), _refill(m, permute_digits(F.regexp_replace(m, "[^0-9]", ""), "ssn", key)))
            .when(_is(m, PHONE), _phone(m, key)).otherwise(_card(m, key)))


def pseudonymise(docs: DataFrame, key: str = KEY, found: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by pseudonyms; with ``found``, a long column of that name counts
    the places. Numbers that only look like one (no check digit, octets above 255, no such day) stay. A null text stays null (0 places), other columns pass through; repeated rows change alike."""
    # pieces between the places and the places themselves; where nothing is found the text is not touched
    may = F.col("text").rlike(r"\d|@")
    p, look = free_name(docs, "pii_places"), free_name(docs, "pii_pattern")
    rows = docs.withColumn(look, F.concat(F.lit(ANY), F.when(F.col("text").rlike(CARD_AT), _cards(F.col("text"))).otherwise(F.lit(""))))
    places = F.when(may, F.regexp_extract_all("text", F.col(look), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(p, F.coalesce(places, F.array().cast("array<string>")))
    new = F.array_join(F.zip_with(F.split("text", F.col(look), -1), F.transform(p, lambda m: _pseudonym(m, key)),
                                  lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")
    out = {"text": F.when(F.size(p) > 0, new).otherwise(F.col("text"))}
    if found:
        out[found] = F.size(F.filter(p, _valid)).cast("long")
    return rows.withColumns(out).drop(p, look)
