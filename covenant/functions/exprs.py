"""Small column expressions shared by operators (all built-in Spark functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUM_MONEY = T.DecimalType(38, 6)
ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def col_(c) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def zero_money() -> Column:
    """A money zero typed like the money sums."""
    return F.lit(0).cast(SUM_MONEY)


def rate_1dp(part, whole) -> Column:
    """ROUND(part * 100.0 / whole, 1) computed in integers, returned as double.

    Integer arithmetic rounds half away from zero exactly like decimal ROUND,
    with no binary floating point tie ambiguity.
    """
    p, w = col_(part).cast("long"), col_(whole).cast("long")
    q = F.lit(2000) * p + w
    d = F.lit(2) * w
    # q - pmod(q, d) is an exact multiple of d, so the division is exact
    return F.when(w > 0, ((q - F.pmod(q, d)) / d).cast("long") / F.lit(10.0))


def dec_mean(total, n, scale: int = 6) -> Column:
    """Exact decimal mean total / n rounded half-up to ``scale`` digits."""
    t = col_(total).cast(SUM_MONEY)
    return F.round(t / col_(n).cast("long"), scale).cast(T.DecimalType(38, scale))


def iso_ms(ts) -> Column:
    """ISO-8601 text with milliseconds and a Z suffix (the item-store time format)."""
    return F.date_format(col_(ts), ISO_MS)


def parse_iso(s) -> Column:
    """ISO ms text -> TIMESTAMP_NTZ; text that is not a time (e.g. a uuid) -> NULL."""
    return F.try_to_timestamp(col_(s), F.lit(ISO_MS)).cast("timestamp_ntz")


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col_(ts))


def latest_first_key(ts, tie) -> Column:
    """Sort key whose *minimum* is the latest row: NULL time first (PostgreSQL
    DESC NULLS FIRST), then the newest time, then the lowest ``tie`` value."""
    t = col_(ts)
    return F.struct(t.isNotNull().alias("k0"), (-epoch_micros(t)).alias("k1"), col_(tie).alias("k2"))


def falsy_null(c) -> Column:
    """JS falsiness for strings: '' behaves like a missing value."""
    return F.nullif(col_(c), F.lit(""))


def first_truthy(*cols) -> Column:
    """The first value that is neither NULL nor empty text (JS `a || b || c`)."""
    return F.coalesce(*[falsy_null(c) for c in cols])


def strip_prefix(c, prefix: str) -> Column:
    """Remove a literal leading prefix (first occurrence at the start only)."""
    c = col_(c)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)
