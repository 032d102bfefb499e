"""Deterministic synthetic dataset (contracts, events, ledger).

Rows are generated in parallel from ``spark.range``; every random choice is a
hash of (seed, salt, row id), so a task recomputed after an executor loss
yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from covenant.sources.binding import Tables
from covenant.sources.schemas import MONEY

# ---- fixed values of the generator ----
STATUSES = ["Bound", "Pending_Judgment", "Redeemed", "Condemned"]
SOUL_TYPES = ["Innocent", "Sinner", "Corrupt", "Evil", "Murderer", "Betrayer"]
LOCATIONS = ["Highway_66", "Desert_Crossroads", "Abandoned_Church", "City_Alley", "Graveyard", "Hell_Gate"]
FIRST_EVENT = "Contract Created"
OTHER_EVENT = "Status Change"
LEDGER_TEXT = "Soul power transaction: {amount}"
DEFAULTS = {"contracts": 1000, "events_per_contract": 50, "ledger_entries": 5000}
DAY_MS = 24 * 60 * 60 * 1000


def _u(seed: int, salt: str, *cols: Column) -> Column:
    """Uniform [0, 1) from a hash of (seed, salt, cols)."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), *cols)
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def _pick(values, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def _as_int(v, minimum: int):
    try:
        n = int(str(v).strip()) if v is not None else None
    except ValueError:
        return None
    return n if n is not None and n >= minimum else None


def resolve_counts(contracts=None, events_per_contract=None, ledger_entries=None) -> tuple[int, int, int]:
    """Counts from arguments, falling back to the defaults when an argument is
    missing or invalid (contracts must be > 0, the others >= 0)."""
    c = _as_int(contracts, 1)
    e = _as_int(events_per_contract, 0)
    l = _as_int(ledger_entries, 0)
    return (DEFAULTS["contracts"] if c is None else c,
            DEFAULTS["events_per_contract"] if e is None else e,
            DEFAULTS["ledger_entries"] if l is None else l)


def validate_counts(contracts, events_per_contract, ledger_entries) -> tuple[int, int, int]:
    """Counts: contracts > 0, the others >= 0 (integers)."""
    c, e, l = int(contracts), int(events_per_contract), int(ledger_entries)
    if c <= 0 or e < 0 or l < 0:
        raise ValueError("contracts must be > 0; events_per_contract and ledger_entries >= 0")
    return c, e, l


def generate(spark: SparkSession, contracts: int = 1000, events_per_contract: int = 50,
             ledger_entries: int = 5000, seed: int = 42, now: str = "2025-01-01 00:00:00",
             loss_fraction: float = 0.0, num_partitions: int | None = None) -> Tables:
    """A deterministic synthetic store (contracts, events per contract, random ledger rows)."""
    n_c, n_e, n_l = validate_counts(contracts, events_per_contract, ledger_entries)
    pad = max(3, len(str(n_c)))
    now_ts = F.lit(now).cast("timestamp_ntz")
    parts = num_partitions or max(1, spark.sparkContext.defaultParallelism)
    i = F.col("id") + 1
    base = spark.range(0, n_c, numPartitions=parts)
    stype = _pick(SOUL_TYPES, _u(seed, "type", i))
    loc = _pick(LOCATIONS, _u(seed, "location", i))
    created_ms = (_u(seed, "created", i) * F.lit(365 * DAY_MS)).cast("long")
    c = base.select(
        F.concat_ws("_", F.lower(stype), F.lower(loc), F.lpad(i.cast("string"), pad, "0")).alias("id"),
        _pick(STATUSES, _u(seed, "status", i)).alias("contract_status"),
        stype.alias("soul_type"), loc.alias("contract_location"),
        F.timestamp_add("MILLISECOND", -created_ms, now_ts).alias("updated_at"),
        F.col("id").alias("_n"))
    events = (c.select("id", "updated_at", "_n",
                       F.explode(F.sequence(F.lit(1), F.lit(n_e))).alias("j")) if n_e > 0 else
              c.select("id", "updated_at", "_n", F.lit(1).alias("j")).where(F.lit(False)))
    e = events.select(
        F.sha2(F.concat_ws("|", F.lit("event"), F.col("id"), F.col("j").cast("string")), 256).alias("id"),
        F.col("id").alias("soul_contract_id"),
        F.timestamp_add("MINUTE", F.col("j"), F.col("updated_at")).alias("event_time"),
        F.when(F.col("j") == 1, F.lit(FIRST_EVENT)).otherwise(F.lit(OTHER_EVENT)).alias("description"))
    lrows = spark.range(0, n_l, numPartitions=parts)
    k = F.col("id")
    owner = F.floor(_u(seed, "owner", k) * n_c).cast("long")
    mag = (F.floor(_u(seed, "amount", k) * 1000) + 1).cast("long")
    sign = F.when(_u(seed, "loss", k) < loss_fraction, F.lit(-1)).otherwise(F.lit(1))
    amount = (mag * sign)
    ago = (_u(seed, "ltime", k) * F.lit(30 * DAY_MS)).cast("long")
    ids = c.select(F.col("_n").alias("owner"), F.col("id").alias("cid"))
    lg = lrows.select(
        F.sha2(F.concat_ws("|", F.lit("ledger"), k.cast("string")), 256).alias("id"),
        owner.alias("owner"), amount.cast(MONEY).alias("amount"),
        F.timestamp_add("MILLISECOND", -ago, now_ts).alias("transaction_time"),
        F.concat(F.lit(LEDGER_TEXT.split("{")[0]), amount.cast("string")).alias("description"))
    # owner -> contract id is a 1:1 key join (no skew beyond the data itself)
    lg = lg.join(ids, "owner").select("id", F.col("cid").alias("soul_contract_id"), "amount",
                                     "transaction_time", "description")
    return Tables(c.drop("_n"), e, lg)


def seed_contracts(spark: SparkSession, **kw):
    """The generated contracts (see ``generate``)."""
    return generate(spark, **kw).contracts


def seed_events(spark: SparkSession, **kw):
    """The generated events."""
    return generate(spark, **kw).events


def seed_ledger(spark: SparkSession, **kw):
    """The generated ledger rows."""
    return generate(spark, **kw).ledger
