"""Binding of the driver's TPC-H-like tables to the contract domain.

The same definition is spelled in SQL in ``covenant.plans.oracle`` so that the
DuckDB oracle sees identical inputs. All of it is lazy DataFrame code: scans are
pruned and filters pushed by Catalyst into the parquet readers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.plans.sizing import broadcast_within
from covenant.sources.schemas import MONEY

# ---- fixed values of the binding (must stay equal to the SQL oracle) ----
# market segment -> contract status
SEGMENT_STATUS = {
    "BUILDING": "Redeemed",
    "AUTOMOBILE": "Bound",
    "MACHINERY": "Pending_Judgment",
}
OTHER_STATUS = "Condemned"
# id % 6 -> soul type
SOUL_TYPES = ["Innocent", "Sinner", "Corrupt", "Evil", "Murderer", "Betrayer"]
# event types that act as commands, and the status each one sets
COMMAND_STATUS = {"purchase": "Redeemed", "signup": "Bound", "error": "Condemned"}
# event types used as the two measured systems
MEASURED_SYSTEMS = ["click", "view"]
# perturbation that derives the second ("right") store from the first
RIGHT_DROP_CONTRACT_MOD = 97
RIGHT_STATUS_MOD = 89
RIGHT_TYPE_NULL_MOD = 83
RIGHT_DROP_LEDGER_MOD = 1013
RIGHT_AMOUNT_MOD = 1009
RIGHT_DESC_NULL_MOD = 997


@dataclass(frozen=True)
class Tables:
    contracts: DataFrame
    events: DataFrame
    ledger: DataFrame

    def with_(self, **kw) -> "Tables":
        return replace(self, **kw)


# Resolved table readers, per session and path. Like Spark's own relation
# metadata cache, a reader keeps the file listing it resolved; call
# ``refresh_tables()`` after the files under a directory change.
_READERS: dict[tuple, DataFrame] = {}
_TABLES: dict[tuple, "Tables"] = {}


def _session_key(spark: SparkSession) -> tuple:
    return (spark.sparkContext.applicationId, id(spark))


def refresh_tables() -> None:
    """Forget the resolved readers and derived plans (after files changed on disk)."""
    _READERS.clear()
    _TABLES.clear()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (*_session_key(spark), f"{sf_dir}/{name}.parquet")
    df = _READERS.get(key)
    if df is None:
        df = _READERS[key] = spark.read.parquet(key[-1])
    return df


def _case(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def soul_type_of(id_col: Column) -> Column:
    """Contract type from the id: the id modulo the number of types picks one."""
    return F.element_at(F.array(*[F.lit(s) for s in SOUL_TYPES]),
                        (F.pmod(id_col, F.lit(len(SOUL_TYPES))) + 1).cast("int"))


def load_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts from customers: status from the segment, type from the id,
    location from the nation, time = the last order date."""
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation").select(
        F.col("n_nationkey"), F.col("n_name").alias("contract_location"))
    last_order = (_read(spark, sf_dir, "orders")
                  .groupBy(F.col("o_custkey"))
                  .agg(F.max("o_orderdate").alias("updated_at")))
    c = customer.select(
        F.col("c_custkey").alias("id"),
        _case(F.col("c_mktsegment"), SEGMENT_STATUS, OTHER_STATUS).alias("contract_status"),
        soul_type_of(F.col("c_custkey")).alias("soul_type"),
        F.col("c_nationkey"),
    )
    # nation is a dimension: broadcast behind a check of its size (a shuffle join
    # on a 25-value key would put every customer of a nation in one task)
    c = c.join(broadcast_within(nation), c.c_nationkey == nation.n_nationkey, "left")
    c = c.join(last_order, c.id == last_order.o_custkey, "left")
    return c.select("id", "contract_status", "soul_type", "contract_location", "updated_at")


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract events from the event stream (event type as the description)."""
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("soul_contract_id"),
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("description"),
    )


def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows from orders (amount negative for status P, so losses occur)."""
    o = _read(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("soul_contract_id"),
        amount.cast(MONEY).alias("amount"),
        F.col("o_orderdate").alias("transaction_time"),
        F.col("o_orderpriority").alias("description"),
    )


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The three normalized relations, typed, lazily bound to the driver tables."""
    key = (*_session_key(spark), sf_dir)
    t = _TABLES.get(key)
    if t is None:
        t = _TABLES[key] = Tables(load_contracts(spark, sf_dir), load_events(spark, sf_dir),
                                  load_ledger(spark, sf_dir))
    return t


def right_store(t: Tables) -> Tables:
    """A second copy of the store with deterministic drift (missing rows, changed values)."""
    c = (t.contracts
         .where(F.pmod("id", F.lit(RIGHT_DROP_CONTRACT_MOD)) != 0)
         .withColumn("contract_status",
                     F.when(F.pmod("id", F.lit(RIGHT_STATUS_MOD)) == 0, F.lit("Condemned"))
                     .otherwise(F.col("contract_status")))
         .withColumn("soul_type",
                     F.when(F.pmod("id", F.lit(RIGHT_TYPE_NULL_MOD)) == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("soul_type"))))
    lg = (t.ledger
          .where(F.pmod("id", F.lit(RIGHT_DROP_LEDGER_MOD)) != 0)
          .withColumn("amount",
                      F.when(F.pmod("id", F.lit(RIGHT_AMOUNT_MOD)) == 0, F.col("amount") + 1)
                      .otherwise(F.col("amount")).cast(MONEY))
          .withColumn("description",
                      F.when(F.pmod("id", F.lit(RIGHT_DESC_NULL_MOD)) == 0, F.lit(None).cast("string"))
                      .otherwise(F.col("description"))))
    return Tables(c, t.events, lg)


def load_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands (contract_id, new_status, amount, ts, seq) bound to command-like events."""
    e = _read(spark, sf_dir, "events").where(F.col("event_type").isin(list(COMMAND_STATUS)))
    return e.select(
        F.col("user_id").alias("contract_id"),
        _case(F.col("event_type"), COMMAND_STATUS, None).alias("new_status"),
        F.col("value").cast(MONEY).alias("amount"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
    )


def load_command_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commands as raw JSON request bodies, one string per request."""
    c = load_commands(spark, sf_dir)
    body = F.to_json(F.struct(
        F.col("contract_id").cast("string").alias("soulContractId"),
        F.col("new_status").alias("newStatus"),
        F.col("amount").cast("double").alias("amount"),
    ))
    return c.select(F.col("seq"), F.col("ts"), body.alias("value"))


def load_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency-like samples: (scenario, system, iteration, elapsed_ms)."""
    e = _read(spark, sf_dir, "events").where(F.col("event_type").isin(MEASURED_SYSTEMS))
    return e.select(
        F.pmod(F.col("user_id"), F.lit(5)).cast("string").alias("scenario"),
        F.col("event_type").alias("system"),
        F.col("event_id").alias("iteration"),
        F.col("value").alias("elapsed_ms"),
    )
