"""Explicit schemas of the domain (normalized tables, items, commands, measurements)."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 6)

CONTRACTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("contract_status", T.StringType()),
    T.StructField("soul_type", T.StringType()),
    T.StructField("contract_location", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("soul_contract_id", T.LongType(), False),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("description", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("soul_contract_id", T.LongType(), False),
    T.StructField("amount", MONEY),
    T.StructField("transaction_time", T.TimestampNTZType()),
    T.StructField("description", T.StringType()),
])

# One wide nullable struct for the key-value item table: every attribute any
# writer (seeder, command handler, demo write) may put on an item.
ITEMS = T.StructType([
    T.StructField("PK", T.StringType(), False),
    T.StructField("SK", T.StringType(), False),
    T.StructField("soulId", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("contract_status", T.StringType()),
    T.StructField("soul_type", T.StringType()),
    T.StructField("contract_location", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("transaction_time", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("description", T.StringType()),
    T.StructField("GSI1PK", T.StringType()),
    T.StructField("GSI1SK", T.StringType()),
    # camelCase spellings some readers fall back to (no writer produces them)
    T.StructField("updatedAt", T.StringType()),
    T.StructField("soulType", T.StringType()),
    T.StructField("contractLocation", T.StringType()),
])

COMMANDS = T.StructType([
    T.StructField("contract_id", T.LongType()),
    T.StructField("new_status", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
])

MEASUREMENTS = T.StructType([
    T.StructField("scenario", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("iteration", T.LongType()),
    T.StructField("elapsed_ms", T.DoubleType()),
])

ISSUES = T.StructType([
    T.StructField("contract_id", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("left_value", T.StringType()),
    T.StructField("right_value", T.StringType()),
])
