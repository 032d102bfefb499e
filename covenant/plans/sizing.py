"""Size-checked broadcast.

``broadcast_within`` compares Catalyst's size estimate (file sizes, no job) with a
bound in bytes.
``broadcast_if_small`` counts a (dimension-like) side once and hints a
broadcast only when the count is under a bound; beyond it the join is left
to Spark (shuffle join, AQE may still convert it at runtime). The check is
one cheap aggregate per DataFrame and session, memoized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# rows a hinted broadcast side may hold (a few MB for narrow dimension rows)
DEFAULT_MAX_ROWS = 100_000
# bytes of files (or of a local table) behind a broadcast side
BROADCAST_BYTES = 8 << 20
_COUNTS: dict[tuple, tuple[DataFrame, int]] = {}


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes: file sizes, an upper bound after filters and aggregates. No job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_within(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` if its plan's size is within ``max_bytes``; beyond it the join is left to Spark."""
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df


def bounded_count(df: DataFrame, limit: int) -> int:
    """Row count, but never counts past ``limit + 1`` rows (memoized per frame;
    the memo keeps the frame itself so an id is never reused for another one)."""
    key = (df.sparkSession.sparkContext.applicationId, id(df), limit)
    hit = _COUNTS.get(key)
    if hit is None or hit[0] is not df:
        hit = _COUNTS[key] = (df, df.limit(limit + 1).agg(F.count(F.lit(1))).first()[0])
    return hit[1]


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` only when it holds at most ``max_rows`` rows."""
    return F.broadcast(df) if bounded_count(df, max_rows) <= max_rows else df


def sort_bounded(df: DataFrame, *order) -> DataFrame:
    """Final ordering of a result whose row count is bounded by a dimension
    (one row per location, per day, per system...). The rows move to a single
    partition after the last aggregation and are sorted there: no range
    sampling job, and the aggregation itself stays parallel."""
    return df.repartition(1).sortWithinPartitions(*order)
