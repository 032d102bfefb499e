"""Skew-safe position of a row inside its group (0-based), for ordered comparisons
and nearest-rank percentiles.

``Window.partitionBy(group).orderBy(...)`` sends a whole group to one task; when
one group holds a third of the data that task does a third of the work. Here
the rows are range-partitioned on (group, order), so a hot group is split over
many partitions; each partition numbers its slice locally and the per-slice
row counts (one row per partition x group, a small table) give each slice its
offset. No task ever holds more than one range partition of rows.

Cost: one range shuffle whose result is written to the shared folder, one hash
shuffle for the per-slice numbering, and small shuffles of the per-slice counts
(one row per slice and group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.session import materialize


def group_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                    pos_col: str = "pos", num_partitions: int | None = None,
                    size_col: str | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based position of the row in its group under ``order``)
    and, with ``size_col``, the group's row count (from the same slice counts)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    group_cols = [F.col(g) for g in group]
    # one struct key per group: never NULL itself and equal when its fields are
    # equal (NULL fields included), so a NULL group value is a group of its own
    # and every join below is a plain equi-join on (_slice, _gk)
    # the bounds of a range shuffle are sampled: the sliced rows are written once, so that the numbering and the
    # counts below see the same slices whatever columns each of them reads
    sliced = materialize(df.repartitionByRange(n, *group_cols, *order_cols).withColumn("_slice", F.spark_partition_id()),
                         "positions").withColumn("_gk", F.struct(*group_cols))
    local = sliced.withColumn(
        "_lrn", F.row_number().over(Window.partitionBy("_slice", "_gk").orderBy(*order_cols)))
    counts = sliced.groupBy("_slice", "_gk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy("_gk").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_cnt").over(Window.partitionBy("_gk")).alias("_size")] if size_col else []
    offsets = counts.select("_slice", "_gk", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                            *extra)
    j = local.join(offsets, ["_slice", "_gk"], "inner")
    out = j.withColumn(pos_col, (F.col("_off") + F.col("_lrn") - 1).cast("long"))
    if size_col:
        out = out.withColumn(size_col, F.col("_size").cast("long")).drop("_size")
    return out.drop("_slice", "_gk", "_lrn", "_off")


def prefix_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column],
                num_partitions: int | None = None) -> DataFrame:
    """Add running totals over the whole table: ``sums`` maps a new column to the value it sums up, the row's own
    included, in the total order ``order`` (rows that compare equal must be told apart by it).

    The rows are range-partitioned on ``order`` and written once; every slice sums up its own rows, and one row of
    totals per slice (as many as partitions) gives each slice its start. No task holds more than a slice.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sliced = materialize(df.withColumns(sums).repartitionByRange(n, *order_cols).withColumn("_slice", F.spark_partition_id()),
                         "prefix-sums")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
              .select("_slice", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums]))
    within = Window.partitionBy("_slice").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.withColumns({c: F.sum(c).over(within) for c in sums}).join(F.broadcast(starts), "_slice")
    return out.withColumns({c: F.col(c) + F.col(f"_b_{c}") for c in sums}).drop("_slice", *[f"_b_{c}" for c in sums])


def ranks(df: DataFrame, value: str, rank_col: str = "rank", dense_col: str = "dense_rank") -> DataFrame:
    """Add ``rank()`` and ``dense_rank()`` of every row by ``value``, greatest first (null before all), equal values alike.

    Rows are counted per distinct value first; the counts' running totals give a value its rank and the number of values
    before it its dense rank. No window spans the rows, and a value that many rows share is one row until the join back.
    """
    counts = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    upto = prefix_sums(counts, [F.col("_value").desc_nulls_first()], {"_upto": F.col("_n"), dense_col: F.lit(1).cast("long")})
    keyed = upto.select("_value", (F.col("_upto") - F.col("_n") + 1).alias(rank_col), dense_col)
    return df.join(keyed, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
