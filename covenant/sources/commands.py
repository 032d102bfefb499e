"""Command sources. Each record is one request body (JSON text) in ``value``, with its place in the source.

The place identifies a request: partition and offset on a message bus (or a log that carries them as columns), else file
and line. It does not depend on how Spark splits the files, on the other files of a batch, or on what the body says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_SEQ = 1 << 61           # the ids derived from a place's number, -(2*seq + 2), stay inside BIGINT
OFFSET_BITS = 48            # of a place with an offset: the partition stands above
MAX_PARTITION = MAX_SEQ >> OFFSET_BITS
# where a record comes from: file, its block and its row there, or partition and offset
ORIGIN = ("origin_file", "origin_block", "origin_row", "origin_partition", "origin_offset")


def read_commands(spark: SparkSession, path: str | None = None, streaming: bool = False,
                  max_files_per_trigger: int | None = None, format: str = "text",
                  options: dict | None = None, schema: str | None = None) -> DataFrame:
    """Raw request bodies as a string ``value`` column and the origin columns, batch or Structured Streaming.

    ``format`` is any Spark source whose records carry the body in ``value``:
    ``text`` (one body per line, the default), ``json``/``parquet`` files with a
    ``value`` column, or a message bus such as ``kafka`` (its connector package
    must be on the classpath; the binary ``value`` is read as UTF-8 text).
    Columns ``partition`` and ``offset`` of the source are the place; without
    them it is the file and the row in it. ``schema`` is needed to stream from
    json or parquet files.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(format)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if schema:
        reader = reader.schema(schema)
    if streaming and max_files_per_trigger and format not in ("kafka",):
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(path) if path is not None else reader.load()

    def typed(c: Column | str | None, kind: str, name: str) -> Column:
        return (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kind).alias(name)

    offset = "offset" if "offset" in df.columns else None
    files = offset is None and format != "kafka"
    return df.select(
        F.col("value").cast("string").alias("value"),
        typed("_metadata.file_path" if files else None, "string", "origin_file"),
        typed("_metadata.file_block_start" if files else None, "long", "origin_block"),
        typed("_metadata.row_index" if files and format == "parquet" else None, "long", "origin_row"),
        typed("partition" if offset and "partition" in df.columns else None, "long", "origin_partition"),
        typed(offset, "long", "origin_offset"))


def with_places(raw: DataFrame) -> DataFrame:
    """``raw`` with a column ``seq``, the number of each record's place, instead of the origin columns.

    partition and offset: ``partition << 48 | offset``, exact (an error beyond 2^13 partitions or 2^48 offsets). File and
    row: a 61-bit hash of the path and the row's number in the file. Text and json files name no row numbers: rows are
    counted per block (a task reads a block from its start, so ids that ascend within a task number its rows), and the
    counts of a file's blocks, one row per block, give each block its first row number.
    """
    part, off = F.coalesce("origin_partition", F.lit(0)), F.col("origin_offset")
    in_range = (part >= 0) & (part < MAX_PARTITION) & (off >= 0) & (off < (1 << OFFSET_BITS))
    exact = F.when(in_range, F.shiftleft(part, OFFSET_BITS) + off).otherwise(
        F.raise_error(F.concat(F.lit("request place out of range: partition "), part.cast("string"), F.lit(", offset "), off.cast("string"))))
    rows = raw.withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.where("origin_offset is null and origin_row is null").groupBy("origin_file", "origin_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("origin_file").orderBy("origin_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("origin_file").alias("_file"), F.col("origin_block").alias("_block"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counted = rows.where("origin_offset is null and origin_row is null").join(
        blocks, F.col("origin_file").eqNullSafe(F.col("_file")) & F.col("origin_block").eqNullSafe(F.col("_block")), "left")
    kept = [c for c in raw.columns if c not in ORIGIN]

    def hashed(line: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("origin_file", F.lit("")), line), F.lit(MAX_SEQ))

    # records that name their place meet no block: without a file and a block, all of a log would be one key
    named = raw.where("origin_offset is not null or origin_row is not null")
    return named.select(*kept, F.when(off.isNotNull(), exact).otherwise(hashed(F.col("origin_row"))).alias("seq")).unionByName(
        counted.select(*kept, hashed(F.col("_before") + F.col("_id") - F.col("_first")).alias("seq")))
