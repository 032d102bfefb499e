"""Scan of run-history JSON files (one JSON object per file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: file-name prefixes of run-history files ----
HISTORY_PREFIXES = ("benchmark-results-", "contrast-benchmark-")
PARSE_ERROR = "Failed to parse"
NAME_PATTERN = r"^[A-Za-z0-9._-]+\.json$"


def _files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return raw.select(
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.try_parse_json("value").alias("doc"))


def _shape(df: DataFrame) -> DataFrame:
    doc = F.col("doc")
    return df.select(
        "filename", "size", "modified",
        F.try_variant_get(doc, "$.timestamp", "string").alias("timestamp"),
        F.to_json(F.coalesce(F.try_variant_get(doc, "$.summary", "variant"),
                             F.try_variant_get(doc, "$.scenarios", "variant"))).alias("summary"),
        F.when(doc.isNull(), F.lit(PARSE_ERROR)).alias("error"))


def run_history(spark: SparkSession, path: str, limit: int = 5) -> DataFrame:
    """Newest ``limit`` history files (by modification time): name, timestamp,
    summary (or scenarios) as JSON text, size; unparsable files give an error row."""
    f = _files(spark, path)
    cond = None
    for p in HISTORY_PREFIXES:
        c = F.col("filename").startswith(p)
        cond = c if cond is None else cond | c
    return _shape(f.where(cond)).orderBy(F.desc("modified"), F.asc("filename")).limit(limit)


def run_by_name(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One history file by name; names outside ``[A-Za-z0-9._-]+.json`` are refused."""
    import re
    if not re.match(NAME_PATTERN, name):
        raise ValueError("invalid file name")
    return _shape(_files(spark, path).where(F.col("filename") == name))
