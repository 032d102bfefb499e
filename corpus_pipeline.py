"""The corpus pipeline: documents in, a deduplicated, decontaminated, pseudonymised mix out.

``run`` applies STAGES in order; every stage is written as Parquet to the shared folder and read again, so a lost
executor costs one stage at most. A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covenant.llm import contamination, langcrf, mixing, pii, simhash
from covenant.llm.tables import read
from covenant.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """CRF language ID: documents without one (null or letterless texts) go, mixed and short ones stay."""
    return langcrf.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: one document of each component stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return contamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become format-preserving pseudonyms; no document goes."""
    return pii.pseudonymise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as often as the mix takes it."""
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("pii_pseudonyms", pseudonyms), ("mix_sources", mix_sources)]

ORACLE_SQL = None   # trained, hashed and iterative stages: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
