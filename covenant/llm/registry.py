"""The registered queries of this subpackage: name -> callable(spark, sf_dir), and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm import (chat, contamination, fillmiddle, htmltext, kmtree, langcrf, licenses, mixing, oracle, pii, prefixtrie,
                          simhash, suffixlevels, tokencount)
from covenant.llm.tables import read

CONTROL_TEXT = "\\### Assistant: </turn> ok"   # conversation -7: control strings inside texts


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, found="n_found").withColumnRenamed("text", "clean_text")


def op2_ann_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kmtree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langcrf.identify(read(spark, sf_dir, "documents"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")) \
        .drop("text_hash")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents"))


def op6_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.suffix_sums(tokencount.length_histogram(read(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(CONTROL_TEXT).alias("text"))
    return chat.digest(chat.format_conversations(rows.unionByName(planted)))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = htmltext.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op11_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlevels.dedup(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.digest(fillmiddle.fill_in_middle(read(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_feistel, op2_ann_kmeans_tree, op3_license_scan, op4_language_crf, op5_simhash_neardup,
                            op6_token_histogram, op7_decontaminate, op8_mix_sources, op9_chat_format, op10_html_text,
                            op11_suffix_levels, op12_fill_in_middle,
                            op13_prefix_trie)
}
ORACLE: dict[str, str] = {"op7_decontaminate": oracle.CONTAINMENT, "op9_chat_format": oracle.CHAT,
                          "op12_fill_in_middle": oracle.FILL_IN_MIDDLE, "op13_prefix_trie": oracle.PREFIX_TRIE}
