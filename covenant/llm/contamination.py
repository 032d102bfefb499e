"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only. Items are partitioned by their number of shingles; in a partition of up to ``u`` shingles the
MinHash signature keeps the ``floor((1 - t) * u) + 1`` least shingle hashes of an item. A document that contains at
least the share t of an item's shingles misses at most ``floor((1 - t) * n)`` of them, so it holds one of the
signature: every pair is found, however long the document is (banded signatures at the tiny Jaccard similarity of a
short item and a long document would miss pairs). Candidates are verified by counting the shingles that both hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.tables import free_name
from covenant.session import materialize

SHINGLE = 5
LEAST = 0.8
BROADCAST_ROWS = 500_000   # item tables up to this many (short) rows are broadcast, larger ones are shuffled
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(ws: Column, n: int) -> Column:
    """All n-word shingles of the array, space-joined; none if it is shorter."""
    at = F.sequence(F.lit(0), F.size(ws) - n)
    return F.when(F.size(ws) >= n, F.transform(at, lambda i: F.array_join(F.slice(ws, i + 1, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n_words, shingle_words, n, shingle): the distinct shingles of every item; an item with fewer words is one
    shingle, the whole sequence. Items without a word have no row, a repeated row counts once."""
    w = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0).distinct()
    k = F.least(F.size("ws"), F.lit(shingle))
    at = F.sequence(F.lit(0), F.size("ws") - k)
    rows = w.select("item_id", "ws", k.alias("shingle_words"), F.array_distinct(F.transform(
        at, lambda i: F.array_join(F.slice("ws", i + 1, k), " "))).alias("all"))
    # items of the same id with different texts stay apart
    return rows.select("item_id", F.xxhash64(F.array_join("ws", " ")).alias("text_key"), "shingle_words",
                       F.size("all").alias("n"), F.explode("all").alias("shingle"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shared, n_item, containment): documents that hold at least ``least`` of an item's
    distinct shingles. Rows with the same doc_id and text give one row; null texts hold nothing; null ids are kept."""
    every = materialize(item_shingles(items, shingle), "items")
    lengths = [r[0] for r in every.select("shingle_words").distinct().collect()]   # at most ``shingle`` numbers
    h = F.xxhash64("shingle")
    # partition by size: up to 2^p shingles
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    depth = F.floor(F.round((1 - least) * upper, 6)) + 1
    grouped = every.groupBy("item_id", "text_key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(h)).alias("hs"))
    signature = grouped.select(F.explode(F.slice("hs", F.lit(1), depth.cast("int"))).alias("h")).distinct()
    text_hash = F.xxhash64("text")
    sh = F.concat(*[_shingles(F.col("ws"), n) for n in lengths]) if lengths else F.array().cast("array<string>")
    split = docs.select("doc_id", text_hash.alias("text_hash"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    exploded = split.select("doc_id", "text_hash", F.explode(sh).alias("shingle"))
    # signatures are few: the probe runs map-side, before anything is shuffled
    hits = exploded.withColumn("h", F.xxhash64("shingle")).join(_sized(materialize(signature, "signature")), "h")
    pairs = every.select("item_id", "text_key", "n", F.col("shingle").alias("s"), h.alias("h"))
    candidates = (hits.select("doc_id", "text_hash", "h").distinct().join(_sized(pairs.select("item_id", "text_key", "h")), "h")
                  .select("doc_id", "text_hash", "item_id", "text_key").distinct())
    candidates = materialize(candidates, "contamination-candidates")
    who = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    again = split.join(_sized(who), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi")
    again = again.select("doc_id", "text_hash", F.explode(F.array_distinct(sh)).alias("s"))
    shared = again.join(_sized(pairs.drop("h")), "s").groupBy("doc_id", "text_hash", "item_id", "text_key").agg(
        F.count_distinct("s").alias("n_shared"), F.first("n").alias("n_item"))
    return (shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= least)
            .groupBy("doc_id", "text_hash", "item_id")
            .agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
            .select("doc_id", "text_hash", "item_id", "best.n_shared", "best.n_item", "best.containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns are kept whatever their names."""
    bad = materialize(contained_items(docs, items, shingle, least).select("text_hash").distinct(), "contaminated")
    key, t = free_name(docs, "own_hash"), free_name(docs, "bad_hash")
    return docs.withColumn(key, F.xxhash64("text")).join(
        _sized(bad.withColumnRenamed("text_hash", t)), F.col(key) == F.col(t), "left_anti").select(docs.columns)
