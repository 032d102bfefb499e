"""Prefix trie of conversations by fixed-length block hashing.

1. Every turn has a digest of (role, text); a block digest combines the digests of ``BLOCK`` turns with their places, and
   the digests of a conversation's blocks so far name its prefix (128 bits).
2. Conversations are grouped by the prefix before a block. Where all block digests of a group are equal, one member
   stands for the whole block. Only blocks where siblings diverge are refined: there every member's turns count.
3. Subtrees need no walk: conversations sorted by their refined turns stand in trie order, a subtree is an interval of
   that order, and its sums are differences of distributed running totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.operators.positional import group_positions, prefix_sums
from covenant.session import materialize

BLOCK = 4            # turns of a block
SUPER = 4_096        # blocks of a conversation whose prefixes one window combines
GRAFT_EVERY, GRAFT_MOST = 100, 6
IDS_PER_CHUNK = 4_096


def _digest(salt: int):
    return F.xxhash64(F.lit(salt), F.col("depth"), F.col("t"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 0, turns, t, chars): turns in order (null first, equal ones by digest) with their digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.length(text).cast("long").alias("chars"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("t"))
    return group_positions(rows, ["conv"], [F.col("turn").asc_nulls_first(), "t"], size_col="turns").drop("turn")


def grafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: the first h turns of a conversation come from the first of its hundred.

    turns: (conv, depth from 1, t, chars); conversations: (conv, size), also those left without turns.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(GRAFT_MOST))
    convs = turns.where("pos = 0").select("conv", "turns", h.alias("h"), (F.col("conv") - F.col("conv") % GRAFT_EVERY).alias("base"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    convs = materialize(convs.join(sizes, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("head"), "turns"), "trie-convs")
    heads = (turns.where(F.col("pos") < GRAFT_MOST).withColumnRenamed("conv", "base").drop("turns")
             .join(convs.select("conv", "base", "h"), "base").where("pos < h")
             .select("conv", (F.col("pos") + 1).alias("depth"), "t", "chars"))
    tails = (turns.where(F.col("pos") >= h).drop("turns").join(convs.select("conv", "h", "head"), "conv")
             .select("conv", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("depth"), "t", "chars"))
    size = (F.col("head") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("size")
    return heads.unionByName(tails), convs.select("conv", size)


def block_prefixes(turns: DataFrame) -> DataFrame:
    """(conv, b, y1, y2, p1, p2): the block digest and the digest of all blocks before."""
    blocks = turns.groupBy("conv", "b").agg(F.bit_xor("u1").alias("y1"), F.bit_xor("u2").alias("y2")) \
        .withColumn("s", F.floor(F.col("b") / SUPER))
    inside = Window.partitionBy("conv", "s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("conv").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    supers = blocks.groupBy("conv", "s").agg(F.bit_xor("y1").alias("s1"), F.bit_xor("y2").alias("s2"))
    supers = supers.select("conv", "s", *[F.coalesce(F.bit_xor(f"s{i}").over(above), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    blocks = blocks.withColumns({f"p{i}": F.coalesce(F.bit_xor(f"y{i}").over(inside), F.lit(0)) for i in (1, 2)})
    return blocks.join(supers, ["conv", "s"]).select(
        "conv", "b", "y1", "y2", *[F.col(f"p{i}").bitwiseXOR(F.col(f"s{i}")).alias(f"p{i}") for i in (1, 2)])


GROUP = ["b", "p1", "p2"]
NODE = ["depth", "q1", "q2"]


def _with_prefix(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """Turns of ``blocks`` with the digest of the prefix that ends in them (q1, q2) and of the one before (o1, o2)."""
    rows = turns.join(blocks, ["conv", "b"])
    upto = Window.partitionBy("conv", "b").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"q{i}": F.bit_xor(f"u{i}").over(upto).bitwiseXOR(F.col(f"p{i}")) for i in (1, 2)})
    return rows.withColumns({f"o{i}": F.col(f"q{i}").bitwiseXOR(F.col(f"u{i}")) for i in (1, 2)})


def _hash_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of ids, all of a node together, to one digest per node; holds one chunk at a time."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([state.hexdigest()], pa.string())],
                                          names=[*NODE, "ends_sha256"])

    for b in it:
        for *key, ids in zip(*(c.to_pylist() for c in b.columns)):
            if key != node:
                if node is not None:
                    yield row()
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if node is not None:
        yield row()


def end_digests(convs: DataFrame) -> DataFrame:
    """(depth, q1, q2, ends_sha256) from (conv, depth, q1, q2): the ids that end in a node, ascending, comma-joined.

    SHA-256 reads a node's ids one after the other, so they meet in one task, as a stream of chunks of at most
    ``IDS_PER_CHUNK`` ids that were joined before.
    """
    chunk = F.floor(F.col("conv") / IDS_PER_CHUNK).alias("chunk")
    ids = F.array_join(F.sort_array(F.collect_list("conv")), ",")
    return (convs.groupBy(*NODE, chunk).agg(ids.alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
            .select(*NODE, "ids").mapInArrow(_hash_ids, "depth long, q1 long, q2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes from turns (conv, depth, t, chars) and conversations (conv, size); columns as ``trie`` says."""
    turns = materialize(turns.select("conv", F.col("depth").cast("long").alias("depth"), "chars", _digest(1).alias("u1"),
                                     _digest(2).alias("u2"), F.floor((F.col("depth") - 1) / BLOCK).alias("b")), "trie-turns")
    blocks = materialize(block_prefixes(turns), "trie-blocks")
    apart = (F.min("y1") != F.max("y1")) | (F.min("y2") != F.max("y2"))
    diverging = blocks.groupBy(*GROUP).agg(apart.alias("split")).where("split").drop("split")

    # trie order: by the refined turns, then by length
    fine = _with_prefix(turns, blocks.join(diverging, GROUP, "left_semi").select("conv", *GROUP))
    keys = fine.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "q1", "q2"))).alias("path"))
    ordered = prefix_sums(convs.join(keys, "conv", "left").withColumn("path", F.coalesce("path", F.array().cast(
        "array<struct<depth:bigint,q1:bigint,q2:bigint>>"))), ["path", "size", "conv"], {"rank": F.lit(1).cast("long")})
    ordered = materialize(ordered.select("conv", "size", "rank"), "trie-order")

    # one member of a uniform group, every member of a diverging one
    ranked = blocks.join(ordered.select("conv", "rank"), "conv")
    groups = ranked.groupBy(*GROUP).agg(apart.alias("split"), F.min("conv").alias("owner"), F.count("*").alias("n"),
                                        F.min("rank").alias("first"), F.max("rank").alias("last"))
    speak = ranked.join(groups, GROUP).where("split or conv = owner").select(
        "conv", *GROUP, "split", F.when(F.col("split"), 1).otherwise(F.col("n")).alias("n"),
        F.when(F.col("split"), F.col("rank")).otherwise(F.col("first")).alias("first"),
        F.when(F.col("split"), F.col("rank")).otherwise(F.col("last")).alias("last"))
    nodes = _with_prefix(turns, speak).groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.first("o1").alias("o1"), F.first("o2").alias("o2"), F.first("chars").alias("chars"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id", "n_convs", F.lit(1).cast("long").alias("first"),
        F.col("n_convs").alias("last"), *[F.lit(None).cast("long").alias(c) for c in ("o1", "o2")], F.lit(0).cast("long").alias("chars"))
    nodes = materialize(nodes.unionByName(root), "trie-nodes")

    up = [(F.col("depth") - 1).alias("depth"), F.col("o1").alias("q1"), F.col("o2").alias("q2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    rows = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    rows = rows.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    before = prefix_sums(rows, ["first", "depth"], {"leaves": F.col("leaf"), "savings": F.col("saved")})
    own = before.groupBy(F.col("first").alias("rank")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    upto = ordered.join(own, "rank", "left").select("rank", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("leaf", "saved")])
    upto = prefix_sums(upto, ["rank"], {"to_leaf": F.col("leaf"), "to_saved": F.col("saved")}).select(
        F.col("rank").alias("last"), "to_leaf", "to_saved")

    whole = blocks.groupBy("conv").agg(F.bit_xor("y1").alias("q1"), F.bit_xor("y2").alias("q2"))
    ends = end_digests(convs.join(whole, "conv", "left").select(
        "conv", F.col("size").alias("depth"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("q1", "q2")]))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("o1"), F.col("q2").alias("o2"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (before.join(upto, "last").join(parents, ["depth", "o1", "o2"], "left").join(ends, NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                    (F.col("to_leaf") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
                    (F.col("to_saved") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per node.

    Conversations are rebuilt first (``grafted``). Null roles and texts are empty, turns of equal number stand in the
    order of their digests, repeated rows are turns of their own; rows without a conv_id belong to no conversation.
    An empty table has no node, not even a root. Other columns are not carried.
    """
    return prefix_trie(*grafted(turn_rows(conversations.select("conv_id", "turn", "role", "text"))))
