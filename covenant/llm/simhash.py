"""SimHash near-duplicates: 64-bit fingerprints linked by a binary-trie self-join.

1. ``with_fingerprints``: one SimHash per row, in Arrow batches.
2. ``trie_links``: the distinct fingerprints are the leaves of binary tries, one for each way to turn one of
   budget + 1 pieces of the bits to the front. The nodes of a top level within that piece become Spark rows (blocks of
   leaves); every task then descends its nodes paired with themselves, adds the differing bits and drops a node pair as
   soon as the budget is exceeded.
3. ``components``: the links, already reduced to a spanning forest per node pair, are contracted to stars.

Copies share one leaf, so a group of copies costs one fingerprint whatever its size. A trie node with more leaves
than a block holds is cut into several blocks, and every pair of blocks is its own row, so no node is held by one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.tables import free_name
from covenant.session import materialize

SHINGLE = 4          # words in a shingle
MAX_BITS = 4         # fingerprints link at so many differing bits or fewer
SEED = 42
BLOCK = 1 << 18      # leaves in one block (2 MB)
TOP = 6              # least depth of the top level
DEEPEST_TOP = 16     # its greatest depth: node counts (2^depth rows a trie) stay broadcastable
NODE = 1 << 12       # wanted leaves of a node of the top level
FRONTIER = 1 << 15   # node pairs descended at once
LEAF_PAIRS = 1 << 15 # a node pair with so few leaf pairs is compared in one dense step (256 KB)
HASHED_AT_ONCE = 1 << 16
HOT_KEYS = 10_000    # a fingerprint of over a ten-thousandth of all rows is hot: there can't be more of them than this
HOT_ROWS = 64        # the least number of rows of a hot fingerprint
BLOCKS = pa.schema([("by", pa.int32()), ("node", pa.int64()), ("cut", pa.int64()), ("leaves", pa.binary())])


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text: A-Z lower-cased, words between ASCII white space, word shingles with repeats
    (fewer words: the whole sequence), XXH64 of each; a bit is 1 if set in over half of them. No word: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1:] or ends[-1:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends)
    while part := [digest(joined[a:b - 1], SEED) for a, b in itertools.islice(spans, HASHED_AT_ONCE)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(ends)).tolist())


def with_fingerprints(docs: DataFrame, column: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and a long ``column``: the fingerprint's bits as a signed number. A null text counts as empty."""
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, column])

    return docs.mapInArrow(batches, out)


class _Forest:
    """Union-find over the positions of one array, fed with arrays of links; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        new = a != b
        if not new.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[new], b[new]), np.maximum(a[new], b[new])]), axis=1)
        up = self.root
        for x, y in pairs.T.tolist():
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                x, y = min(x, y), max(x, y)
                up[y] = x
                self.edges.append((int(x), int(y)))
        while (flat := self.root[self.root]).tobytes() != self.root.tobytes():
            self.root = flat


class _Trie:
    """A binary trie over sorted distinct fingerprints: a node at depth d is the range of leaves sharing d bits."""

    def __init__(self, leaves: np.ndarray):
        self.leaves, self._ones = leaves, {}

    def cut(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the nodes' 1-children begin: the bit after ``depth`` is 0 before and 1 from there."""
        if depth not in self._ones:
            bit = (self.leaves >> np.uint64(63 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        ones = self._ones[depth]
        return hi - (ones[hi] - ones[lo])


def _dense(a: np.ndarray, b: np.ndarray, alo: int, ahi: int, blo: int, bhi: int, budget: int,
           own: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs within the budget of two short ranges of leaves (``own``: only i < j)."""
    near = np.bitwise_count(a[alo:ahi, None] ^ b[None, blo:bhi]) <= budget
    if not near.any():
        return None
    i, j = np.nonzero(near)
    i, j = i + alo, j + blo
    if own:
        i, j = i[i < j], j[i < j]
    return (i, j) if len(i) else None


def close_leaves(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (i, j) of all leaf pairs a[i], b[j] that differ in at most ``budget`` bits, without equal leaves of one
    block (``b`` None: pairs i < j within ``a``). All of a, and all of b, share their first ``depth`` bits."""
    own = b is None
    ta = _Trie(a)
    tb = ta if own else _Trie(b)
    if not len(ta.leaves) or not len(tb.leaves):
        return
    err = int(np.bitwise_count((ta.leaves[0] ^ tb.leaves[0]) >> np.uint64(64 - depth))) if depth else 0
    if err > budget:
        return
    whole = [np.array([x], np.int32) for x in (0, len(ta.leaves), 0, len(tb.leaves))]
    todo = [(depth, *whole, np.array([err], np.int8))]
    while todo:
        d, alo, ahi, blo, bhi, err = todo.pop()
        n = (ahi - alo).astype(np.int64) * (bhi - blo)
        few = n <= LEAF_PAIRS
        near = [_dense(ta.leaves, tb.leaves, *node, budget, own)
                for node in zip(*(x[few].tolist() for x in (alo, ahi, blo, bhi)))]
        near = [p for p in near if p is not None]
        if near:
            yield np.concatenate([i for i, _ in near]), np.concatenate([j for _, j in near])
        if few.all():
            continue
        alo, ahi, blo, bhi, err = (x[~few] for x in (alo, ahi, blo, bhi, err))
        am, bm = ta.cut(d, alo, ahi).astype(np.int32), tb.cut(d, blo, bhi).astype(np.int32)
        twin = (alo == blo) if own else np.zeros(len(alo), bool)
        for la, ha, lb, hb, more, skip in ((alo, am, blo, bm, 0, False), (am, ahi, bm, bhi, 0, False),
                                           (alo, am, bm, bhi, 1, False), (am, ahi, blo, bm, 1, True)):
            e = err + np.int8(more)
            keep = (la < ha) & (lb < hb) & (e <= budget)
            if skip:  # the mirror image of a node paired with itself
                keep &= ~twin
            at = np.flatnonzero(keep)
            for s in range(0, len(at), FRONTIER):
                x = at[s:s + FRONTIER]
                todo.append((d + 1, la[x], ha[x], lb[x], hb[x], e[x]))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    """Fingerprints turned left by ``by`` bits, 0 to 63."""
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def trie_links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints of the one-column table ``fps`` (long, distinct) that differ in at
    most ``max_bits`` bits, reduced to a spanning forest of each pair of blocks: what is linked stays connected.

    The bits are cut into ``max_bits + 1`` equal pieces, and there is a trie for each piece, over the fingerprints
    turned so that the piece comes first. Two fingerprints in reach are equal in one of the pieces at least, so in that
    trie they are under one node at the depth of the piece: nodes of the top level are paired with themselves only, and
    a fingerprint travels ``max_bits + 1`` times, however many node pairs a single trie would have to keep.
    """
    spark = fps.sparkSession
    fps = fps.toDF("fp")
    total = fps.count()
    width = 64 // (max_bits + 1)
    depth = min(DEEPEST_TOP, width, max(TOP, math.ceil(math.log2(max(1, total / NODE)))))
    turns = [i * width for i in range(max_bits + 1)] if depth else [0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 2)

    def turned(by: int) -> F.Column:
        return F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")

    each = F.explode(F.array(*[F.struct(F.lit(by).alias("by"), turned(by).alias("fp")) for by in turns])).alias("t")
    node = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    keyed = fps.select(each).select("t.by", "t.fp").withColumn("node", node)
    sizes = keyed.groupBy("by", "node").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("cuts"))
    # at most 2^DEEPEST_TOP rows a trie
    keyed = keyed.join(F.broadcast(sizes), ["by", "node"]).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int, int]]:
            for b in it:
                yield from zip(*(c.to_pylist() for c in b.columns))

        for (by, n, c), group in itertools.groupby(rows(), key=lambda r: r[:3]):
            part = 0
            while leaves := list(itertools.islice(group, 2 * block)):  # a cut holds about one block
                packed = np.sort(np.array([r[3] for r in leaves], np.int64).view(np.uint64)).tobytes()
                yield pa.RecordBatch.from_pylist([{"by": by, "node": n, "cut": c * 1000 + part, "leaves": packed}], BLOCKS)
                part += 1

    packed = (keyed.repartition(parts, "by", "node", "cut").sortWithinPartitions("by", "node", "cut")
              .select("by", "node", "cut", "fp").mapInArrow(blocks, "by int, node long, cut long, leaves binary"))
    packed = materialize(packed, "simhash-blocks")
    own = packed.select("by", F.col("leaves").alias("a"), F.lit(None).cast("binary").alias("b"))
    # blocks of one node meet in pairs; most nodes are one block
    a = packed.select("by", "node", F.col("cut").alias("lc"), F.col("leaves").alias("a"))
    b = packed.select("by", "node", F.col("cut").alias("rc"), F.col("leaves").alias("b"))
    pairs = packed.select("by", "node", F.col("cut").alias("lc")).join(
        packed.select("by", "node", F.col("cut").alias("rc")), ["by", "node"]).where("lc < rc")
    cross = pairs.join(a, ["by", "node", "lc"]).join(b, ["by", "node", "rc"]).select("by", "a", "b")
    work = own.unionByName(cross).repartition(parts * 4, F.xxhash64("a", "b"))

    def descend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                by, x, y = (c[k].as_py() for c in batch.columns)
                alone = y is None
                x = np.frombuffer(x, np.uint64)
                y = x[:0] if alone else np.frombuffer(y, np.uint64)
                forest = _Forest(len(x) + len(y))
                for i, j in close_leaves(x, None if alone else y, depth, max_bits):
                    forest.add(i, j if alone else j + len(x))
                if forest.edges:
                    every = _turned(np.concatenate([x, y]), -by % 64).view(np.int64)
                    e = np.array(forest.edges)
                    yield pa.RecordBatch.from_arrays([pa.array(every[e[:, 0]]), pa.array(every[e[:, 1]])], ["u", "v"])

    return work.mapInArrow(descend, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every end of the links (u, v): alternating large and small stars until nothing changes. Each
    round is written to the shared folder; a hub costs a partial minimum, never a gathered list."""
    u, v = F.col("u"), F.col("v")
    edges = materialize(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(),
                        "simhash-edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return edges.select("u", F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        state = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct()
        edges = materialize(small, "simhash-edges")


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least_id, component_id) of every fingerprint of ``prints`` (doc_id, fp); least_id is its smallest doc_id."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(trie_links(first.select("fp"), max_bits)).withColumnRenamed("u", "fp")
    linked = first.join(roots, "fp")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(ids, "root").select("fp", "component_id")
    return first.join(linked, "fp", "left").select("fp", "least_id", F.coalesce("component_id", "least_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits. A null or
    blank text has fingerprint zero and links like any other. A row with a null doc_id gets a row too, but names no
    component (a component of such rows alone has a null component_id); repeated rows are repeated in the result.

    Rows of hot fingerprints (all blank texts, the copies of one page) meet their classes where they are read: only
    the others are dealt by fingerprint, so no fingerprint brings one task more than its ten-thousandth of the rows.
    """
    prints = materialize(with_fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"),
                         "simhash-prints")
    classes = materialize(_classes(prints, max_bits).select("fp", "component_id"), "simhash-classes")
    over = max(HOT_ROWS, prints.count() // HOT_KEYS)
    hot = F.broadcast(prints.groupBy("fp").count().where(F.col("count") > over).select("fp"))     # HOT_KEYS rows at most
    often = prints.join(F.broadcast(classes.join(hot, "fp")), "fp")
    rare = prints.join(hot, "fp", "left_anti").join(classes, "fp")
    return often.unionByName(rare).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one whose doc_id names it.

    Of repeated rows (same doc_id, same fingerprint) one stays. Rows with a null doc_id can't be named and stay as
    they are; all columns of ``docs`` are kept whatever their names.

    The document that names a component is the smallest of its own fingerprint too, so the classes alone say which
    (doc_id, fingerprint) stay; no row is dealt by its fingerprint for it.
    """
    fp = free_name(docs, "fp")
    full = materialize(with_fingerprints(docs, fp, shingle), "simhash-docs")
    prints = full.select("doc_id", F.col(fp).alias("fp"))
    kept = _classes(prints, max_bits).where("least_id = component_id").select(F.col("least_id").alias("doc_id"), F.col("fp").alias(fp))
    named = full.join(kept, ["doc_id", fp], "left_semi").dropDuplicates(["doc_id", fp])
    return named.select(docs.columns).union(full.where("doc_id is null").select(docs.columns))
