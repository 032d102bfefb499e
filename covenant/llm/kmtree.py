"""Approximate nearest neighbours (largest inner product) by a hierarchical k-means tree, best bin first.

1. A tree of k-means splits is fitted on a bounded sample (of each of ``SAMPLE`` hash slots the vector of least second
   hash, whatever the order of the ids; a documented bound).
2. Every vector descends to its leaf; a leaf is cut into blocks by hash, so a hot leaf is many rows, not one.
3. Every query walks the tree through a priority queue of unexplored nodes (greatest inner product with the centre
   first) and visits leaves; the number of visits is widened on the sample until the wanted recall is reached there.
4. Query blocks meet the vector blocks of their leaves; exact double-precision products are ranked, block by block. The
   key names the leaf, the block of vectors and a shelf of query blocks, so neither a leaf of many copies nor a leaf that
   every query visits is one task's work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.session import materialize

K = 20
SAMPLE = 16_000      # vectors of the fitting sample
BRANCH = 8           # children of a node
LEAF = 64            # sample vectors of a leaf, at most (copies apart)
PROBES = 200         # sample vectors that calibrate the number of visits
RECALL = 0.97        # wanted on the sample
VECTORS = 2048       # vectors of one block
QUERIES = 512        # queries of one block
SHELF = 16           # query blocks that meet a block of vectors under one key
SEED = 11            # deals the vectors to the slots of the sample
SEED_PICK = 12       # picks one vector of a slot


class Tree:
    """Nodes as arrays: ``kids[n]`` (empty for leaves), ``centres[n]`` of those kids; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray):
        self.kids: list[list[int]] = [[]]
        self.centres: list[np.ndarray | None] = [None]
        self.leaf_of: dict[int, int] = {}
        rng = np.random.default_rng(SEED)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            part = x[rows]
            if len(rows) <= LEAF or (part == part[0]).all():
                self.leaf_of[n] = len(self.leaf_of)
                continue
            c = part[rng.choice(len(part), min(BRANCH, len(part)), replace=False)]
            for _ in range(8):
                near = _nearest(part, c)
                c = np.stack([part[near == i].mean(axis=0) for i in np.unique(near)])
            near = _nearest(part, c)
            used = np.unique(near)
            if len(used) < 2:
                self.leaf_of[n] = len(self.leaf_of)
                continue
            self.centres[n] = c[used]
            for i in used:
                self.kids[n].append(len(self.kids))
                todo.append((len(self.kids), rows[near == i]))
                self.kids.append([])
                self.centres.append(None)
        self.n_leaves = len(self.leaf_of)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if n in self.leaf_of:
                out[rows] = self.leaf_of[n]
                continue
            near = _nearest(x[rows], self.centres[n])
            todo.extend((kid, rows[near == i]) for i, kid in enumerate(self.kids[n]) if (near == i).any())
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, n = heapq.heappop(queue)
            if n in self.leaf_of:
                yield self.leaf_of[n]
                continue
            for s, kid in zip((-(self.centres[n] @ q)).tolist(), self.kids[n]):
                heapq.heappush(queue, (s, kid))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None] - 2 * (x @ c.T), axis=1)


def calibrate(tree: Tree, x: np.ndarray, k: int = K, recall: float = RECALL) -> int:
    """The least number of leaf visits (widened by a quarter each time) that finds the share ``recall`` of the sample's own
    ``k`` nearest of ``PROBES`` sample vectors."""
    leaf = tree.assign(x)
    probes = np.random.default_rng(SEED).choice(len(x), min(PROBES, len(x)), replace=False)
    ranks = []      # per true neighbour: the visit that finds it
    for p in probes:
        s = x @ x[p]
        s[p] = -np.inf
        best = np.argsort(-s, kind="stable")[:min(k, len(x) - 1)]
        order = np.empty(tree.n_leaves, np.int64)
        order[list(tree.visits(x[p]))] = np.arange(tree.n_leaves)
        ranks.append(order[leaf[best]])
    ranks = np.concatenate(ranks)
    n = 1
    while n < tree.n_leaves and len(ranks) and (ranks < n).mean() < recall:
        n = max(n + 1, n * 5 // 4)
    return min(n, tree.n_leaves)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part. Null ids, null, empty and zero vectors and those with null or non-finite
    components don't; of several lengths the most frequent (ties: the smaller) does."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v")).where(fine)
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def sample(base: DataFrame) -> DataFrame:
    """(vec_id, v): at most ``SAMPLE`` vectors from the whole table. The pick within a slot is by a hash of its own: by
    the id it would be a prefix of the table."""
    slots = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(SAMPLE))
    least = F.min_by(F.struct("vec_id", "v"), F.xxhash64(F.lit(SEED_PICK), "vec_id"))
    return base.groupBy(slots.alias("slot")).agg(least.alias("one")).select("one.*")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row of ``queries`` among ``vectors`` (both vec_id,
    embedding), nearest first, ties to the smaller vec_id; all candidates, if there are fewer. Rows with the query's own
    vec_id are no candidates; a repeated vec_id is a candidate with each of its rows."""
    spark = vectors.sparkSession
    base = materialize(usable(vectors), "ann-vectors")
    picked = sample(base).select("v").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not picked:
        return empty
    x = np.array(sorted(r["v"] for r in picked))
    tree = Tree(x)
    wide = calibrate(tree, x, k)
    shared = spark.sparkContext.broadcast(tree)      # centres of a bounded sample

    def leaves(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf = shared.value.assign(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf)], ["vec_id", "v", "leaf"])

    placed = materialize(base.mapInArrow(leaves, "vec_id long, v array<double>, leaf long"), "ann-leaves")
    counts = materialize(placed.groupBy("leaf").agg(F.count("*").alias("n")), "ann-counts")
    sizes = {r["leaf"]: r["n"] for r in counts.collect()}      # one number per leaf of the bounded tree
    held = spark.sparkContext.broadcast(sizes)
    n_blocks = F.ceil(F.col("n") / VECTORS)
    block = F.pmod(F.xxhash64("vec_id"), n_blocks).alias("block")
    blocks = placed.join(F.broadcast(counts), "leaf").groupBy("leaf", block).agg(
        F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("v")).alias("x"))

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, m = b.column("vec_id").to_pylist(), _matrix(b.column("v"))
            rows, to = [], []
            for i, q in enumerate(m):
                seen = 0
                for n, leaf in enumerate(shared.value.visits(q)):
                    if n >= wide and seen > k:
                        break
                    if leaf in held.value:
                        seen += held.value[leaf]
                        rows.append(i)
                        to.append(leaf)
            for s in range(0, len(rows), 8192):
                part = rows[s:s + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in part], pa.int64()), b.column("v").take(pa.array(part, pa.int64())),
                     pa.array(to[s:s + 8192], pa.int64())], ["query_id", "q", "leaf"])

    asked = usable(queries)
    walked = materialize(asked.mapInArrow(walk, "query_id long, q array<double>, leaf long"), "ann-visits")
    per_leaf = walked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    part = F.pmod(F.xxhash64("query_id"), "parts")
    qblocks = walked.join(F.broadcast(per_leaf), "leaf").groupBy("leaf", part.alias("part")).agg(
        F.collect_list("query_id").alias("qids"), F.flatten(F.collect_list("q")).alias("q"))
    # leaves are as many as the bounded tree has
    qblocks = qblocks.join(F.broadcast(counts), "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"),
        F.floor(F.col("part") / SHELF).alias("shelf"), "qids", "q")
    shelves = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("parts") - 1) / SHELF))).alias("shelf")
    blocks = blocks.join(F.broadcast(per_leaf), "leaf").select("leaf", "block", shelves, "ids", "x")
    pairs = qblocks.join(blocks, ["leaf", "block", "shelf"]).select("qids", "q", "ids", "x")

    def rank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                qids, q, ids, v = (c[i].values.to_numpy(zero_copy_only=False) for c in b.columns)
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v.reshape(len(ids), -1)[order]
                q = q.reshape(len(qids), -1)
                outs = ([], [], [])
                for row, qid in enumerate(qids):
                    s = np.einsum("ij,j->i", v, q[row])      # one query at a time: equal vectors get equal products
                    s[ids == qid] = -np.inf
                    best = np.argsort(-s, kind="stable")[:k]
                    best = best[s[best] > -np.inf]
                    for o, x_ in zip(outs, (np.full(len(best), qid), ids[best], s[best])):
                        o.append(x_)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in outs], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(rank, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
