"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

1. Sampled suffixes. Of the ``GRAM``-byte strings inside every ``LENGTH``-byte window the one of least hash is its
   anchor (leftmost on ties): equal windows have equal anchors at equal offsets, so only suffixes at anchors need an
   index entry (about 1.5 % of all bytes). An entry is the digest of the suffix's first ``GRAM`` bytes, the digest of
   its context (all windows around the anchor) and its place. A batch's entries, sorted by the first digest, are the
   batch's suffix array: equal long prefixes are neighbours, which is the only order a scan for long matches uses.
2. Logarithmic index family. A new batch's array is merge-scanned against every level (bucketed by digest alike, so
   without a shuffle) for prefixes that both hold; levels of equal size then merge, so there are at most log2 levels.
3. Of the matching entries those of equal context are repeats as a whole. Others (the rims of repeats) send their context,
   at most ``2 * LENGTH - GRAM`` bytes, to their prefix's group, where all windows are compared. A prefix with more than
   ``HOT`` different contexts is never gathered: its windows are counted by digest with partial aggregation instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.session import materialize, scratch_path

LENGTH = 200                    # bytes of a repeat
GRAM = 64                       # bytes of the prefix that index entries match on
SPREAD = LENGTH - GRAM + 1      # windows that can share an anchor
BATCHES = 4                     # a power of two ends in one level
HOT = 8_000                     # contexts of one prefix that one task compares
PIECE = 1 << 18                 # bytes handled at once, whatever the length of a text
CHUNK_BYTES = 1 << 20           # contexts compared at once
CHUNK_WINDOWS = 400_000         # and windows
CHUNK_ROWS = 20_000             # rows of a batch that Python hands back
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15      # odd, so that it has an inverse
_TABLES = [np.random.default_rng(s).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (11, 12)]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
    down = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def rolling(data: np.ndarray, width: int, table: int = 0) -> np.ndarray:
    """64-bit digests of every ``width``-byte string of ``data``."""
    n = len(data)
    up, down = _powers(1 << max(10, (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[table][data] * down[:n], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * up[:n - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes) -> np.ndarray:
    """Ascending places of the anchors of all windows of ``text``."""
    data, found = np.frombuffer(text, np.uint8), []
    windows = len(data) - LENGTH + 1
    for at in range(0, max(0, windows), PIECE):
        h = rolling(data[at:at + PIECE + LENGTH - 1], GRAM)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        blocks = np.append(key, np.full(-len(key) % SPREAD, ~np.uint64(0))).reshape(-1, SPREAD)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - SPREAD + 1
        least = np.minimum(back[:n], ahead[SPREAD - 1:SPREAD - 1 + n])
        places = least[np.append(True, least[1:] != least[:-1])] & _PLACE
        found.append(places.astype(np.int64) + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


ENTRY = "batch int, g long, c long, rid long, pos int, more array<int>, t binary"


def _entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of every text and, as batch -1, one row (g = rid, t = digest of the text) per text with entries.

    What repeats inside a text with its context is one entry with ``more`` places."""
    rid = TaskContext.get().partitionId() << 33
    names = ["batch", "g", "c", "rid", "pos", "more", "t"]
    batch, g, c, rids, pos, more, t = rows = [[] for _ in names]

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(batch, pa.int32()), _signed(g), _signed(c), pa.array(rids, pa.int64()),
                                           pa.array(pos, pa.int32()), pa.array(more, pa.list_(pa.int32())), pa.array(t, pa.binary())],
                                          names=names)
        for x in rows:
            x.clear()
        return made

    for b in it:
        for text in b.column(0):
            data = (text.as_py() or "").encode()
            places = anchors(data).tolist()
            if not places:
                continue
            rid += 1
            key = hashlib.sha256(data).digest()
            begins = [p - SPREAD + 1 if p >= SPREAD else 0 for p in places]
            prefixes = [xxhash.xxh3_64_intdigest(data[p:p + GRAM]) for p in places]
            contexts = [xxhash.xxh3_64_intdigest(data[a:p + LENGTH], (p - a) << 8 | min(len(data) - p, LENGTH))
                        for a, p in zip(begins, places)]
            first: dict[tuple[int, int], list[int]] = {}
            for entry, p in zip(zip(prefixes, contexts), places):
                first.setdefault(entry, []).append(p)
            n = len(first)
            batch.append(-1)
            batch += [key[0] % BATCHES] * n       # copies of a text share a batch
            g.append(rid)
            g += [e[0] for e in first]
            c.append(0)
            c += [e[1] for e in first]
            rids += [rid] * (n + 1)
            pos.append(-1)
            pos += [x[0] for x in first.values()]
            more.append(None)
            more += [x[1:] or None for x in first.values()]
            t.append(key)
            t += [None] * n
            if len(g) >= CHUNK_ROWS:
                yield out()
    yield out()


def _bucketed(df: DataFrame, name: str, buckets: int, order: tuple[str, ...], batches: bool = False) -> DataFrame:
    """``df`` written to the shared folder, bucketed by its digest ``g`` and sorted."""
    spark, table = df.sparkSession, f"covenant_{name}_{uuid.uuid4().hex}"
    w = df.write.format("parquet").bucketBy(buckets, "g").sortBy(*order)
    w = w.partitionBy("batch") if batches else w
    w.option("compression", "zstd").option("path", scratch_path(spark, table)).saveAsTable(table)
    return spark.table(table)


class LevelFamily:
    """Levels (order, array): an array holds (g, n), the prefixes of 2 ** order batches and how often they occur."""

    def __init__(self, buckets: int):
        self.buckets, self.levels = buckets, []

    def add(self, array: DataFrame) -> list[DataFrame]:
        """Take in a batch's array; the prefixes that it repeats, itself or from a level."""
        found = [array.where("n > 1").select("g"), *(merge_scan(array, level) for _, level in self.levels)]
        order = 0
        while self.levels and self.levels[-1][0] == order:
            array = _bucketed(merged(self.levels.pop()[1], array), "suffix_level", self.buckets, ("g",))
            order += 1
        self.levels.append((order, array))
        return found


def merge_scan(array: DataFrame, level: DataFrame) -> DataFrame:
    """Prefixes that both sorted arrays hold."""
    return array.select("g").join(level.select("g"), "g", "left_semi")


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two sorted arrays as one."""
    a, b = one.select("g", F.col("n").alias("n1")), other.select("g", F.col("n").alias("n2"))
    return a.join(b, "g", "full_outer").select("g", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))


# ---------------------------------------------------------------- windows of contexts
class _Windows:
    """The windows of rows of contexts, by the offset of the anchor in them: only windows of equal offset can be equal."""

    def __init__(self, contexts: list[bytes], left: list[int]):
        sizes = np.array([len(x) for x in contexts])
        data = np.frombuffer(b"".join(contexts), np.uint8)
        self.left, self.last, self.at = np.array(left), sizes - LENGTH, np.cumsum(sizes) - sizes
        self.digests = [rolling(data, LENGTH, i) for i in (0, 1)]

    def parts(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, start, offset, digest, second digest) of all windows, a bounded number at a time."""
        step = max(1, CHUNK_WINDOWS // len(self.left))
        for lo in range(0, SPREAD, step):
            start = self.left[:, None] - np.arange(lo, min(lo + step, SPREAD))
            row, nth = np.nonzero((start >= 0) & (start <= self.last[:, None]))
            start = start[row, nth]
            at = self.at[row] + start
            yield row, start, nth + lo, self.digests[0][at], self.digests[1][at]


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start) of maximal runs of consecutive starts of a row, from windows in any order."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))[:len(row)])
    last = np.append(first[1:], len(row))[:len(first)] - 1
    return row[first], start[first], start[last]


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, all of a prefix together, to the spans (t, a, b) of windows that another context of the prefix holds."""
    def spans(g: list[int], t: list[bytes], pos: list[int], a: list[int], whole: list[bool], context: list[bytes]) -> pa.RecordBatch:
        gs = np.array(g, np.int64)
        gid = np.cumsum(np.append(True, gs[1:] != gs[:-1])).astype(np.uint64) << np.uint64(8)
        rim, found = ~np.array(whole), []
        for row, start, offset, h1, h2 in _Windows(context, [p - x for p, x in zip(pos, a)]).parts():
            group = gid[row] | offset.astype(np.uint64)
            key = h1 ^ (group * np.uint64(_BASE))
            order = np.argsort(key, kind="stable")
            k, h, w = key[order], h2[order], group[order]
            same = np.flatnonzero((k[1:] == k[:-1]) & (h[1:] == h[:-1]) & (w[1:] == w[:-1]))
            twice = np.unique(order[np.append(same, same + 1)])
            twice = twice[rim[row[twice]]]
            found.append((row[twice], start[twice]))
        row, first, last = _runs(*(np.concatenate(x) for x in zip(*found)))
        begin = np.array(a, np.int64)[row]
        return pa.RecordBatch.from_arrays([pa.array([t[i] for i in row], pa.binary()), pa.array(begin + first),
                                           pa.array(begin + last + LENGTH)], names=["t", "a", "b"])

    held, size = [[] for _ in range(6)], 0
    for b in it:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if size >= CHUNK_BYTES and row[0] != held[0][-1]:
                yield spans(*held)
                held, size = [[] for _ in range(6)], 0
            for x, v in zip(held, row):
                x.append(v)
            size += len(row[5])
    if size:
        yield spans(*held)


def _exploded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to their windows: (w1, w2, t, a, whole), where (w1, w2) digests prefix, anchor offset and content."""
    for b in it:
        for i in range(0, b.num_rows, 500):
            g, t, pos, a, whole, context = (c.to_pylist() for c in b.slice(i, 500).columns)
            gs, begin = np.array(g, np.int64).view(np.uint64), np.array(a, np.int64)
            for row, start, offset, h1, h2 in _Windows(context, [p - x for p, x in zip(pos, a)]).parts():
                k = gs[row] + offset.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h1 ^ k * np.uint64(_BASE)).view(np.int64)), pa.array((h2 + k).view(np.int64)),
                     pa.array([t[r] for r in row], pa.binary()), pa.array(begin[row] + start),
                     pa.array([whole[r] for r in row], pa.bool_())], names=["w1", "w2", "t", "a", "whole"])


def _contexts(hot: bool):
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "t", "pos", "a", "whole", "context"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows) if rows else ((),) * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)
            rows.clear()
            return made

        for b in it:
            for t, z, marks in zip(*b.columns[:3]):
                marks = [m for m in marks.as_py() if m["ask"] and m["hot"] == hot]
                if marks:
                    t, data = t.as_py(), zstandard.decompress(z.as_py())
                    for m in marks:
                        a = max(0, m["pos"] - SPREAD + 1)
                        rows.append((m["g"], t, m["pos"], a, m["whole"], data[a:m["pos"] + LENGTH]))
                    if len(rows) >= CHUNK_ROWS // 4:
                        yield out()
        yield out()
    return cut


CONTEXT = "g long, t binary, pos long, a long, whole boolean, context binary"


def _cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, their marks and spans to (t, n_removed, n_spans, kept_sha256)."""
    for b in it:
        out = []
        for t, z, marks, spans in zip(*b.columns):
            t, marks, spans, data = t.as_py(), marks.as_py(), spans.as_py(), zstandard.decompress(z.as_py())
            covers = [(max(0, p - SPREAD + 1), min(len(data), p + LENGTH)) for m in marks if m["whole"]
                      for p in (m["pos"], *(m["more"] or ()))]
            runs: list[list[int]] = []
            for x, y in sorted(covers + [(s["a"], s["b"]) for s in spans or ()]):
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                else:
                    runs.append([x, y])
            kept, upto = hashlib.sha256(), 0
            for x, y in runs:
                kept.update(data[upto:x])
                upto = y
            kept.update(data[upto:])
            out.append((t, sum(y - x for x, y in runs), len(runs), kept.hexdigest()))
        t, removed, runs, kept = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array(kept, pa.string())], names=["t", "n_removed", "n_spans", "kept_sha256"])


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of ``LENGTH`` bytes and more as (digest, compressed bytes)."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in it:
        data = [d for t in b.column(0).to_pylist() if len(d := (t or "").encode()) >= LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()),
                                          pa.array([pack.compress(d) for d in data], pa.binary())], names=["t", "z"])


def repeated_entries(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, texts): the index entries that match another one, with what is to be done with each, and (rid, t)."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = docs.select("text").mapInArrow(_entries, ENTRY).repartition(buckets, "g")
    entries = _bucketed(entries, "suffix_entries", buckets, ("g", "c"), batches=True)
    family, found = LevelFamily(buckets), []
    places = 1 + F.coalesce(F.array_size("more"), F.lit(0))
    for batch in range(BATCHES):
        found += family.add(entries.where(F.col("batch") == batch).groupBy("g").agg(F.sum(places).alias("n")))
    repeats = found[0]
    for more in found[1:]:
        repeats = repeats.union(more)
    rows = entries.where("batch >= 0").select("g", "c", "rid", "pos", "more").join(repeats.distinct(), "g", "left_semi")
    same = Window.partitionBy("g", "c")
    rows = rows.withColumns({"n": F.sum(places).over(same), "nth": F.row_number().over(same.orderBy("rid", "pos"))})
    prefix = Window.partitionBy("g")
    rows = rows.withColumns({"contexts": F.sum((F.col("nth") == 1).cast("int")).over(prefix),
                             "rim": F.max(F.col("n") == 1).over(prefix)})
    # every rim is asked for its windows, and one entry of each repeated context beside a rim
    rows = rows.select("rid", "pos", "more", "g", (F.col("n") > 1).alias("whole"), (F.col("contexts") > HOT).alias("hot"),
                       (F.col("rim") & (F.col("nth") == 1)).alias("ask"))
    return materialize(rows, "suffix-repeats"), entries.where("batch = -1").select(F.col("g").alias("rid"), "t")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per row of ``docs``.

    Removed is every byte that some ``LENGTH``-byte string covers which starts at another place too, in this or another
    row; matches never cross rows. A null or short text has nothing to remove, repeated rows of ``LENGTH`` bytes or more
    lose all of their text, an empty table gives none; other columns are not carried and doc_id may be null or repeat.
    """
    marks, texts = repeated_entries(docs)
    copies = texts.groupBy("t").agg(F.count("*").alias("copies"))
    texts = texts.join(copies, "t")
    listed = marks.groupBy("rid").agg(F.collect_list(F.struct("pos", "more", "g", "whole", "hot", "ask")).alias("marks"))
    # a text that stands in several rows goes as a whole: only what others need of it is looked up
    asked = F.when(F.col("copies") > 1, F.filter("marks", lambda m: m["ask"])).otherwise(F.col("marks"))
    listed = (listed.join(texts, "rid").withColumn("marks", asked).where(F.size("marks") > 0)
              .groupBy("t").agg(F.flatten(F.collect_list("marks")).alias("marks"), F.max("copies").alias("copies")))
    packed = docs.select("text").mapInArrow(_packed, "t binary, z binary").groupBy("t").agg(F.first("z").alias("z"))
    marked = packed.join(listed, "t").select("t", "z", "marks", "copies")

    rims = marked.mapInArrow(_contexts(False), CONTEXT).repartition("g").sortWithinPartitions("g").mapInArrow(_compare, "t binary, a long, b long")
    hot = materialize(marked.where(F.exists("marks", lambda m: m["hot"])).mapInArrow(_contexts(True), CONTEXT), "suffix-hot")
    windows = hot.mapInArrow(_exploded, "w1 long, w2 long, t binary, a long, whole boolean")
    shared = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    counted = windows.where("not whole").join(shared, ["w1", "w2"], "left_semi").select("t", "a", (F.col("a") + LENGTH).alias("b"))
    spans = rims.union(counted).groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    single = (marked.where("copies = 1").join(spans, "t", "left").select("t", "z", "marks", "spans")
              .mapInArrow(_cut_out, "t binary, n_removed long, n_spans long, kept_sha256 string"))

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("t"))
    result = rows.join(single.unionByName(copies.where("copies > 1").select("t"), allowMissingColumns=True)
                       .withColumn("hit", F.lit(True)), "t", "left")
    whole = F.col("hit") & F.col("n_removed").isNull()
    return result.select("doc_id", "n_bytes",
                         F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                         F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                         F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("t")))).alias("kept_sha256"))
