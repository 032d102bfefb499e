"""Fill-in-the-middle transformation with content-defined chunk memoization.

A document is cut at two code-point positions. To find the byte offsets, its UTF-8 bytes are chunked where a rolling
hash of the last bytes says so: equal passages of different documents give equal chunks. A chunk's boundary summary
(the code points that start in it) is kept in a bounded cache under the chunk's content, so a shared chunk is counted
once per worker; a cache hit compares the bytes, never only a digest. Running sums of the summaries name the chunk that
holds a cut, and only that chunk is searched for the exact byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1:"               # the digest that fixes a document's cuts is that of this and its decimal id
PLAIN_FROM = 90           # of 100: documents from here on stay plain
SPM_BELOW = 20            # of 100: documents below take the suffix-prefix-middle form
REACH = 16                # bytes that a chunk boundary depends on
MASK = np.uint32(0x1FF << 7)   # of the rolling hash: a boundary every 512 bytes on average
MAX_CHUNK = 1 << 16       # a longer chunk (runs of one byte) is cut here
CACHE_BYTES = 16 << 20    # of chunk contents in one worker's cache; a full cache starts anew

_TABLE = np.random.default_rng(20241).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """End offsets of the content-defined chunks of ``data`` (uint8): the last is its length."""
    rolling = np.zeros(len(data), np.uint32)
    mixed = _TABLE[data]
    for back in range(min(REACH, len(data))):
        rolling[back:] += mixed[:len(data) - back] << np.uint32(back)
    ends = np.flatnonzero((rolling & MASK) == MASK) + 1
    ends = np.unique(np.append(ends, len(data)))
    starts = np.concatenate(([0], ends[:-1]))
    if len(data) and (ends - starts).max() > MAX_CHUNK:
        cuts = [np.arange(a + MAX_CHUNK, b, MAX_CHUNK) for a, b in zip(starts, ends) if b - a > MAX_CHUNK]
        ends = np.unique(np.concatenate([ends, *cuts]))
    return ends


class ChunkCache:
    """Boundary summaries by chunk content."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.hits, self.summaries = limit, 0, 0, {}

    def code_points(self, chunk: bytes) -> int:
        """Code points that start in ``chunk``."""
        n = self.summaries.get(chunk)
        if n is not None:
            self.hits += 1
            return n
        n = len(_starts(chunk))
        if self.held + len(chunk) > self.limit:
            self.summaries.clear()
            self.held = 0
        self.summaries[chunk] = n
        self.held += len(chunk)
        return n


def _starts(chunk: bytes) -> np.ndarray:
    """Offsets of the bytes that begin a code point."""
    return np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)


class Cutter:
    """Code-point length and cut offsets of one text, by its chunks."""

    def __init__(self, data: bytes, cache: ChunkCache):
        self.data = data
        self.ends = chunk_ends(np.frombuffer(data, np.uint8)).tolist() if data else []
        self.starts = [0, *self.ends[:-1]]
        counts = [cache.code_points(data[a:b]) for a, b in zip(self.starts, self.ends)]
        self.upto = np.cumsum(counts, dtype=np.int64) if counts else np.zeros(0, np.int64)
        self.n = int(self.upto[-1]) if counts else 0

    def offset(self, units: int) -> int:
        """Byte offset behind the first ``units`` code points."""
        if units >= self.n:
            return len(self.data)
        i = int(np.searchsorted(self.upto, units, "right"))
        before = int(self.upto[i - 1]) if i else 0
        return self.starts[i] + int(_starts(self.data[self.starts[i]:self.ends[i]])[units - before])


def transform(doc_id, text: str | None, cache: ChunkCache, salt: str = SALT) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix code points, middle code points, output) of one document."""
    text = text or ""
    data = text.encode()
    cutter = Cutter(data, cache)
    digest = hashlib.sha256((salt + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not data or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return cutter.n, "plain", None, None, data
    first, second = sorted((h1 % (cutter.n + 1), h2 % (cutter.n + 1)))
    a, b = cutter.offset(first), cutter.offset(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < SPM_BELOW:
        return cutter.n, "spm", first, second - first, s + suffix + p + prefix + m + middle
    return cutter.n, "psm", first, second - first, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, salt: str = SALT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per row of ``docs``, other columns are not carried.

    A null text is empty, an empty text stays plain; a null doc_id counts as no digits. Repeated rows give equal rows,
    an empty table gives none. Works on whole texts: memory of a worker is that of an Arrow batch and the chunk cache.
    """
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for b in it:
            ids = b.column(0)
            out = [transform(i, t, cache, salt) for i, t in zip(ids.to_pylist(), b.column(1).to_pylist())]
            n, form, prefix, middle, text = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(batches, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: no marker stands inside a text that is not plain."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def digest(rows: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests of output and restored text instead of the output itself."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
