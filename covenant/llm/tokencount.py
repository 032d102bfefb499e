"""Token counts as an exact length histogram: suffix sums over document lengths answer every context limit.

Texts are encoded with a public byte-level BPE vocabulary; its path is a parameter, the driver reads the file (about
1 MB, checked) and broadcasts it, so executors need no copy of the path.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.tables import free_name
from covenant.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
# Fixed value: the public split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as the split pattern knows it; a run so long would exhaust the pattern's stack, which steps back in it.
LONG_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
STRIDE = 256   # lengths in one block of the two-level suffix sums


def encoders(raw: bytes) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The vocabulary with its split pattern, and without one: a text is a single piece."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tuple(tiktoken.Encoding("public", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, r"[\s\S]+"))


def count_tokens(text: str, enc: tiktoken.Encoding, piece: tiktoken.Encoding) -> int:
    """Tokens of ``text``. A long run of white space is cut out and counted alone, exactly as the pattern takes it: whole
    at the end of a text, else without its last character, which goes with what follows."""
    n = at = 0
    for run in LONG_SPACE.finditer(text):
        a, b = run.span()
        b -= b < len(text)
        n += len(enc.encode_ordinary(text[at:a])) + len(piece.encode_ordinary(text[a:b]))
        at = b
    return n + len(enc.encode_ordinary(text[at:]))


def with_token_counts(docs: DataFrame, column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` and a long ``column``: the tokens of the whole text (null or empty: 0)."""
    with open(vocabulary, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary above {MAX_VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, piece = encoders(shared.value)
        for b in it:
            n = [count_tokens(t.as_py() or "", enc, piece) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, column])

    return docs.mapInArrow(batches, out)


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): exact, aggregated map-side, so a hot length costs one row per task."""
    n = free_name(docs, "n_tokens")
    counted = with_token_counts(docs.select("text"), n, vocabulary)
    return counted.groupBy(F.col(n).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``hist`` (length, n_docs) with docs_ge and tokens_ge (documents at least so long, their tokens),
    tokens_truncated (all tokens if every document is cut to ``length``) and quantile (share of documents up to it).

    Any other limit L follows from the next greater length: with (docs_ge, tokens_ge) of the least length > L the
    truncated total is total - tokens_ge + L * docs_ge. Sums are taken per block of lengths first, so no task holds
    the whole histogram. An empty table gives no rows.
    """
    hist = materialize(hist, "length-histogram").withColumn("block", F.floor(F.col("length") / STRIDE))
    tokens = F.col("length") * F.col("n_docs")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
                           F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
                           F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("tokens"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc())
    rows = hist.join(blocks, "block").select(
        "length", "n_docs", "docs", "tokens", (F.sum("n_docs").over(within) + F.col("d_above")).alias("docs_ge"),
        (F.sum(tokens).over(within) + F.col("t_above")).alias("tokens_ge"))
    return rows.select("length", "n_docs", "docs_ge", "tokens_ge",
                       (F.col("tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("tokens_truncated"),
                       ((F.col("docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("docs")).alias("quantile"))
