"""Which of a batch's keys a store already holds, without shuffling the store.

The question is asked the other way round than an anti join asks it: the batch's keys filter the store's key columns,
and only the few hits meet the batch again. A batch whose plan is within ``BROADCAST_BYTES`` is broadcast whole. A larger
one is broadcast as a Bloom filter (one hash function, 16 bits a key, in 64-bit words): what passes it, the hits and one
key in sixteen of the others, is shuffled. Above ``FILTER_KEYS`` keys the filter itself would be too large; then the
key columns of both sides meet in a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.plans.sizing import BROADCAST_BYTES, bounded_count, plan_bytes

FILTER_KEYS = 4_000_000        # a filter of so many keys has 1 M words, about 32 MB as a broadcast table
BITS_PER_KEY = 16


def _word_and_bit(keys: Sequence[str], bits: int):
    h = F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")


def key_filter(batch: DataFrame, keys: Sequence[str], n: int) -> tuple[DataFrame, int]:
    """(word, bits) rows of a Bloom filter over ``n`` keys, and its size in bits (a power of two)."""
    bits = 1 << max(6, (BITS_PER_KEY * max(n, 1) - 1).bit_length())
    word, bit = _word_and_bit(keys, bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return batch.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits")), bits


def may_hold(store: DataFrame, batch: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of ``store`` whose keys pass the filter of ``batch``: all that it holds and few others, no row is shuffled."""
    words, bits = key_filter(batch, keys, n)
    word, bit = _word_and_bit(keys, bits)
    return (store.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(words), "_word")
            .where(F.getbit("_bits", F.col("_bit")) == 1).drop("_word", "_bit", "_bits"))


def _same(left: Sequence[str], right: Sequence[str]):
    """Null-safe equality of two lists of columns: a null key is a key."""
    cond = None
    for a, b in zip(left, right):
        eq = F.col(a).eqNullSafe(F.col(b))
        cond = eq if cond is None else cond & eq
    return cond


def held_keys(store: DataFrame, batch: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """The keys of ``batch`` (columns ``keys``, equal names and types on both sides) that ``store`` holds. ``small``: whether
    the batch is known to be within ``BROADCAST_BYTES`` (else its plan is asked)."""
    keys = list(keys)
    asked = [f"_asked_{k}" for k in keys]
    have, want = store.select(*keys), batch.select(*[F.col(k).alias(a) for k, a in zip(keys, asked)])
    if plan_bytes(want) <= BROADCAST_BYTES if small is None else small:
        return have.join(F.broadcast(want), _same(keys, asked), "left_semi")
    n = bounded_count(want, FILTER_KEYS)
    if n <= FILTER_KEYS:
        have = may_hold(have, batch, keys, n)
    return have.join(want, _same(keys, asked), "left_semi")


def fresh_rows(store: DataFrame, batch: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """The rows of ``batch`` whose keys ``store`` does not hold. The keys of a store are unique, so the hits of a batch
    within the broadcast bound are within it too. A larger batch meets the store's keys in one join."""
    keys = list(keys)
    held = [f"_held_{k}" for k in keys]
    want = batch.select(*keys)
    if plan_bytes(want) <= BROADCAST_BYTES if small is None else small:
        hits = held_keys(store, batch, keys, True).select(*[F.col(k).alias(h) for k, h in zip(keys, held)])
        return batch.join(F.broadcast(hits), _same(keys, held), "left_anti")
    have, n = store.select(*keys), bounded_count(want, FILTER_KEYS)
    if n <= FILTER_KEYS:
        have = may_hold(have, want, keys, n)
    return batch.join(have.select(*[F.col(k).alias(h) for k, h in zip(keys, held)]), _same(keys, held), "left_anti")


def rows_without(store: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``store`` whose keys ``batch`` does not hold (a null key is never held). Only rows that pass the batch's
    filter are shuffled; above ``FILTER_KEYS`` keys all are."""
    keys = list(keys)
    want = batch.select(*keys)
    if plan_bytes(want) <= BROADCAST_BYTES:
        return store.join(F.broadcast(want), keys, "left_anti").select(*store.columns)
    n = bounded_count(want, FILTER_KEYS)
    if n > FILTER_KEYS:
        return store.join(want, keys, "left_anti").select(*store.columns)
    words, bits = key_filter(want, keys, n)
    word, bit = _word_and_bit(keys, bits)
    asked = store.withColumn("_key_word", word).withColumn("_key_bit", bit).join(
        F.broadcast(words), F.col("_key_word") == F.col("_word"), "left")
    may = F.coalesce(F.getbit("_bits", F.col("_key_bit")) == 1, F.lit(False))
    return asked.where(~may).select(*store.columns).unionByName(
        asked.where(may).select(*store.columns).join(want, keys, "left_anti").select(*store.columns))
