"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by (source, exact length): the only thing that is gathered per source.
2. Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at
   ``MAX_REPEATS`` times its source's size and the excess goes to the others by weight (water-filling).
3. Per source, whole passes are taken while they fit; of the remaining budget every length gives its proportional
   share, and a bounded-knapsack subset sum over lengths fills what is left as exactly as the lengths allow.
4. Of each (source, length) class so many documents get one more copy: those of least seeded hash. A class is cut
   into about sqrt(n) hash buckets, only the border bucket is ranked, so a hot class never lands in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.tables import free_name
from covenant.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20240
WINDOW = 1 << 10           # lengths that the first try of the remaining budget gives back
GIVE_BACK = 3              # documents of a length that a window gives back at most
WHOLE_FIT = 1 << 22        # words that the dynamic programming takes in at most
BROADCAST_ROWS = 200_000   # class tables up to this many (short) rows are broadcast, larger ones are shuffled


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _subset_sum(lengths: list[int], rooms: list[int], budget: int) -> list[int]:
    """How many of each length (at most its room) give the greatest sum up to ``budget``: bounded-knapsack dynamic
    programming over a bit set of sums. Only about every sqrt-th set is kept for the way back, the others are made again."""
    steps, mask = [], (1 << (budget + 1)) - 1
    for i, (n, room) in enumerate(zip(lengths, rooms)):
        room, size = min(room, budget // n), 1
        while room:                      # 1, 2, 4, ... and the rest: every number up to room is a sum of these
            k = min(size, room)
            steps.append((i, k, k * n))
            room, size = room - k, size * 2
    stride = max(1, math.isqrt(len(steps)))
    kept, sums, done = {0: 1}, 1, 0
    while done < len(steps) and not sums >> budget & 1:
        sums |= (sums << steps[done][2]) & mask
        done += 1
        if done % stride == 0:
            kept[done] = sums
    at, take = sums.bit_length() - 1, [0] * len(lengths)
    while at:
        begin = (done - 1) // stride * stride
        sets = [kept[begin]]
        for s in range(begin, done - 1):
            sets.append(sets[-1] | (sets[-1] << steps[s][2]) & mask)
        for s in range(done - 1, begin - 1, -1):
            if at and not sets[s - begin] >> at & 1:      # not a sum without this step
                i, k, words = steps[s]
                take[i] += k
                at -= words
        done = begin
    return take


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take (at most its count) so that the sum comes as near below ``budget`` as it can.

    A proportional share of each length, then the longest that fit, then the dynamic programming over the remaining
    budget: it gives back some of the lengths up to a window and fills what that frees, over wider windows until nothing
    is left. If the widest still leaves words, a budget of at most ``WHOLE_FIT`` words is fitted anew as a whole: then the
    sum is the greatest there is. A larger one may fall short by less than the shortest length that has documents left.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    for i in reversed(order):
        more = min(counts[i] - take[i], left // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    window = WINDOW
    while left:
        free, back, freed = [i for i in order if lengths[i] <= window], {}, left
        for i in free:
            back[i] = max(0, min(take[i], GIVE_BACK, (left + 4 * window - freed) // lengths[i]))
            freed += back[i] * lengths[i]
        if freed > WHOLE_FIT:
            break
        got = _subset_sum([lengths[i] for i in free], [counts[i] - take[i] + back[i] for i in free], freed)
        rest = freed - sum(lengths[i] * k for i, k in zip(free, got))
        if rest < left:
            left = rest
            for i, k in zip(free, got):
                take[i] += k - back[i]
        if window >= lengths[order[-1]]:
            break
        window *= 16
    if left and budget <= WHOLE_FIT:
        return _subset_sum(lengths, counts, budget)
    return take


def _targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, water-filled."""
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (i % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * float(MAX_REPEATS)
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    share = F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))
    return rows.select("source", "source_size", F.least("cap", share).alias("target"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    c = {k: free_name(docs, f"mix_{k}") for k in ("size", "u")}
    # 0 <= u < 1, from the seed, the id and the text: equal rows only are tied
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), 11) / float(1 << 53)
    return docs.withColumns({c["size"]: n_words(F.col("text")), c["u"]: u}), c


def _class_plan(narrow: DataFrame) -> DataFrame:
    """Per (source, size): n, source_size, target, whole passes, and the bucket (with its share) up to which documents
    get one more copy. ``narrow`` has source, size, u."""
    classes = materialize(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    classes = classes.join(F.broadcast(_targets(sizes)).withColumnRenamed("source", "s"),
                           F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size").reset_index(drop=True)
        total, goal = int(part["source_size"].iloc[0]), int(round(part["target"].iloc[0]))
        passes = min(MAX_REPEATS, goal // total) if total else 0
        extra = [0] * len(part)
        some = [i for i, n in enumerate(part["size"]) if n]
        if passes < MAX_REPEATS and some:
            got = fit_budget([int(part["size"][i]) for i in some], [int(part["n"][i]) for i in some], goal - passes * total)
            for i, k in zip(some, got):
                extra[i] = k
        return part.assign(passes=passes, extra=extra)

    schema = "source string, size long, n long, source_size long, target double, passes int, extra long"
    plan = materialize(classes.select("source", "size", "n", "source_size", "target").groupBy("source")
                       .applyInPandas(fit, schema), "mix-plan")
    plan = plan.withColumn("buckets", F.ceil(F.sqrt("n")).cast("long"))
    need = _sized(materialize(plan.where("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "buckets",
                                                             "extra"), "mix-need"))
    counted = (narrow.join(need, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
               .withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
               .groupBy("source", "size", "extra", "bucket").agg(F.count("*").alias("k")))
    upto = F.sum("k").over(Window.partitionBy("source", "size").orderBy("bucket"))
    border = (counted.withColumn("upto", upto).where("upto >= extra and upto - k < extra")
              .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("border"),
                      (F.col("extra") - F.col("upto") + F.col("k")).alias("in_border")))
    plan = plan.join(border, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    return materialize(plan.select("source", "size", "source_size", "target", "passes", "buckets",
                                   F.coalesce("border", F.lit(-1)).alias("border"), "in_border"), "mix-borders")


def _with_copies(rows: DataFrame, c: dict[str, str], plan: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with source_size, target and copies under free names."""
    names = {k: free_name(rows, f"mix_{k}") for k in ("source_size", "target", "copies", "passes", "buckets", "border",
                                                      "in_border", "source", "z", "bucket", "rank")}
    plan = plan.select(*[F.col(k).alias(names[k]) for k in ("source_size", "target", "passes", "buckets", "border", "in_border",
                                                            "source")], F.col("size").alias(names["z"]))
    j = rows.join(_sized(plan), F.col("source").eqNullSafe(F.col(names["source"])) & (F.col(c["size"]) == F.col(names["z"])))
    bucket, border = F.floor(F.col(c["u"]) * F.col(names["buckets"])), F.col(names["border"])
    j = j.withColumn(names["bucket"], bucket)
    at = F.col(names["bucket"]) == border
    whole = j.where(~at).withColumn(names["rank"], F.lit(0))
    rank = F.row_number().over(Window.partitionBy("source", c["size"]).orderBy(c["u"], "doc_id"))
    ranked = j.where(at).withColumn(names["rank"], rank)
    more = F.when(F.col(names["bucket"]) < border, 1).when(at & (F.col(names["rank"]) <= F.col(names["in_border"])), 1).otherwise(0)
    return whole.union(ranked).withColumn(names["copies"], F.col(names["passes"]) + more), names


def mix_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per row of ``docs``.

    ``taken`` is the words the mix takes from the row, repeats counted. A null or blank text has size 0 and takes
    nothing; null is a source of its own (the last); repeated rows are drawn one by one; an empty table gives none.
    """
    keyed, c = _keyed(docs)
    narrow = materialize(keyed.select("doc_id", "source", F.col(c["size"]).alias("size"), F.col(c["u"]).alias("u")), "mix-docs")
    rows, names = _with_copies(narrow, {"size": "size", "u": "u"}, _class_plan(narrow))
    return rows.select("doc_id", "size", F.col(names["source_size"]).alias("source_size"),
                       F.col(names["target"]).alias("target"), (F.col("size") * F.col(names["copies"])).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_plan`` takes it (rows of size 0 take no words and go)."""
    keyed, c = _keyed(docs)
    narrow = materialize(keyed.select("doc_id", "source", F.col(c["size"]).alias("size"), F.col(c["u"]).alias("u")), "mix-docs")
    rows, names = _with_copies(keyed, c, _class_plan(narrow))
    rows = rows.where((F.col(c["size"]) > 0) & (F.col(names["copies"]) > 0))
    each = free_name(rows, "mix_each")
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(docs.columns)
