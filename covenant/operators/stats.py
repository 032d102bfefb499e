"""Grouped sample statistics over a measurement table.

Moments are ordinary aggregates (partial + final). Nearest-rank percentiles use
the skew-safe ``group_positions`` instead of a per-group window or an exact
``percentile`` buffer, so one huge group is spread over many tasks.
Derived floating values are returned as DECIMAL(18,4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.functions.labels import (SIGNIFICANCE, Z95, confidence_label, consistency_label,
                                       effect_label, step_p_value)
from covenant.operators.positional import group_positions
from covenant.plans.sizing import broadcast_within
from covenant.session import materialize

STAT = "decimal(18,4)"
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
ACCURACY = 10_000     # of the quantile sketches that bracket an exact percentile


def _d(c):
    return c.cast(STAT)


def _join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join on the group columns null-safely (a NULL group value is a group of its own)."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in by])


def sorted_ranks(df: DataFrame, value: str, by: Sequence[str], percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """Nearest-rank percentiles per group by the rows' positions in a range sort."""
    v, nd = F.col(value), F.col("n").cast("double")
    ranked = group_positions(df.where(v.isNotNull()).select(*by, value), by, [v], size_col="n")
    ranked = ranked.where(F.col("pos").isin(*[F.floor(nd * F.lit(p)) for p in percentiles.values()]))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("pos") == F.floor(nd * F.lit(p)), v)).alias(k) for k, p in percentiles.items()])


def nearest_ranks(df: DataFrame, value: str, by: Sequence[str], percentiles: dict[str, float] = PERCENTILES,
                  accuracy: int = ACCURACY) -> DataFrame:
    """Exact nearest-rank percentiles (element floor(n*p) of the sorted sample) per group, by selection: no sort of the
    samples, no copy of them.

    A mergeable quantile sketch per group (rank error at most n/accuracy) brackets every percentile between two sample
    values. One more pass counts what lies below a bracket and ranks only what lies inside it: about 4/accuracy of the
    samples, or all copies of a value that many samples share, which count as one. The brackets (one row per group) are
    the only thing written. A percentile outside of its bracket would be an error, never a wrong value.
    """
    by, v = list(by), F.col(value)
    rows = df.where(v.isNotNull()).select(*by, value)
    edges = [q for p in percentiles.values() for q in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    groups = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(
        value, F.array(*[F.lit(q) for q in edges]), F.lit(accuracy)).alias("_q")), "percentile-brackets")
    # a row meets its group's brackets: how many samples are below each, and which of them are inside
    inside = F.array(*[F.when(v.between(F.col("_q")[2 * i], F.col("_q")[2 * i + 1]), F.lit(i)) for i in range(len(percentiles))])
    met = _join_groups(rows, broadcast_within(groups), by, "inner")
    below = met.groupBy(*by).agg(*[F.count(F.when(v < F.col("_q")[2 * i], 1)).alias(f"_b{i}") for i in range(len(percentiles))])
    values = (met.select(*by, value, F.explode(F.array_compact(inside)).alias("_i"))
              .groupBy(*by, "_i", value).agg(F.count(F.lit(1)).alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy(value))
    values = values.withColumn("_upto", upto)
    at = _join_groups(values, _join_groups(groups.select(*by, "_n"), below, by, "inner"), by, "inner")
    n = F.col("_n").cast("double")
    hits = []
    for i, (name, p) in enumerate(percentiles.items()):
        k = F.floor(n * F.lit(p)) - F.col(f"_b{i}")          # its place inside the bracket
        here = (F.col("_i") == i) & (F.col("_upto") - F.col("_c") <= k) & (k < F.col("_upto"))
        hits.append(F.max(F.when(here, v)).alias(name))
    out = at.groupBy(*by).agg(*hits)
    return out.select(*by, *[F.coalesce(name, F.raise_error(F.lit(f"{name} lies outside of its bracket")).cast(dict(df.dtypes)[value])).alias(name)
                             for name in percentiles])


def summary_stats(df: DataFrame, value: str, by: Sequence[str], levels: int = 4,
                  groups: DataFrame | None = None, percentiles: str = "select") -> DataFrame:
    """N, mean, min, max, sample sd, cv %, 95 % half-width,
    nearest-rank p50/p95/p99 (element floor(n*p) of the sorted sample), labels.

    n = 1 gives sd/cv NULL; mean 0 gives cv NULL. ``groups`` (the requested
    groups) turns absent groups into all-zero rows (the empty-sample rule).
    ``percentiles``: ``select`` finds them by selection (``nearest_ranks``),
    ``sort`` numbers a written range sort of the samples; the values are the same.
    """
    by = list(by)
    v = F.col(value)
    mom = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.stddev_samp(v).alias("sd"))
    nd = F.col("n").cast("double")
    pct = nearest_ranks(df, value, by) if percentiles == "select" else sorted_ranks(df, value, by)
    s = _join_groups(mom, pct, by, "left")
    cv = F.try_divide(F.lit(100.0) * F.col("sd"), F.col("mean"))
    out = s.select(
        *by, F.col("n").cast("long").alias("n"), _d(F.col("mean")).alias("mean"),
        F.col("min"), F.col("max"), _d(F.col("sd")).alias("stddev"), _d(cv).alias("cv"),
        _d(F.lit(Z95) * F.col("sd") / F.sqrt(nd)).alias("ci95"),
        *[F.col(k) for k in PERCENTILES],
        consistency_label(cv, levels).alias("consistency"),
        confidence_label(F.col("n")).alias("confidence"))
    if groups is None:
        return out
    cols = [c for c in out.columns if c not in by]
    g = _join_groups(groups.select(*by).distinct(), out.withColumn("_present", F.lit(True)), by, "left")
    absent = F.col("_present").isNull()
    types = dict(out.dtypes)
    # an absent group is an all-zero sample, labelled like one
    zero_label = {"consistency": consistency_label(F.lit(0.0), levels), "confidence": confidence_label(F.lit(0))}
    return g.select(*by, *[
        F.when(absent, zero_label.get(c, F.lit(0).cast(types[c]))).otherwise(F.col(c)).alias(c) for c in cols])


def two_sample_ttest(df: DataFrame, value: str, group: str, a: str, b: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """Pooled two-sample t-test of ``group == a`` vs ``group == b`` per ``by``:
    t = |mean_a - mean_b| / (sp * sqrt(1/na + 1/nb)), df = na + nb - 2,
    step p-value, significant = p < 0.05, Cohen's d = |diff| / sp and its label."""
    by = list(by)
    v, g = F.col(value), F.col(group)
    s = df.where(g.isin(a, b)).groupBy(*by).agg(
        F.count(F.when(g == a, v)).alias("n1"), F.count(F.when(g == b, v)).alias("n2"),
        F.avg(F.when(g == a, v)).alias("m1"), F.avg(F.when(g == b, v)).alias("m2"),
        F.var_samp(F.when(g == a, v)).alias("v1"), F.var_samp(F.when(g == b, v)).alias("v2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    pooled = F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), n1 + n2 - 2)
    sp = F.sqrt(pooled)
    diff = F.abs(F.col("m1") - F.col("m2"))
    t = F.try_divide(diff, sp * F.sqrt(F.lit(1.0) / n1 + F.lit(1.0) / n2))
    d = F.try_divide(diff, sp)
    p = step_p_value(t)
    return s.select(*by, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                    _d(F.col("m1")).alias("mean1"), _d(F.col("m2")).alias("mean2"),
                    _d(t).alias("t_stat"), (F.col("n1") + F.col("n2") - 2).cast("long").alias("dof"),
                    p.alias("p_value"), (p < SIGNIFICANCE).alias("significant"),
                    _d(d).alias("effect_size"), effect_label(d).alias("effect"))


def compare_systems(df: DataFrame, value: str, system: str, baseline: str, other: str,
                    by: Sequence[str] = (), items: int | None = None,
                    outlier_over: float | None = 200.0) -> DataFrame:
    """Mean ratio other/baseline, difference, faster system, per-item
    cost, and the cold-start outlier flag (max of ``other`` above a limit, with
    its ratio to the baseline mean)."""
    by = list(by)
    v, s = F.col(value), F.col(system)
    g = df.where(s.isin(baseline, other)).groupBy(*by).agg(
        F.avg(F.when(s == baseline, v)).alias("mb"), F.avg(F.when(s == other, v)).alias("mo"),
        F.max(F.when(s == other, v)).alias("xo"))
    cols = [*by, _d(F.col("mb")).alias("mean_baseline"), _d(F.col("mo")).alias("mean_other"),
            _d(F.try_divide(F.col("mo"), F.col("mb"))).alias("ratio"),
            _d(F.col("mo") - F.col("mb")).alias("delta"),
            F.when(F.col("mb") <= F.col("mo"), F.lit(baseline)).otherwise(F.lit(other)).alias("faster")]
    if items:
        cols += [_d(F.col("mb") / items).alias("per_item_baseline"), _d(F.col("mo") / items).alias("per_item_other")]
    if outlier_over is not None:
        cols += [(F.col("xo") > outlier_over).alias("outlier"),
                 _d(F.try_divide(F.col("xo"), F.col("mb"))).alias("outlier_ratio")]
    return g.select(*cols)
