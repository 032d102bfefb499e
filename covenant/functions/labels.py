"""Label and step functions of the sample statistics (T6-T9) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (thresholds and labels of the statistics report) ----
P_STEPS = [(3.0, 0.001), (2.5, 0.01), (2.0, 0.05), (1.5, 0.1)]   # t > bound -> p
P_OTHERWISE = 0.2
SIGNIFICANCE = 0.05
EFFECT_LABELS = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")]  # d < bound -> label
EFFECT_OTHERWISE = "large"
CONSISTENCY_3 = [(20.0, "Excellent"), (40.0, "Good")]                  # cv < bound -> label
CONSISTENCY_3_OTHERWISE = "Variable"
CONSISTENCY_4 = [(20.0, "Excellent"), (40.0, "Good"), (60.0, "Variable")]
CONSISTENCY_4_OTHERWISE = "Highly Variable"
CONFIDENCE = [(100, "HIGH"), (50, "MEDIUM")]                         # n >= bound -> label
CONFIDENCE_OTHERWISE = "LOW"
Z95 = 1.96


def _chain(pairs, test, otherwise) -> Column:
    expr = None
    for bound, value in pairs:
        cond = test(bound)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(otherwise))


def step_p_value(t: Column) -> Column:
    """The step approximation of a two-sided p-value from |t|."""
    return _chain(P_STEPS, lambda b: t > b, P_OTHERWISE)


def effect_label(d: Column) -> Column:
    """Cohen's d size label."""
    return _chain(EFFECT_LABELS, lambda b: d < b, EFFECT_OTHERWISE)


def consistency_label(cv: Column, levels: int = 4) -> Column:
    """Coefficient-of-variation label, 3 or 4 levels."""
    if levels == 3:
        return _chain(CONSISTENCY_3, lambda b: cv < b, CONSISTENCY_3_OTHERWISE)
    return _chain(CONSISTENCY_4, lambda b: cv < b, CONSISTENCY_4_OTHERWISE)


def confidence_label(n: Column) -> Column:
    """Sample-size confidence label."""
    return _chain(CONFIDENCE, lambda b: n >= b, CONFIDENCE_OTHERWISE)
