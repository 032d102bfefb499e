"""Distributed running totals against a plain loop."""
import random

from pyspark.sql import functions as F

from covenant.operators.positional import prefix_sums


def test_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 2, 3]), i, rng.randrange(-5, 9)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k int, i int, v long")
    got = {r.i: (r.total, r.nth) for r in prefix_sums(df, [F.col("k").asc_nulls_first(), F.col("i").desc()],
                                                      {"total": F.col("v"), "nth": F.lit(1)}, 7).collect()}
    total, want = 0, {}
    for nth, (k, i, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1])), 1):
        total += v
        want[i] = (total, nth)
    assert got == want


def test_empty_and_no_window_over_all_rows(spark):
    df = spark.createDataFrame([], "i int, v long")
    assert prefix_sums(df, ["i"], {"total": F.col("v")}).collect() == []
    plan = prefix_sums(spark.range(1000), ["id"], {"total": F.col("id")}, 5)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_slice" in plan
