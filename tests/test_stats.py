import math
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from covenant.operators.positional import group_positions
from covenant.operators.stats import compare_systems, summary_stats, two_sample_ttest


def sample(spark, groups):
    rows = [(g, "s", i, float(v)) for g, vals in groups.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "scenario string, system string, iteration long, elapsed_ms double")


def test_nearest_rank_percentiles(spark):
    df = sample(spark, {"a": range(1, 101), "b": range(1, 21), "c": [7]})
    r = {x["scenario"]: x for x in summary_stats(df, "elapsed_ms", ["scenario"]).collect()}
    assert (r["a"]["p95"], r["a"]["p50"], r["a"]["p99"]) == (96.0, 51.0, 100.0)
    assert (r["b"]["p95"], r["b"]["p50"]) == (20.0, 11.0)
    assert (r["c"]["p95"], r["c"]["p50"], r["c"]["p99"]) == (7.0, 7.0, 7.0)


def test_small_samples_and_empty_groups(spark):
    df = sample(spark, {"one": [5], "zero_mean": [-1, 1]})
    groups = spark.createDataFrame([("one",), ("zero_mean",), ("absent",)], "scenario string")
    r = {x["scenario"]: x for x in summary_stats(df, "elapsed_ms", ["scenario"], groups=groups).collect()}
    assert r["one"]["stddev"] is None and r["one"]["cv"] is None
    assert r["zero_mean"]["cv"] is None
    assert r["absent"]["n"] == 0 and r["absent"]["mean"] == 0
    assert r["absent"]["consistency"] == "Excellent" and r["absent"]["confidence"] == "LOW"


def test_labels(spark):
    df = sample(spark, {"a": [10, 10.5, 9.5] * 40})
    r = summary_stats(df, "elapsed_ms", ["scenario"], levels=3).first()
    assert r["consistency"] == "Excellent" and r["confidence"] == "HIGH"


def _two(mean, sd, n=10):
    a = sd * math.sqrt((n - 1) / n)
    return [mean + a] * (n // 2) + [mean - a] * (n // 2)


def test_golden_ttest(spark):
    rows = [("p", "kv", i, v) for i, v in enumerate(_two(37.1, 12.4))] + \
           [("p", "sql", i, v) for i, v in enumerate(_two(88.7, 32.1))]
    df = spark.createDataFrame(rows, "scenario string, system string, iteration long, elapsed_ms double")
    t = two_sample_ttest(df, "elapsed_ms", "system", "kv", "sql", ["scenario"]).first()
    assert t["p_value"] == 0.001 and t["significant"] and t["effect"] == "large"
    assert abs(float(t["effect_size"]) - 2.12) < 0.01 and abs(float(t["t_stat"]) - 4.74) < 0.01
    c = compare_systems(df, "elapsed_ms", "system", "kv", "sql", ["scenario"]).first()
    assert abs(float(c["ratio"]) - 2.39) < 0.01 and c["faster"] == "kv"


def test_step_p_values(spark):
    from covenant.functions.labels import step_p_value
    df = spark.createDataFrame([(2.0,), (2.2,), (2.6,), (3.1,)], "t double")
    assert [r[0] for r in df.select(step_p_value(F.col("t"))).collect()] == [0.1, 0.05, 0.01, 0.001]


def test_group_positions_match_window_on_a_hot_group(spark):
    # one group holds most rows; several range partitions must share it
    rows = [("hot", i % 997, i) for i in range(5000)] + [(f"g{i % 7}", i % 13, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, uid long")
    ours = group_positions(df, ["g"], [F.col("v"), F.col("uid")], num_partitions=6)
    ref = df.withColumn("pos", (F.row_number().over(Window.partitionBy("g").orderBy("v", "uid")) - 1).cast("long"))
    assert ours.select("g", "v", "uid", "pos").exceptAll(ref).count() == 0
    hot_slices = (df.repartitionByRange(6, "g", "v", "uid").where(F.col("g") == "hot")
                  .select(F.spark_partition_id().alias("p")).distinct().count())
    assert hot_slices > 1


def test_decimal_stats_types(spark):
    df = sample(spark, {"a": [1, 2, 3]})
    r = summary_stats(df, "elapsed_ms", ["scenario"]).first()
    assert r["mean"] == Decimal("2.0000") and r["stddev"] == Decimal("1.0000")


def test_null_group_keeps_its_percentiles(spark):
    df = spark.createDataFrame([(None, "s", i, float(i)) for i in range(1, 11)] +
                               [("a", "s", i, float(i)) for i in range(1, 11)],
                               "scenario string, system string, iteration long, elapsed_ms double")
    r = {x["scenario"]: x for x in summary_stats(df, "elapsed_ms", ["scenario"]).collect()}
    assert (r[None]["p50"], r[None]["p95"]) == (6.0, 10.0) == (r["a"]["p50"], r["a"]["p95"])


def test_missing_group_follows_the_nan_rules(spark):
    """A scenario without samples of one system: the statistics are NULL and the
    step functions fall through exactly as they do for NaN in the original."""
    df = spark.createDataFrame([("only_a", "kv", i, float(i)) for i in range(1, 6)],
                               "scenario string, system string, iteration long, elapsed_ms double")
    t = two_sample_ttest(df, "elapsed_ms", "system", "kv", "sql", ["scenario"]).first()
    assert t["n2"] == 0 and t["t_stat"] is None and t["effect_size"] is None
    assert (t["p_value"], t["significant"], t["effect"]) == (0.2, False, "large")
    c = compare_systems(df, "elapsed_ms", "system", "kv", "sql", ["scenario"]).first()
    assert c["ratio"] is None and c["faster"] == "sql"
