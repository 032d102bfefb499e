"""Aggregations and rankings over (contracts, events, ledger).

Scale notes (apply to every operator here):
* child tables are reduced to one row per contract *before* any join
  (partial + final HashAggregate, so a hot contract collapses map-side);
* joins are then 1:1 on the contract id, so no join key can be skewed;
* the only unpartitioned windows run after reduction to locations or days,
  whose counts are bounded by the dimension, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covenant.functions.exprs import SUM_MONEY, dec_mean, rate_1dp, zero_money
from covenant.operators.positional import prefix_sums, ranks
from covenant.plans.sizing import sort_bounded
from covenant.sources.binding import Tables

REDEEMED = "Redeemed"


# ---------------------------------------------------------------- per contract
def ledger_totals(ledger: DataFrame) -> DataFrame:
    """SUM(amount) per contract."""
    return (ledger.groupBy("soul_contract_id")
            .agg(F.sum("amount").cast(SUM_MONEY).alias("total_power_per_soul")))


def gains_losses(ledger: DataFrame) -> DataFrame:
    """A10: sum of positive amounts and of |negative| amounts per contract."""
    a = F.col("amount")
    return (ledger.groupBy("soul_contract_id")
            .agg(F.sum(F.when(a > 0, a).otherwise(0)).cast(SUM_MONEY).alias("gains"),
                 F.sum(F.when(a < 0, F.abs(a)).otherwise(0)).cast(SUM_MONEY).alias("losses")))


def last_activity(events: DataFrame) -> DataFrame:
    """MAX(event_time) per contract."""
    return events.groupBy("soul_contract_id").agg(F.max("event_time").alias("last_activity"))


def _event_stats(events: DataFrame) -> DataFrame:
    return (events.groupBy(F.col("soul_contract_id").alias("e_cid"))
            .agg(F.count("id").alias("n_events"), F.max("event_time").alias("last_activity")))


def _ledger_stats(ledger: DataFrame) -> DataFrame:
    a = F.col("amount")
    return (ledger.groupBy(F.col("soul_contract_id").alias("l_cid"))
            .agg(F.count(F.lit(1)).alias("n_ledger_rows"),
                 F.count("id").alias("n_ledger"),
                 F.sum(a).cast(SUM_MONEY).alias("sum_amount"),
                 F.sum(F.when(a > 0, a).otherwise(0)).cast(SUM_MONEY).alias("g"),
                 F.sum(F.when(a < 0, F.abs(a)).otherwise(0)).cast(SUM_MONEY).alias("x")))


def contract_stats(t: Tables) -> DataFrame:
    """Per contract: counts and sums of its events and ledger rows (one row per contract).

    Columns: id, contract_status, soul_type, contract_location, updated_at,
    n_events, last_activity, n_ledger_rows, n_ledger, sum_amount, g, x.
    """
    c = t.contracts
    j = (c.join(_event_stats(t.events), c.id == F.col("e_cid"), "left")
          .join(_ledger_stats(t.ledger), c.id == F.col("l_cid"), "left"))
    return j.select(
        "id", "contract_status", "soul_type", "contract_location", "updated_at",
        F.coalesce("n_events", F.lit(0)).alias("n_events"), "last_activity",
        F.coalesce("n_ledger_rows", F.lit(0)).alias("n_ledger_rows"),
        F.coalesce("n_ledger", F.lit(0)).alias("n_ledger"),
        "sum_amount",
        F.coalesce("g", zero_money()).alias("g"),
        F.coalesce("x", zero_money()).alias("x"),
    )


def fanout_join_metrics(t: Tables, corrected: bool = False) -> DataFrame:
    """Per-contract metrics of contracts LEFT events LEFT ledger.

    The literal join multiplies each contract's E events by its L ledger rows.
    We never build those E*L rows; the joined aggregates are exactly
    event_count = E * max(L,1), gains = G * max(E,1), losses = X * max(E,1)
    (``corrected=True`` gives E, G, X: each row counted once).
    """
    s = contract_stats(t)
    e_mult = F.greatest(F.col("n_events"), F.lit(1))
    l_mult = F.greatest(F.col("n_ledger_rows"), F.lit(1))
    if corrected:
        ev, g, x = F.col("n_events"), F.col("g"), F.col("x")
    else:
        ev = F.col("n_events") * l_mult
        g = F.col("g") * e_mult
        x = F.col("x") * e_mult
    return s.select(
        "id", "contract_location", "soul_type",
        ev.cast("long").alias("event_count"),
        g.cast(SUM_MONEY).alias("gains"),
        x.cast(SUM_MONEY).alias("losses"),
        "last_activity",
    )


# ---------------------------------------------------------------- dashboards
def location_dashboard(t: Tables, redeemed: str = REDEEMED) -> DataFrame:
    """A1 (flagship): per location soul_count, redeemed, total_power,
    avg_power_per_soul (mean of per-contract totals, 0 when none) and
    redemption_rate (1 dp), ordered by total_power desc."""
    lt = ledger_totals(t.ledger).withColumnRenamed("soul_contract_id", "l_cid")
    c = t.contracts.select("id", "contract_status", "contract_location")
    j = c.join(lt, c.id == lt.l_cid, "left")
    power = F.coalesce(F.col("total_power_per_soul"), zero_money())
    g = (j.groupBy("contract_location")
         .agg(F.count(F.lit(1)).alias("soul_count"),
              F.count(F.when(F.col("contract_status") == redeemed, 1)).alias("redeemed"),
              F.sum(power).cast(SUM_MONEY).alias("total_power")))
    return (g.select(
        "contract_location", "soul_count", "redeemed", "total_power",
        dec_mean("total_power", "soul_count").alias("avg_power_per_soul"),
        rate_1dp("redeemed", "soul_count").alias("redemption_rate"))
        .transform(lambda d: sort_bounded(d, F.desc_nulls_first("total_power"),
                                          F.asc_nulls_last("contract_location"))))


def _ranked_locations(per_contract: DataFrame, active_over: int = 5) -> DataFrame:
    net = F.col("gains") - F.col("losses")
    g = (per_contract.where((F.col("gains") > 0) | (F.col("losses") > 0))
         .groupBy("contract_location")
         .agg(F.count(F.lit(1)).alias("total_souls"),
              F.sum(net).cast(SUM_MONEY).alias("net_sum"),
              F.count(F.when(F.col("event_count") > active_over, 1)).alias("active_souls")))
    avg_exact = F.col("net_sum") / F.col("total_souls")
    # one row per location: an unpartitioned rank over a bounded row count
    w = Window.orderBy(F.desc_nulls_first("avg_exact"))
    return (g.withColumn("avg_exact", avg_exact)
            .select("contract_location", "total_souls",
                    dec_mean("net_sum", "total_souls", 2).alias("avg_net_power"),
                    "active_souls",
                    F.rank().over(w).cast("long").alias("profitability_rank"),
                    rate_1dp("active_souls", "total_souls").alias("activity_rate"))
            .transform(lambda d: sort_bounded(d, "profitability_rank", F.asc_nulls_last("contract_location"))))


def risk_analysis_fanout(t: Tables, active_over: int = 5) -> DataFrame:
    """A3: risk ranking with the reference's fan-out multiplicities (see J3); a
    contract is active with more than ``active_over`` (joined) events."""
    return _ranked_locations(fanout_join_metrics(t, corrected=False), active_over)


def risk_analysis(t: Tables, active_over: int = 5) -> DataFrame:
    """Same ranking, each event and ledger row counted once (our correction)."""
    return _ranked_locations(fanout_join_metrics(t, corrected=True), active_over)


def _joined_location_stats(t: Tables, redeemed: str) -> DataFrame:
    """Location aggregates over contracts LEFT ledger *rows* (1:N), without the join rows.

    A contract with L ledger rows contributes max(L,1) joined rows.
    """
    lg = (t.ledger.groupBy(F.col("soul_contract_id").alias("l_cid"))
          .agg(F.count(F.lit(1)).alias("l_rows"),
               F.sum(F.coalesce(F.col("amount"), F.lit(0))).cast(SUM_MONEY).alias("l_sum")))
    c = t.contracts.select("id", "contract_status", "contract_location")
    j = c.join(lg, c.id == lg.l_cid, "left")
    rows = F.greatest(F.coalesce(F.col("l_rows"), F.lit(0)), F.lit(1))
    return (j.groupBy("contract_location")
            .agg(F.sum(rows).cast("long").alias("n_rows"),
                 F.sum(F.when(F.col("contract_status") == redeemed, rows).otherwise(0))
                 .cast("long").alias("n_redeemed"),
                 F.sum(F.coalesce(F.col("l_sum"), zero_money())).cast(SUM_MONEY).alias("sum_power")))


def location_dashboard_joined(t: Tables, redeemed: str = REDEEMED) -> DataFrame:
    """A4: benchmark dashboard, COUNT/AVG over contract x ledger rows."""
    g = _joined_location_stats(t, redeemed)
    return (g.select(
        "contract_location",
        F.col("n_rows").alias("soul_count"),
        F.col("n_redeemed").alias("redeemed"),
        F.col("sum_power").alias("total_power"),
        dec_mean("sum_power", "n_rows").alias("avg_power_per_soul"),
        rate_1dp("n_redeemed", "n_rows").alias("redemption_rate"))
        .transform(lambda d: sort_bounded(d, F.desc_nulls_first("total_power"),
                                          F.asc_nulls_last("contract_location"))))


def location_profitability(t: Tables, redeemed: str = REDEEMED) -> DataFrame:
    """A5: location stats + rank by average joined amount; activity 100/0."""
    g = _joined_location_stats(t, redeemed).withColumn(
        "avg_exact", F.col("sum_power") / F.col("n_rows"))
    w = Window.orderBy(F.desc_nulls_first("avg_exact"))
    return (g.select(
        "contract_location",
        F.col("n_rows").alias("total_contracts"),
        F.col("n_redeemed").alias("redeemed_count"),
        rate_1dp("n_redeemed", "n_rows").alias("redemption_rate"),
        dec_mean("sum_power", "n_rows", 2).alias("avg_net_power"),
        F.rank().over(w).cast("long").alias("profitability_rank"),
        F.when(F.col("n_redeemed") > 0, F.lit(100.0)).otherwise(F.lit(0.0)).alias("activity_rate"))
        .transform(lambda d: sort_bounded(d, "profitability_rank", F.asc_nulls_last("contract_location"))))


# ---------------------------------------------------------------- time series
def daily_totals(ledger: DataFrame) -> DataFrame:
    """Ledger sum per calendar day of transaction_time."""
    return (ledger.groupBy(F.to_date("transaction_time").alias("contract_date"))
            .agg(F.sum("amount").cast(SUM_MONEY).alias("daily_total")))


def running_totals(daily: DataFrame) -> DataFrame:
    """W3 + W4: running total by day (RANGE UNBOUNDED PRECEDING .. CURRENT ROW)
    and rank of the day by its total.

    The window is unpartitioned but runs over one row per calendar day, a count
    bounded by the date range and not by the data volume.
    """
    w_run = Window.orderBy(F.asc_nulls_first("contract_date")).rangeBetween(Window.unboundedPreceding,
                                                                             Window.currentRow)
    w_rank = Window.orderBy(F.desc_nulls_first("daily_total"))
    return daily.select(
        "contract_date", "daily_total",
        F.sum("daily_total").over(w_run).cast(SUM_MONEY).alias("running_total"),
        F.rank().over(w_rank).cast("long").alias("day_rank"),
    ).transform(lambda d: sort_bounded(d, "contract_date"))


def contract_activity_ranks(t: Tables) -> DataFrame:
    """W1 + W2 with a group per contract: contracts ranked by their number of
    ledger rows, with and without gaps (ties share a rank)."""
    n = t.ledger.groupBy(F.col("soul_contract_id").alias("l_cid")).agg(F.count(F.lit(1)).alias("n"))
    per = t.contracts.select("id").join(n, F.col("id") == F.col("l_cid"), "left").select("id", F.coalesce("n", F.lit(0)).alias("entries"))
    return ranks(per, "entries", "activity_rank", "activity_dense_rank")


def ledger_running_totals(ledger: DataFrame) -> DataFrame:
    """W3 + W4 with a group per day and contract: ledger sums and their running
    total in the order (day, contract), without a window over all groups."""
    daily = (ledger.groupBy(F.to_date("transaction_time").alias("contract_date"), "soul_contract_id")
             .agg(F.sum("amount").cast(SUM_MONEY).alias("daily_total")))
    rows = prefix_sums(daily, [F.col("contract_date").asc_nulls_first(), F.col("soul_contract_id").asc_nulls_first()],
                       {"running_total": F.col("daily_total")})
    return rows.withColumn("running_total", F.col("running_total").cast(SUM_MONEY))


def dataset_summary(t: Tables) -> DataFrame:
    """Row count of each relation of a store, one row per relation."""
    def cnt(df, name):
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
    return cnt(t.contracts, "contracts").unionByName(cnt(t.events, "events")).unionByName(cnt(t.ledger, "ledger"))


def location_dashboard_items(items: DataFrame, locations=None, redeemed: str = REDEEMED) -> DataFrame:
    """A2: the dashboard computed from the item shape (location index + ledger items).

    Only contract items present in the sparse (location, status) index count;
    ``status`` alone decides "redeemed" (as the item reader does); an absent
    amount counts 0; the rate is not rounded; empty locations are dropped.
    ``locations`` restricts to a list (None = every indexed location).
    """
    from covenant.sources.items import CONTRACT_SK, LEDGER_PREFIX, location_index

    idx = location_index(items).where(F.col("SK") == CONTRACT_SK)
    if locations is not None:
        idx = idx.where(F.col("contract_location").isin(list(locations)))
    ci = idx.select(F.col("PK").alias("c_pk"), "status", "contract_location")
    li = (items.where(F.col("SK").startswith(LEDGER_PREFIX))
          .groupBy(F.col("PK").alias("l_pk"))
          .agg(F.sum(F.coalesce(F.col("amount"), F.lit(0))).cast(SUM_MONEY).alias("s")))
    j = ci.join(li, ci.c_pk == li.l_pk, "left")
    g = (j.groupBy("contract_location")
         .agg(F.count(F.lit(1)).alias("soul_count"),
              F.count(F.when(F.col("status") == redeemed, 1)).alias("redeemed"),
              F.sum(F.coalesce(F.col("s"), zero_money())).cast(SUM_MONEY).alias("total_power")))
    return (g.where(F.col("soul_count") > 0).select(
        "contract_location", "soul_count", "redeemed", "total_power",
        dec_mean("total_power", "soul_count").alias("avg_power_per_soul"),
        (F.col("redeemed").cast("double") / F.col("soul_count") * F.lit(100.0)).alias("redemption_rate"))
        .transform(lambda d: sort_bounded(d, F.desc_nulls_first("total_power"),
                                          F.asc_nulls_last("contract_location"))))
