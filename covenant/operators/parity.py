"""Cross-store parity and validation reports (V1-V7).

Every report is a DataFrame of issue rows
``(contract_id, scope, field, idx, left_value, right_value)`` with values as
text (times as ISO ms text on both sides). Nothing loops over ids: each report
is a handful of whole-table joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.functions.exprs import iso_ms
from covenant.session import materialize as materialize_table
from covenant.operators.positional import group_positions
from covenant.plans.sizing import broadcast_within
from covenant.sources.schemas import ISSUES, MONEY

UNKNOWN = "Unknown"


def _issue(contract_id, scope, field, idx, left, right) -> list[Column]:
    def lit_or(c, t):
        return (F.lit(c) if not isinstance(c, Column) else c).cast(t)
    return [lit_or(contract_id, "string").alias("contract_id"), lit_or(scope, "string").alias("scope"),
            lit_or(field, "string").alias("field"), lit_or(idx, "long").alias("idx"),
            lit_or(left, "string").alias("left_value"), lit_or(right, "string").alias("right_value")]


def empty_issues(spark) -> DataFrame:
    """An empty issue table with the issue schema."""
    return spark.createDataFrame([], ISSUES)


def _txt(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------- V1
def consistency_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """V1: left/right are (id, status). Issues: total count mismatch; ids of the
    left missing on the right; status mismatches. One-directional like the
    original check: right-only ids surface only through the count."""
    l = left.select(F.col("id").cast("string").alias("id"), F.col("status").alias("l_status"))
    r = right.select(F.col("id").cast("string").alias("r_id"), F.col("status").alias("r_status"))
    counts = (l.select(F.lit(1).alias("l"), F.lit(0).alias("r"))
              .unionByName(r.select(F.lit(0).alias("l"), F.lit(1).alias("r")))
              .agg(F.sum("l").alias("nl"), F.sum("r").alias("nr")))
    count_issue = counts.where(F.col("nl") != F.col("nr")).select(
        *_issue(None, "contracts", "count", None, _txt(F.col("nl")), _txt(F.col("nr"))))
    j = l.join(r, l.id == r.r_id, "left")
    missing = j.where(F.col("r_id").isNull()).select(
        *_issue(F.col("id"), "contracts", "missing_right", None, F.lit("present"), None))
    status = j.where(F.col("r_id").isNotNull() & ~F.col("l_status").eqNullSafe(F.col("r_status"))).select(
        *_issue(F.col("id"), "contracts", "status", None, F.col("l_status"), F.col("r_status")))
    return count_issue.unionByName(missing).unionByName(status)


# ---------------------------------------------------------------- V2
def normalize_contract(df: DataFrame) -> DataFrame:
    """(id, status default Unknown, soulType, contractLocation) with JS falsy rules."""
    return df.select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(F.nullif(F.col("contract_status"), F.lit("")), F.lit(UNKNOWN)).alias("status"),
        F.nullif(F.col("soul_type"), F.lit("")).alias("soulType"),
        F.nullif(F.col("contract_location"), F.lit("")).alias("contractLocation"),
    )


def parity_contracts(left: DataFrame, right: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """V2: per requested id: missing in both / left / right, else status, soulType
    and contractLocation compared null-safely. ``ids`` defaults to every id of
    either store (full outer join)."""
    fields3 = ("status", "soulType", "contractLocation")
    lp = normalize_contract(left).select(F.col("id").alias("lid"), F.lit(True).alias("_l"),
                                         *[F.col(c).alias("l_" + c) for c in fields3])
    rp = normalize_contract(right).select(F.col("id").alias("rid"), F.lit(True).alias("_r"),
                                          *[F.col(c).alias("r_" + c) for c in fields3])
    if ids is None:
        # every id of either store: one full outer join, each store read once
        j = lp.join(rp, F.col("lid") == F.col("rid"), "full_outer").withColumn(
            "id", F.coalesce("lid", "rid"))
    else:
        ids = ids.select(F.col(ids.columns[-1]).cast("string").alias("id")).distinct()
        j = (ids.join(lp, F.col("id") == F.col("lid"), "left")
             .join(rp, F.col("id") == F.col("rid"), "left"))
    has_l, has_r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    missing = j.where(~has_l | ~has_r).select(*_issue(
        F.col("id"), "contracts",
        F.when(~has_l & ~has_r, "missing_both").when(~has_l, "missing_left").otherwise("missing_right"),
        None, None, None))
    both = j.where(has_l & has_r)
    fields = both.select("id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col("l_" + f).alias("lv"), F.col("r_" + f).alias("rv"))
        for f in ("status", "soulType", "contractLocation")])).alias("f"))
    diffs = fields.where(~F.col("f.lv").eqNullSafe(F.col("f.rv"))).select(
        *_issue(F.col("id"), "contracts", F.col("f.field"), None, F.col("f.lv"), F.col("f.rv")))
    return missing.unionByName(diffs)


# ---------------------------------------------------------------- V3
def _collection(df: DataFrame, time_col: str, amount: bool) -> DataFrame:
    t = F.col(time_col)
    ts = t if dict(df.dtypes)[time_col] == "string" else iso_ms(t)
    return df.select(
        F.col("soul_contract_id").cast("string").alias("cid"),
        ts.alias("t"),
        F.coalesce(F.col("description"), F.lit("")).alias("d"),
        (F.col("amount").cast(MONEY) if amount else F.lit(None).cast(MONEY)).alias("a"),
    )


def _fingerprint(c: DataFrame) -> DataFrame:
    """Order-free digest of each contract's multiset of rows: the count and the
    exact sums of two independent row hashes (64-bit xxhash, 32-bit murmur3)."""
    h1 = F.xxhash64("t", "d", "a").cast("decimal(38,0)")
    h2 = F.hash("t", "d", "a").cast("decimal(38,0)")
    return c.groupBy("cid").agg(F.count(F.lit(1)).alias("n"),
                                F.struct(F.sum(h1), F.sum(h2)).alias("hs"))


def differing_blocks(pos: DataFrame, block: int) -> DataFrame:
    """The positioned rows (side, cid, pos, t, d, a) in blocks of ``block`` positions whose two sides differ: the second
    level of the hash tree above the rows, the first is the contract's fingerprint.

    A block's sides are equal if their counts and the sums of two independent hashes over (position, row) are: both sides
    are summed with opposite signs, so one aggregation with map-side partial sums compares them, whatever a contract's size.
    """
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    rows = pos.withColumn("_block", F.floor(F.col("pos") / block))
    sums = [F.sum(h("pos", "t", "d", "a").cast("decimal(38,0)") * sign) for h in (F.xxhash64, F.hash)]
    differ = (rows.groupBy(F.col("cid").alias("_bc"), F.col("_block").alias("_bb")).agg(
        F.sum(sign).alias("_n"), *[x.alias(f"_h{i}") for i, x in enumerate(sums)])
        .where("_n <> 0 or _h0 <> 0 or _h1 <> 0").select("_bc", "_bb"))
    return rows.join(differ, F.col("cid").eqNullSafe(F.col("_bc")) & (F.col("_block") == F.col("_bb")), "left_semi").drop("_block")


def parity_collection(left: DataFrame, right: DataFrame, time_col: str, scope: str,
                      amount: bool, ids: DataFrame | None = None, mode: str = "positional",
                      materialize: bool = True, block: int | None = None) -> DataFrame:
    """V3: compare two stores' time-ordered collections per contract.

    Contracts are first compared by an order-free fingerprint (count + hash sum);
    only those that differ are compared row by row. ``positional`` pairs the
    i-th rows (the reference's semantics: one lost row shifts every later
    position); ``keyed`` reports the multiset difference instead. ``block``: the
    positions of a differing contract are compared by digests of so many at
    once first, and row by row only in the blocks that differ.
    """
    lc, rc = _collection(left, time_col, amount), _collection(right, time_col, amount)
    if ids is not None:
        idf = ids.select(F.col(ids.columns[-1]).cast("string").alias("cid")).distinct()
        lc, rc = lc.join(idf, "cid", "left_semi"), rc.join(idf, "cid", "left_semi")
    lf = _fingerprint(lc).withColumnsRenamed({"n": "nl", "hs": "hl"})
    rf = _fingerprint(rc).withColumnsRenamed({"n": "nr", "hs": "hr"})
    fp = lf.join(rf, "cid", "full_outer").select(
        "cid", F.coalesce("nl", F.lit(0)).alias("nl"), F.coalesce("nr", F.lit(0)).alias("nr"),
        F.col("hl"), F.col("hr"))
    differ = fp.where((F.col("nl") != F.col("nr")) | ~F.col("hl").eqNullSafe(F.col("hr"))).select("cid")
    both = (lc.withColumn("side", F.lit(0)).unionByName(rc.withColumn("side", F.lit(1)))
            .join(differ, "cid", "left_semi"))
    if materialize:
        # the rows of differing contracts (usually few) feed the counts, a range
        # sort and the pairing: write them once to the shared checkpoint folder
        both = materialize_table(both, "parity-rows")
    side_counts = both.groupBy("cid").agg(F.count(F.when(F.col("side") == 0, 1)).alias("nl"),
                                          F.count(F.when(F.col("side") == 1, 1)).alias("nr"))
    count_issues = side_counts.where(F.col("nl") != F.col("nr")).select(
        *_issue(F.col("cid"), scope, "count", None, _txt(F.col("nl")), _txt(F.col("nr"))))
    dl = both.where(F.col("side") == 0).drop("side")
    dr = both.where(F.col("side") == 1).drop("side")
    if mode == "keyed":
        lonly = dl.exceptAll(dr).select(*_issue(F.col("cid"), scope, "missing_right", None,
                                                F.concat_ws("|", "t", "d", _txt(F.col("a"))), None))
        ronly = dr.exceptAll(dl).select(*_issue(F.col("cid"), scope, "missing_left", None, None,
                                                F.concat_ws("|", "t", "d", _txt(F.col("a")))))
        return count_issues.unionByName(lonly).unionByName(ronly)
    # one range sort positions both sides: the group is (side, contract)
    order = [F.asc_nulls_first("t"), F.asc_nulls_first("d"), F.asc_nulls_first("a")]
    pos = group_positions(both, ["side", "cid"], order)
    # pair the i-th left row with the i-th right row: (cid, pos) holds at most
    # one row per side, so one aggregation does it (no self-join, no skew)
    left_, right_ = F.col("side") == 0, F.col("side") == 1
    if block:
        pos = differing_blocks(pos, block)

    def side(c, cond):
        return F.max(F.when(cond, F.col(c)))
    pairs = (pos.groupBy("cid", "pos")
             .agg(F.count(F.when(left_, 1)).alias("_nl"), F.count(F.when(right_, 1)).alias("_nr"),
                  *[side(c, left_).alias("l" + c) for c in "tda"],
                  *[side(c, right_).alias("r" + c) for c in "tda"])
             .where((F.col("_nl") == 1) & (F.col("_nr") == 1)))
    cmp = pairs.select("cid", "pos", F.explode(F.array(
        F.struct(F.lit("timestamp").alias("field"), (~F.col("lt").eqNullSafe(F.col("rt"))).alias("bad"),
                 F.col("lt").alias("lv"), F.col("rt").alias("rv")),
        F.struct(F.lit("description").alias("field"), (F.col("ld") != F.col("rd")).alias("bad"),
                 F.lit(None).cast("string").alias("lv"), F.lit(None).cast("string").alias("rv")),
        F.struct(F.lit("amount").alias("field"),
                 ((F.col("la").isNotNull() | F.col("ra").isNotNull()) & ~F.col("la").eqNullSafe(F.col("ra"))).alias("bad"),
                 _txt(F.col("la")).alias("lv"), _txt(F.col("ra")).alias("rv")),
    )).alias("f"))
    pos_issues = cmp.where(F.col("f.bad")).select(
        *_issue(F.col("cid"), scope, F.col("f.field"), F.col("pos"), F.col("f.lv"), F.col("f.rv")))
    return count_issues.unionByName(pos_issues)


def _text_time(df: DataFrame, col: str) -> DataFrame:
    """Prefer the item store's original time text when the frame carries it."""
    if f"{col}_text" in df.columns:
        return df.drop(col).withColumnRenamed(f"{col}_text", col)
    return df


def parity_events(left: DataFrame, right: DataFrame, ids=None, mode: str = "positional",
                  materialize: bool = True) -> DataFrame:
    """V3 for events: positional (or keyed) comparison of two stores' event collections."""
    return parity_collection(_text_time(left, "event_time"), _text_time(right, "event_time"),
                             "event_time", "events", False, ids, mode, materialize)


def parity_ledger(left: DataFrame, right: DataFrame, ids=None, mode: str = "positional",
                  materialize: bool = True, block: int | None = None) -> DataFrame:
    """V3 for ledger rows: positional (or keyed) comparison including amounts."""
    return parity_collection(_text_time(left, "transaction_time"), _text_time(right, "transaction_time"),
                             "transaction_time", "ledger entries", True, ids, mode, materialize, block)


# ---------------------------------------------------------------- V4
def parity_summary(issues: DataFrame, ids: DataFrame, skip_events: bool = False,
                   skip_ledger: bool = False) -> DataFrame:
    """V4: ids checked, issue count, contracts with issues, ok flag (one row).
    ``skip_events`` / ``skip_ledger`` leave those collections' issues out."""
    skipped = (["events"] if skip_events else []) + (["ledger entries", "ledger"] if skip_ledger else [])
    if skipped:
        issues = issues.where(~F.col("scope").isin(*skipped))
    idf = ids.select(F.col(ids.columns[-1]).cast("string").alias("contract_id")).distinct()
    per_id = issues.where(F.col("contract_id").isNotNull()).groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("n_issues"))
    j = idf.join(per_id, "contract_id", "left")
    glob = issues.where(F.col("contract_id").isNull()).agg(F.count(F.lit(1)).alias("g"))
    a = j.agg(F.count(F.lit(1)).alias("ids_checked"),
              F.sum(F.coalesce("n_issues", F.lit(0))).cast("long").alias("id_issues"),
              F.count("n_issues").alias("ids_with_issues"))
    # both sides are single-row aggregates: combine them through a union + sum
    u = (a.select("ids_checked", "id_issues", "ids_with_issues", F.lit(0).cast("long").alias("g"))
         .unionByName(glob.select(*[F.lit(0).cast("long").alias(c) for c in
                                    ("ids_checked", "id_issues", "ids_with_issues")], F.col("g").cast("long"))))
    s = u.agg(*[F.sum(c).cast("long").alias(c) for c in ("ids_checked", "id_issues", "ids_with_issues", "g")])
    return s.select("ids_checked", (F.col("id_issues") + F.col("g")).alias("mismatches"),
                    "ids_with_issues", ((F.col("id_issues") + F.col("g")) == 0).alias("ok"))


def issue_counts(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """V4 (per id): issue count of every requested id, zero included."""
    idf = ids.select(F.col(ids.columns[-1]).cast("string").alias("contract_id")).distinct()
    per_id = issues.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_issues"))
    return idf.join(per_id, "contract_id", "left").select(
        "contract_id", F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


# ---------------------------------------------------------------- V6
def threshold_violations(measurements: DataFrame, limits: DataFrame) -> DataFrame:
    """V6: measurements above their system's limit. ``limits`` is (system, limit_ms),
    one row per system: broadcast behind a check of its size, so a system holding
    a third of all measurements never meets a shuffle join."""
    return (measurements.join(broadcast_within(limits), "system", "inner")
            .where(F.col("elapsed_ms") > F.col("limit_ms"))
            .select("scenario", "system", "iteration", "elapsed_ms", "limit_ms"))


# ---------------------------------------------------------------- V7
def items_vs_tables(items: DataFrame, tables) -> DataFrame:
    """V7: per contract and kind, item count vs normalized row count (key
    collisions of the item store show up as count mismatches)."""
    from covenant.sources.items import PK_PREFIX, item_kind
    from covenant.functions.exprs import strip_prefix
    ic = (items.withColumn("kind", item_kind()).where(F.col("kind").isin("event", "ledger"))
          .groupBy(strip_prefix("PK", PK_PREFIX).alias("cid"), "kind").agg(F.count(F.lit(1)).alias("ni")))
    tc = (tables.events.select(F.col("soul_contract_id").cast("string").alias("cid"), F.lit("event").alias("kind"))
          .unionByName(tables.ledger.select(F.col("soul_contract_id").cast("string").alias("cid"),
                                            F.lit("ledger").alias("kind")))
          .groupBy("cid", "kind").agg(F.count(F.lit(1)).alias("nt")))
    j = ic.join(tc, ["cid", "kind"], "full_outer").select(
        "cid", "kind", F.coalesce("ni", F.lit(0)).alias("ni"), F.coalesce("nt", F.lit(0)).alias("nt"))
    return j.where(F.col("ni") != F.col("nt")).select(
        *_issue(F.col("cid"), F.col("kind"), "count", None, _txt(F.col("ni")), _txt(F.col("nt"))))


def parity_report(left, right, ids: DataFrame | None = None, include_events: bool = True,
                  include_ledger: bool = True, mode: str = "positional") -> DataFrame:
    """V2 + V3 for two stores (``Tables``): contract issues, then event and ledger
    issues unless switched off (the skip-events / skip-ledger switches)."""
    out = parity_contracts(left.contracts, right.contracts, ids)
    if include_events:
        out = out.unionByName(parity_events(left.events, right.events, ids, mode))
    if include_ledger:
        out = out.unionByName(parity_ledger(left.ledger, right.ledger, ids, mode))
    return out
