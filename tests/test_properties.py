"""Property tests of the exactness helpers and the skew-safe position helper."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from covenant.functions.exprs import dec_mean, rate_1dp
from covenant.operators.positional import group_positions

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 5000)), min_size=1, max_size=40))
def test_rate_1dp_is_decimal_round(spark, pairs):
    pairs = [(min(r, n), n) for r, n in pairs]
    df = spark.createDataFrame(pairs, "r long, n long")
    got = [x[0] for x in df.select(rate_1dp("r", "n")).collect()]
    want = [float((Decimal(r) * 100 / Decimal(n)).quantize(Decimal("0.1"), ROUND_HALF_UP)) for r, n in pairs]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(-10 ** 12, 10 ** 12), st.integers(1, 10 ** 6)), min_size=1, max_size=30),
       st.sampled_from([2, 6]))
def test_dec_mean_rounds_half_away_from_zero(spark, rows, scale):
    data = [(Decimal(a) / 10 ** 6, n) for a, n in rows]
    df = spark.createDataFrame(data, "s decimal(38,6), n long")
    got = [x[0] for x in df.select(dec_mean("s", "n", scale)).collect()]
    q = Decimal(1).scaleb(-scale)

    def half_away(x: Decimal) -> Decimal:
        return x.copy_abs().quantize(q, ROUND_HALF_UP).copy_sign(x) if x else x.quantize(q)
    want = [half_away(s / n) for s, n in data]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 20)), min_size=1, max_size=300),
       st.integers(1, 7))
def test_group_positions_equal_row_number(spark, rows, parts):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v long, uid long")
    ours = group_positions(df, ["g"], ["v", "uid"], num_partitions=parts, size_col="n")
    w = Window.partitionBy("g")
    ref = (df.withColumn("pos", (F.row_number().over(w.orderBy("v", "uid")) - 1).cast("long"))
           .withColumn("n", F.count(F.lit(1)).over(w).cast("long")))
    cols = ["g", "v", "uid", "pos", "n"]
    assert ours.select(cols).exceptAll(ref.select(cols)).count() == 0
    assert ours.count() == df.count()


# ---------------------------------------------------------------- brute-force comparisons
from decimal import Decimal as _D  # noqa: E402

from covenant.operators.analytics import fanout_join_metrics  # noqa: E402
from covenant.operators.parity import parity_ledger  # noqa: E402
from covenant.sources.items import put_items  # noqa: E402
from tests.conftest import make_tables  # noqa: E402

_times = st.sampled_from(["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", None])
_amounts = st.one_of(st.none(), st.integers(-5, 5))


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 6), _times), max_size=25),
       st.lists(st.tuples(st.integers(1, 6), _amounts, _times), max_size=25))
def test_fanout_rewrite_equals_literal_join(spark, events, ledger):
    t = make_tables(spark, [(i, "Bound", "Evil", "X", None) for i in range(1, 5)],
                    [(k, c, tm, "e") for k, (c, tm) in enumerate(events)],
                    [(k, c, a, tm, "l") for k, (c, a, tm) in enumerate(ledger)])
    got = {r["id"]: (r["event_count"], r["gains"], r["losses"], r["last_activity"])
           for r in fanout_join_metrics(t).collect()}
    want = {}
    for cid in range(1, 5):
        ev = [e for e in events if e[0] == cid] or [None]
        lg = [g for g in ledger if g[0] == cid] or [None]
        rows = [(e, g) for e in ev for g in lg]
        cnt = sum(1 for e, _ in rows if e is not None)
        amt = [g[1] if g is not None else None for _, g in rows]
        gains = sum((a for a in amt if a is not None and a > 0), 0)
        losses = sum((-a for a in amt if a is not None and a < 0), 0)
        times = [e[1] for e, _ in rows if e is not None and e[1] is not None]
        want[cid] = (cnt, _D(gains), _D(losses), max(times) if times else None)
    assert {k: (v[0], v[1], v[2], None if v[3] is None else str(v[3])) for k, v in got.items()} == want


def _reference_compare(left, right):
    """The positional comparison rules, written out directly (per contract)."""
    issues = set()
    for cid in {c for c, *_ in left} | {c for c, *_ in right}:
        key = lambda r: (r[1] is not None, r[1] or "", r[2] or "", r[3] if r[3] is not None else -10 ** 9)  # noqa
        a = sorted((r for r in left if r[0] == cid), key=key)
        b = sorted((r for r in right if r[0] == cid), key=key)
        if len(a) != len(b):
            issues.add((str(cid), "count", None))
        for i in range(min(len(a), len(b))):
            if a[i][1] != b[i][1]:
                issues.add((str(cid), "timestamp", i))
            if (a[i][2] or "") != (b[i][2] or ""):
                issues.add((str(cid), "description", i))
            if (a[i][3] is not None or b[i][3] is not None) and a[i][3] != b[i][3]:
                issues.add((str(cid), "amount", i))
    return issues


_ledger_rows = st.lists(st.tuples(st.integers(1, 3), _times, st.sampled_from(["p", "q", None]),
                                  st.integers(-3, 3)), max_size=12)


@SETTINGS
@given(_ledger_rows, _ledger_rows)
def test_positional_parity_equals_reference_rules(spark, left, right):
    def tables(rows):
        return make_tables(spark, [], [], [(k, c, a, tm, d) for k, (c, tm, d, a) in enumerate(rows)])
    got = {(r["contract_id"], r["field"], r["idx"])
           for r in parity_ledger(tables(left).ledger, tables(right).ledger, materialize=False).collect()}
    ms = lambda tm: None if tm is None else tm.replace(" ", "T") + ".000Z"
    want = _reference_compare([(c, ms(tm), d, a) for c, tm, d, a in left],
                              [(c, ms(tm), d, a) for c, tm, d, a in right])
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["x", "y"]), st.integers(0, 50),
                          st.sampled_from(["v1", "v2", "v3"])), min_size=1, max_size=30, unique_by=lambda r: r[2]))
def test_put_is_last_write_wins(spark, writes):
    df = spark.createDataFrame(writes, "PK string, SK string, _seq long, description string")
    got = {(r["PK"], r["SK"]): r["description"] for r in put_items(df).collect()}
    want = {}
    for pk, sk, seq, desc in sorted(writes, key=lambda w: w[2]):
        want[(pk, sk)] = desc
    assert got == want
