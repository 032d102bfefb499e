import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from covenant.session import checkpoint_dir, get_spark  # noqa: E402
from covenant.sources.binding import Tables  # noqa: E402
from covenant.sources.schemas import CONTRACTS, EVENTS, LEDGER  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="covenant-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


def ts(s):
    return dt.datetime.fromisoformat(s) if s else None


def D(x):
    return None if x is None else Decimal(str(x))


def make_tables(spark, contracts, events, ledger) -> Tables:
    """contracts: (id, status, type, location, updated_at); events: (id, cid, time, desc);
    ledger: (id, cid, amount, time, desc)."""
    c = spark.createDataFrame([(i, s, t, l, ts(u)) for i, s, t, l, u in contracts], CONTRACTS)
    e = spark.createDataFrame([(i, c_, ts(t), d) for i, c_, t, d in events], EVENTS)
    lg = spark.createDataFrame([(i, c_, D(a), ts(t), d) for i, c_, a, t, d in ledger], LEDGER)
    return Tables(c, e, lg)
