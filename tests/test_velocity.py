"""Trailing windows against a plain loop: NaN, NULL, infinities and large amounts stay inside their windows."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskloom.operators import velocity as V

SCHEMA = "account_id string, transaction_id long, ts timestamp_ntz, amount double"
T0 = dt.datetime(2024, 3, 1)


def loop(rows, windows):
    out = []
    for account, tid, ts, amount in rows:
        clean = None if amount is None or amount != amount else amount
        own = [account, tid, ts, clean]
        for w in windows.values():
            seen = [a for k, _, t, a in rows if k == account and ((ts is None and t is None) or (None not in (ts, t) and ts - dt.timedelta(seconds=w) <= t <= ts))]
            known = [a for a in seen if a is not None and a == a]
            own += [len(seen), sum(known) if known else None]
        out.append(tuple(own))
    return sorted(out, key=str)


def got(spark, rows, windows, **own):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in V.trailing_windows(df, "account_id", "ts", "amount", windows, **own).collect()), key=str)


def test_nan_and_large_amounts(spark):
    late = T0 + dt.timedelta(days=200)
    for first in (float("nan"), 1e17, float("inf"), None):
        rows = [("a", 1, T0, 10.0), ("a", 2, T0, first), ("a", 3, late, 5.25), ("a", 4, late + dt.timedelta(hours=1), 7.5)]
        found = {r[1]: r for r in got(spark, rows, V.WINDOWS)}
        assert [found[3][5], found[3][7], found[3][9]] == [5.25] * 3 and [found[4][5], found[4][7], found[4][9]] == [12.75] * 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 400), st.sampled_from([1.0, -2.5, None, float("nan"), 2.0**60])), max_size=40), st.sampled_from([3600, 60, 1800]))
def test_equals_a_loop(spark, events, slice_s):
    """Instants on a grid of 30 minutes, so that many fall on a window's ends and on each other; widths of one slice and of more."""
    rows = [(a, k, None if m % 50 == 49 else T0 + dt.timedelta(minutes=30 * m), x) for k, (a, m, x) in enumerate(events)]
    windows = {"1h": 3600, "5h": 5 * 3600, "2d": 2 * 86400}
    assert got(spark, rows, windows, slice_s=slice_s) == loop(rows, windows)


def test_repeated_rows_and_an_empty_table(spark):
    rows = [("a", 1, T0, 1.0)] * 3 + [("a", 1, T0 + dt.timedelta(hours=2), 1.0)]
    assert got(spark, rows, V.WINDOWS) == loop(rows, V.WINDOWS)
    assert got(spark, [], V.WINDOWS) == []
