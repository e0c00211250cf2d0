"""Golden values of the scoring formula (six demo scenarios) and explanation goldens."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import scoring

# (account, ml, anomaly, behaviour, alert) -> (base, boost, n_elevated, score, category)
GOLDEN = {
    "ACC-001": ((95, 88, 91, 87), (91.25, 1.95, 4, 100.0, "BLOCK")),
    "ACC-002": ((78, 45, 72, 60), (65.85, 1.22, 2, 80.337, "SAFE")),
    "ACC-003": ((22, 68, 38, 42), (39.70, 1.00, 1, 39.70, "MONITOR")),
    "ACC-004": ((15, 30, 25, 88), (31.70, 1.35, 1, 42.795, "MONITOR")),
    "ACC-005": ((3, 12, 18, 8), (9.00, 1.00, 0, 9.00, "SAFE")),
    "ACC-006": ((28, 35, 30, 22), (29.25, 1.00, 0, 29.25, "SAFE")),
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(k, *map(float, v[0])) for k, v in GOLDEN.items()]
    df = spark.createDataFrame(rows, "account_id string, ml_prob double, anomaly_score double, "
                                     "behavior_score double, alert_score double")
    return scoring.score_components(df).cache()


def test_golden_six(scored):
    got = {r.account_id: r for r in scored.collect()}
    for k, (_, (base, boost, n_el, score, cat)) in GOLDEN.items():
        r = got[k]
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert r.boost_multiplier == pytest.approx(boost, abs=1e-9)
        assert r.n_elevated == n_el
        assert r.risk_score == pytest.approx(score, abs=1e-6)
        assert r.risk_category == cat


def test_contiguous_gap_mode(scored):
    c = scored.select("account_id", scoring.category_expr(F.col("risk_score"), "contiguous").alias("c"))
    got = {r.account_id: r.c for r in c.collect()}
    assert got["ACC-002"] == "REVIEW"   # 80.337 falls in the reference's gap
    assert got["ACC-001"] == "BLOCK"


def test_counterfactual_acc001(scored):
    cf = X.counterfactual(scored.filter("account_id = 'ACC-001'")).orderBy("rank").collect()
    assert [r.component for r in cf] == ["ml_prob", "anomaly_score"]
    assert round(cf[0].needed, 1) == 69.4 and round(cf[0].drop_needed, 1) == 25.6
    assert round(cf[1].needed, 1) == 47.0 and round(cf[1].drop_needed, 1) == 41.0


def test_severity_drivers_acc001(scored):
    d = X.severity_drivers(scored.filter("account_id = 'ACC-001'")).orderBy("rank").collect()
    assert [round(r.contribution, 3) for r in d] == [38.0, 27.375, 22.0, 18.25, 18.2, 13.05]


def test_validation_raises(spark):
    bad = spark.createDataFrame([("X", 120.0, 1.0, 1.0, 1.0)],
                                "account_id string, ml_prob double, anomaly_score double, behavior_score double, alert_score double")
    with pytest.raises(Exception):
        scoring.score_batch(bad).collect()
    ok, rejected = scoring.quarantine(bad)
    assert ok.count() == 0 and rejected.count() == 1


def test_boundaries(spark):
    """Thresholds are strict for boosts (> 75, > 85, > 60) and inclusive for categories."""
    rows = [("a", 75.0, 75.0, 75.0, 85.0), ("b", 75.0001, 60.0, 60.0001, 85.0001)]
    df = spark.createDataFrame(rows, "account_id string, ml_prob double, anomaly_score double, "
                                     "behavior_score double, alert_score double")
    s = {r.account_id: r for r in scoring.score_components(df).collect()}
    assert s["a"].hs_ml_prob == 0.0 and s["a"].critical_boost == 0.0
    assert s["b"].hs_ml_prob == 0.12 and s["b"].critical_boost == 0.20
    assert s["b"].n_elevated == 3


def test_monotone(spark):
    """Raising one input never lowers base * boost."""
    import itertools
    vals = [0.0, 30.0, 60.0, 61.0, 75.0, 76.0, 86.0, 100.0]
    rows = [(f"{i}", *c) for i, c in enumerate(itertools.product(vals, repeat=2))]
    df = spark.createDataFrame([(r[0], r[1], r[2], 50.0, 50.0) for r in rows],
                               "account_id string, ml_prob double, anomaly_score double, behavior_score double, alert_score double")
    got = {(r.ml_prob, r.anomaly_score): r.risk_score for r in scoring.score_components(df).collect()}
    for (a, b), s in got.items():
        for a2 in vals:
            if a2 > a:
                assert got[(a2, b)] >= s - 1e-9
        assert 0.0 <= s <= 100.0
