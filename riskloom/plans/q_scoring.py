"""Registered queries: risk scoring K1-K9, K18."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import anomaly, scoring
from riskloom.plans.registry import register
from riskloom.sources import fixtures as fx

_K_DOUBLES = ("risk_score", "ml_contrib", "anomaly_contrib", "behavior_contrib",
              "alert_contrib", "base_score", "boost_multiplier")


def _score_sql(src: str, ml: str = "ml_prob * 100", gap: str = "reference") -> str:
    """Oracle SQL of K3-K9 over a relation with the four component columns."""
    if gap == "contiguous":
        cat = ("CASE WHEN s >= 81 THEN 'BLOCK' WHEN s >= 61 THEN 'REVIEW' "
               "WHEN s >= 31 THEN 'MONITOR' ELSE 'SAFE' END")
    else:
        cat = ("CASE WHEN s >= 81 AND s <= 100 THEN 'BLOCK' WHEN s >= 61 AND s <= 80 THEN 'REVIEW' "
               "WHEN s >= 31 AND s <= 60 THEN 'MONITOR' WHEN s >= 0 AND s <= 30 THEN 'SAFE' "
               "ELSE 'SAFE' END")
    return f"""
SELECT account_id, s AS risk_score, {cat} AS risk_category,
       ml_contrib, anomaly_contrib, behavior_contrib, alert_contrib,
       base_score, boost_multiplier, n_elevated
FROM (
  SELECT *, least(greatest(base_score * boost_multiplier, 0.0), 100.0) AS s
  FROM (
    SELECT *, ml_contrib + anomaly_contrib + behavior_contrib + alert_contrib AS base_score,
           1.0 + (CASE WHEN m > 75 THEN 0.12 ELSE 0.0 END)
               + (CASE WHEN a > 75 THEN 0.10 ELSE 0.0 END)
               + (CASE WHEN b > 75 THEN 0.08 ELSE 0.0 END)
               + (CASE WHEN r > 75 THEN 0.15 ELSE 0.0 END)
               + (CASE WHEN r > 85 THEN 0.20 ELSE 0.0 END)
               + (CASE WHEN n_elevated >= 3 THEN CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE)
                       WHEN n_elevated >= 2 THEN 0.10 ELSE 0.0 END) AS boost_multiplier
    FROM (
      SELECT account_id, m, a, b, r,
             0.40 * m AS ml_contrib, 0.25 * a AS anomaly_contrib,
             0.20 * b AS behavior_contrib, 0.15 * r AS alert_contrib,
             CAST((m > 60)::INT + (a > 60)::INT + (b > 60)::INT + (r > 60)::INT AS INTEGER) AS n_elevated
      FROM (SELECT account_id, CAST({ml} AS DOUBLE) AS m, CAST(anomaly_score AS DOUBLE) AS a,
                   CAST(behavior_score AS DOUBLE) AS b, CAST(alert_score AS DOUBLE) AS r
            FROM {src}) x0) x1) x2) x3
"""


@register("risk_score_batch", _score_sql("given_scores"), _K_DOUBLES)
def risk_score_batch(spark, sf_dir):
    """K1-K9: score every account from its four component scores (probability scaled)."""
    return scoring.score_batch(fx.given_scores(spark, sf_dir), raw_prob=True)


@register("risk_score_contiguous", _score_sql("given_scores", gap="contiguous"), _K_DOUBLES)
def risk_score_contiguous(spark, sf_dir):
    """K8 with contiguous bands (>=81/>=61/>=31)."""
    return scoring.score_batch(fx.given_scores(spark, sf_dir), raw_prob=True,
                               gap_mode="contiguous")


_RAW_SQL = """SELECT account_id, CAST(outflow / (inflow + 1e-9) * 100 AS DOUBLE) AS ml_prob,
  max_price / 4500 AS anomaly_score, CAST(coalesce(ev_count, 0) AS DOUBLE) AS behavior_score,
  CAST(n_urgent AS DOUBLE) AS alert_score
FROM account_profile"""


@register("risk_input_quarantine", """
SELECT account_id, ml_prob, anomaly_score, behavior_score, alert_score
FROM raw_components
WHERE NOT (coalesce(ml_prob BETWEEN 0 AND 100, false) AND coalesce(anomaly_score BETWEEN 0 AND 100, false)
       AND coalesce(behavior_score BETWEEN 0 AND 100, false) AND coalesce(alert_score BETWEEN 0 AND 100, false))
""", ("ml_prob", "anomaly_score", "behavior_score", "alert_score"), extra={"raw_components": _RAW_SQL})
def risk_input_quarantine(spark, sf_dir):
    """K1 lenient mode: raw (un-normalised) profile signals used as component scores;
    rows with any value outside [0, 100] or missing are split off by one predicate."""
    p = fx.account_profile(spark, sf_dir)
    raw = p.select("account_id", (F.col("outflow") / (F.col("inflow") + 1e-9) * 100).alias("ml_prob"),
                   (F.col("max_price") / 4500).alias("anomaly_score"),
                   F.coalesce(F.col("ev_count"), F.lit(0)).cast("double").alias("behavior_score"),
                   F.col("n_urgent").cast("double").alias("alert_score"))
    _, bad = scoring.quarantine(raw)
    return bad


_PROFILE_COMPONENTS_SQL = """
SELECT account_id,
       least(greatest((os - lo_os) / (hi_os - lo_os + 1e-9), 0.0), 1.0) * 100 AS ml_prob,
       least(greatest((mp - lo_mp) / (hi_mp - lo_mp + 1e-9), 0.0), 1.0) * 100 AS anomaly_score,
       least(greatest((ec - lo_ec) / (hi_ec - lo_ec + 1e-9), 0.0), 1.0) * 100 AS behavior_score,
       least(greatest((nu - lo_nu) / (hi_nu - lo_nu + 1e-9), 0.0), 1.0) * 100 AS alert_score
FROM (SELECT account_id, label,
             coalesce(outflow / (inflow + 1e-9), 0.0) AS os, coalesce(max_price, 0.0) AS mp,
             CAST(coalesce(ev_count, 0) AS DOUBLE) AS ec, CAST(coalesce(n_urgent, 0) AS DOUBLE) AS nu
      FROM account_profile) p,
     (SELECT quantile_cont(os, 0.01) AS lo_os, quantile_cont(os, 0.99) AS hi_os,
             quantile_cont(mp, 0.01) AS lo_mp, quantile_cont(mp, 0.99) AS hi_mp,
             quantile_cont(ec, 0.01) AS lo_ec, quantile_cont(ec, 0.99) AS hi_ec,
             quantile_cont(nu, 0.01) AS lo_nu, quantile_cont(nu, 0.99) AS hi_nu
      FROM (SELECT coalesce(outflow / (inflow + 1e-9), 0.0) AS os, coalesce(max_price, 0.0) AS mp,
                   CAST(coalesce(ev_count, 0) AS DOUBLE) AS ec, CAST(coalesce(n_urgent, 0) AS DOUBLE) AS nu
            FROM account_profile WHERE label = 0) t) b
"""


@register("risk_score_profile", _score_sql("profile_components", ml="ml_prob"), _K_DOUBLES,
          extra={"profile_components": _PROFILE_COMPONENTS_SQL})
def risk_score_profile(spark, sf_dir):
    """Minimum slice + K18: account profile -> four percentile-normalised components
    (A2, bounds fitted on legitimate accounts) -> K1-K9."""
    prof = fx.account_profile(spark, sf_dir)
    return scoring.score_batch(profile_components(prof), raw_prob=False)


def profile_components(prof):
    raw = prof.select(
        "account_id", "label",
        F.coalesce(F.col("outflow") / (F.col("inflow") + 1e-9), F.lit(0.0)).alias("os"),
        F.coalesce(F.col("max_price"), F.lit(0.0)).alias("mp"),
        F.coalesce(F.col("ev_count"), F.lit(0)).cast("double").alias("ec"),
        F.coalesce(F.col("n_urgent"), F.lit(0)).cast("double").alias("nu"))
    model = anomaly.PercentileNormaliser(["os", "mp", "ec", "nu"], lo=0.01, hi=0.99).fit(
        raw.filter(F.col("label") == 0))
    out = model.transform(raw)
    return out.select("account_id",
                      F.col("os_norm").alias("ml_prob"), F.col("mp_norm").alias("anomaly_score"),
                      F.col("ec_norm").alias("behavior_score"), F.col("nu_norm").alias("alert_score"))


_INTEGRATED_SQL = """
SELECT p.account_id, coalesce(g.ml_prob * 100, 0.0) AS ml_prob,
  coalesce(least(greatest(0.3 * g.anomaly_score + 0.25 * g.behavior_score + 0.45 * g.alert_score, 0.0), 100.0), 0.0)
    AS anomaly_score,
  0.0 AS behavior_score, 0.0 AS alert_score
FROM account_profile p LEFT JOIN given_scores g ON p.account_id = g.account_id
"""


@register("risk_score_integrated", _score_sql("integrated", ml="ml_prob"), _K_DOUBLES,
          extra={"integrated": _INTEGRATED_SQL})
def risk_score_integrated(spark, sf_dir):
    """Accounts + classifier probability (x100) + anomaly ensemble joined by account id;
    behaviour / alert columns absent -> 0; then K9."""
    g = fx.given_scores(spark, sf_dir)
    ml = g.select("account_id", (F.col("ml_prob") * 100).alias("ml_prob"))
    det = g.select("account_id", F.col("anomaly_score").alias("iso_score"),
                   F.col("behavior_score").alias("lof_score"), F.col("alert_score").alias("ae_score"))
    an = anomaly.ensemble(det).select("account_id", "anomaly_score")
    accts = fx.account_profile(spark, sf_dir).select("account_id")
    return scoring.score_batch(scoring.integrate(accts, ml, an), raw_prob=False)
