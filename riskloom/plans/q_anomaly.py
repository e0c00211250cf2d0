"""Registered queries: anomaly layer A1, A2, A4, A7-A11 (SQL-checkable parts).

Detector inputs for A7-A11 are the given per-account scores (iso = anomaly_score,
lof = behavior_score, ae = alert_score); the trained detectors (A3, A5, A6)
are in q_models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import anomaly as A
from riskloom.operators import metrics as M
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import union_all
from riskloom.sources import fixtures as fx

NUM = list(fx.NUMERIC_COLS)
DET = """SELECT account_id, label, ml_prob, anomaly_score AS iso_score, behavior_score AS lof_score,
  alert_score AS ae_score FROM given_scores"""
EXTRA = {"det": DET}


def detectors(spark, sf_dir):
    g = fx.given_scores(spark, sf_dir)
    return g.select("account_id", "label", "ml_prob", F.col("anomaly_score").alias("iso_score"),
                    F.col("behavior_score").alias("lof_score"), F.col("alert_score").alias("ae_score"))


_ENS = """SELECT *, CASE WHEN e >= 80 THEN 'CRITICAL' WHEN e >= 60 THEN 'HIGH' WHEN e >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS anomaly_tier,
  CAST(e >= 50 AS INTEGER) AS anomaly_label FROM (
  SELECT account_id, label, ml_prob, iso_score, lof_score, ae_score,
    least(greatest(0.3 * iso_score + 0.25 * lof_score + 0.45 * ae_score, 0.0), 100.0) AS e FROM det) x"""


@register("anomaly_ensemble", f"""SELECT account_id, e AS anomaly_score, anomaly_label, anomaly_tier FROM ({_ENS}) t""",
          ("anomaly_score",), extra=EXTRA)
def q_anomaly_ensemble(spark, sf_dir):
    """A7 + A8: weighted detector ensemble (.30/.25/.45), label (>= 50) and tier."""
    return A.ensemble(detectors(spark, sf_dir)).select("account_id", "anomaly_score", "anomaly_label", "anomaly_tier")


_FUSE = f"""SELECT account_id, label, classif_score, e AS anomaly_score, least(greatest(f, 0.0), 100.0) AS fusion_score,
  CASE WHEN f >= 80 THEN 'CRITICAL' WHEN f >= 60 THEN 'HIGH' WHEN f >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  CAST(e >= 50 AS INTEGER) AS is_anomaly, CAST(f >= 60 AS INTEGER) AS is_flagged
FROM (SELECT *, 0.65 * classif_score + (1 - 0.65) * e AS f FROM (
  SELECT *, least(greatest(ml_prob * 100, 0.0), 100.0) AS classif_score FROM ({_ENS}) a) b) c"""


@register("anomaly_fusion", f"SELECT account_id, classif_score, anomaly_score, fusion_score, risk_tier, is_anomaly, is_flagged FROM ({_FUSE}) t",
          ("classif_score", "anomaly_score", "fusion_score"), extra=EXTRA)
def q_anomaly_fusion(spark, sf_dir):
    """Classifier / anomaly fusion (alpha .65) joined by account id, tier and flags."""
    e = A.ensemble(detectors(spark, sf_dir))
    f = A.fuse(e)
    return f.select("account_id", "classif_score", "anomaly_score", "fusion_score", "risk_tier", "is_anomaly", "is_flagged")


@register("anomaly_detection_table", union_all([f"""
SELECT CAST({t} AS INTEGER) AS threshold, CAST(count(*) FILTER (WHERE e >= {t} AND label = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE e < {t} AND label = 1) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE e >= {t} AND label = 0) AS BIGINT) AS fp,
  count(*) FILTER (WHERE e >= {t} AND label = 1) / (count(*) FILTER (WHERE label = 1) + 1e-9) AS recall,
  count(*) FILTER (WHERE e >= {t} AND label = 0) / (count(*) FILTER (WHERE label = 0) + 1e-9) AS fpr
FROM ({_ENS}) x""" for t in A.DETECTION_THRESHOLDS]), ("recall", "fpr"), extra=EXTRA)
def q_anomaly_detection_table(spark, sf_dir):
    """A10: tp / fn / fp / recall / fpr at thresholds 40..80 in one aggregate (no cross join)."""
    return A.detection_table(A.ensemble(detectors(spark, sf_dir)))


@register("anomaly_detection_quality", f"""
WITH st AS (SELECT e AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM ({_ENS}) x GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM st
      WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT sum(pos * (n - fp + 0.5 * neg)) / (max(p) * max(n)) AS roc_auc, sum(pos / p * (tp / (tp + fp))) AS average_precision FROM c""".replace("WITH st", "SELECT * FROM (WITH st") + ") z",
          ("roc_auc", "average_precision"), extra=EXTRA)
def q_anomaly_detection_quality(spark, sf_dir):
    """A10: ROC-AUC and average precision of the ensemble score as a detector of the label."""
    return M.binary_metrics(A.ensemble(detectors(spark, sf_dir)), "anomaly_score", "label").select("roc_auc", "average_precision")


@register("anomaly_score_histogram", f"""
SELECT label, CAST(least(floor(e / 2.0), 49) AS INTEGER) AS bin, count(*) AS n FROM ({_ENS}) x GROUP BY 1, 2""",
          extra=EXTRA)
def q_anomaly_score_histogram(spark, sf_dir):
    """50-bin histogram of the ensemble score by class."""
    return A.score_histogram(A.ensemble(detectors(spark, sf_dir)), "anomaly_score")


@register("anomaly_score_summary", f"""
SELECT label, count(*) AS n, avg(e) AS mean, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.9) AS p90,
  quantile_cont(e, 0.99) AS p99 FROM ({_ENS}) x GROUP BY label""", ("mean", "p50", "p90", "p99"), extra=EXTRA)
def q_anomaly_score_summary(spark, sf_dir):
    """Mean / p50 / p90 / p99 of the ensemble score per class."""
    return A.score_summary(A.ensemble(detectors(spark, sf_dir)), "anomaly_score")


@register("anomaly_detector_corr", """
SELECT covar_pop(iso_score, lof_score) / (stddev_pop(iso_score) * stddev_pop(lof_score)) AS iso_lof,
  covar_pop(iso_score, ae_score) / (stddev_pop(iso_score) * stddev_pop(ae_score)) AS iso_ae,
  covar_pop(lof_score, ae_score) / (stddev_pop(lof_score) * stddev_pop(ae_score)) AS lof_ae FROM det""",
          ("iso_lof", "iso_ae", "lof_ae"), extra=EXTRA)
def q_anomaly_detector_corr(spark, sf_dir):
    """Pairwise correlation of the detector scores."""
    d = detectors(spark, sf_dir)

    def c(a, b):
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return d.agg(c("iso_score", "lof_score").alias("iso_lof"), c("iso_score", "ae_score").alias("iso_ae"),
                 c("lof_score", "ae_score").alias("lof_ae"))


# ---- A1 / A2 / A4 on the account features -------------------------------------------------

@register("anomaly_legit_impute", union_all([
    f"SELECT '{c}' AS column_name, coalesce(quantile_cont({c}, 0.5), 0.0) AS median FROM account_profile WHERE label = 0"
    for c in NUM]), ("median",))
def q_anomaly_legit_impute(spark, sf_dir):
    """A1: training split = legitimate accounts; per-feature median fill (then 0)."""
    p = fx.account_profile(spark, sf_dir).filter(F.col("label") == 0)
    return spark.createDataFrame(list(A.fit_impute_medians(p, NUM).items()), "column_name string, median double")


_NORM_COLS = ["inflow", "ev_count", "max_price"]


@register("anomaly_percentile_normalise", f"""
SELECT p.account_id, {', '.join(
    f"least(greatest((coalesce(CAST(p.{c} AS DOUBLE), 0.0) - b.lo_{c}) / (b.hi_{c} - b.lo_{c} + 1e-9), 0.0), 1.0) * 100 AS {c}_norm, "
    f"least(greatest(((-coalesce(CAST(p.{c} AS DOUBLE), 0.0)) - (-b.hi_{c})) / ((-b.lo_{c}) - (-b.hi_{c}) + 1e-9), 0.0), 1.0) * 100 AS {c}_inv"
    for c in _NORM_COLS)}
FROM account_profile p, (SELECT {', '.join(
    f"quantile_cont(coalesce(CAST({c} AS DOUBLE), 0.0), 0.01) AS lo_{c}, quantile_cont(coalesce(CAST({c} AS DOUBLE), 0.0), 0.99) AS hi_{c}"
    for c in _NORM_COLS)} FROM account_profile WHERE label = 0) b""",
          [f"{c}_norm" for c in _NORM_COLS] + [f"{c}_inv" for c in _NORM_COLS])
def q_anomaly_percentile_normalise(spark, sf_dir):
    """A2: percentile normalisation (p1 / p99 of legitimate rows), plain and inverted."""
    p = fx.account_profile(spark, sf_dir).select(
        "account_id", "label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _NORM_COLS])
    train = p.filter(F.col("label") == 0)
    m = A.PercentileNormaliser(_NORM_COLS).fit(train)
    inv = A.PercentileNormaliserModel(m.bounds, invert=True, suffix="_inv")
    return inv.transform(m.transform(p)).select("account_id", *[f"{c}_norm" for c in _NORM_COLS],
                                                *[f"{c}_inv" for c in _NORM_COLS])


@register("anomaly_robust_scale", f"""
SELECT p.account_id, {', '.join(
    f"(CAST(p.{c} AS DOUBLE) - s.med_{c}) / (CASE WHEN s.q3_{c} - s.q1_{c} = 0 THEN 1.0 ELSE s.q3_{c} - s.q1_{c} END) AS {c}"
    for c in _NORM_COLS)}
FROM account_profile p, (SELECT {', '.join(
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS med_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
    for c in _NORM_COLS)} FROM account_profile WHERE label = 0) s""", _NORM_COLS)
def q_anomaly_robust_scale(spark, sf_dir):
    """A4: robust scaling (x - median) / IQR fitted on legitimate rows."""
    p = fx.account_profile(spark, sf_dir).select("account_id", "label", *_NORM_COLS)
    m = A.fit_robust_scaler(p.filter(F.col("label") == 0), _NORM_COLS)
    return m.transform(p).select("account_id", *[F.col(c).cast("double").alias(c) for c in _NORM_COLS])
