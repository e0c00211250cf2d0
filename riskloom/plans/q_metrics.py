"""Registered queries: evaluation M2, M3, M10-M15, M17, M21 on the given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators.folds import fold_sql, stratified_folds
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import union_all
from riskloom.sources import fixtures as fx

SC = "ml_prob"


def _scores(spark, sf_dir):
    return fx.given_scores(spark, sf_dir)


_ST = f"""SELECT CAST({SC} AS DOUBLE) AS s, CAST(sum(CAST(label = 1 AS BIGINT)) AS BIGINT) AS pos,
  CAST(sum(CAST(label <> 1 AS BIGINT)) AS BIGINT) AS neg FROM given_scores GROUP BY 1"""
_CUM = """SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM st"""
_PR = """SELECT s AS threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS recall FROM cum"""
CTE = {"st": _ST, "cum": _CUM, "pr": _PR}


@register("metrics_binary", f"""
SELECT a.average_precision, a.auc / (a.n_pos * a.n_neg) AS roc_auc, b.brier,
  CASE WHEN b.tp + b.fp > 0 THEN b.tp / (b.tp + b.fp) ELSE 0.0 END AS precision,
  CASE WHEN b.tp + b.fn > 0 THEN b.tp / (b.tp + b.fn) ELSE 0.0 END AS recall,
  a.n_pos, a.n_neg,
  CASE WHEN b.tp > 0 THEN 2.0 * (b.tp / (b.tp + b.fp)) * (b.tp / (b.tp + b.fn))
       / ((b.tp / (b.tp + b.fp)) + (b.tp / (b.tp + b.fn))) ELSE 0.0 END AS f1
FROM (SELECT sum(CASE WHEN P > 0 THEN pos / P ELSE 0.0 END * (tp / (tp + fp))) AS average_precision,
             sum(pos * (N - fp + 0.5 * neg)) AS auc, CAST(max(P) AS BIGINT) AS n_pos, CAST(max(N) AS BIGINT) AS n_neg
      FROM cum) a,
     (SELECT avg(({SC} - label) * ({SC} - label)) AS brier,
             sum(CAST({SC} >= 0.5 AND label = 1 AS BIGINT)) AS tp, sum(CAST({SC} >= 0.5 AND label <> 1 AS BIGINT)) AS fp,
             sum(CAST({SC} < 0.5 AND label = 1 AS BIGINT)) AS fn FROM given_scores) b
""", ("average_precision", "roc_auc", "brier", "precision", "recall", "f1"), extra=CTE)
def q_metrics_binary(spark, sf_dir):
    """Step-sum average precision, rank-sum ROC-AUC, Brier, P/R/F1 at 0.5."""
    return M.binary_metrics(_scores(spark, sf_dir), SC, "label", 0.5)


@register("metrics_pr_curve", "SELECT threshold, precision, recall FROM pr",
          ("threshold", "precision", "recall"), extra=CTE)
def q_metrics_pr_curve(spark, sf_dir):
    """Precision-recall curve at every distinct score."""
    return M.pr_curve(_scores(spark, sf_dir), SC, "label").select("threshold", "precision", "recall")


@register("metrics_roc_curve", "SELECT s AS threshold, fp / N AS fpr, tp / P AS tpr FROM cum",
          ("threshold", "fpr", "tpr"), extra=CTE)
def q_metrics_roc_curve(spark, sf_dir):
    """ROC curve at every distinct score."""
    return M.roc_curve(_scores(spark, sf_dir), SC, "label")


_OPT = """SELECT threshold, f1, precision, recall FROM (
  SELECT *, CASE WHEN max(valid) OVER () = 1 THEN f1 * valid ELSE f1 END AS k FROM (
    SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1, CAST(recall >= 0.8 AS INTEGER) AS valid
    FROM pr) a) b ORDER BY k DESC, threshold ASC LIMIT 1"""


@register("metrics_optimal_threshold", _OPT, ("threshold", "f1", "precision", "recall"), extra=CTE)
def q_metrics_optimal_threshold(spark, sf_dir):
    """F1-optimal threshold subject to recall >= 0.80 (lowest threshold on ties)."""
    return M.optimal_threshold(_scores(spark, sf_dir), SC, "label")


_CONF_SQL = f"""
SELECT CAST(sum(CAST({SC} < o.threshold AND label <> 1 AS BIGINT)) AS BIGINT) AS tn,
       CAST(sum(CAST({SC} >= o.threshold AND label <> 1 AS BIGINT)) AS BIGINT) AS fp,
       CAST(sum(CAST({SC} < o.threshold AND label = 1 AS BIGINT)) AS BIGINT) AS fn,
       CAST(sum(CAST({SC} >= o.threshold AND label = 1 AS BIGINT)) AS BIGINT) AS tp
FROM given_scores, opt o"""


@register("metrics_confusion", _CONF_SQL, extra={**CTE, "opt": _OPT})
def q_metrics_confusion(spark, sf_dir):
    """Confusion matrix at the fitted optimal threshold."""
    df = _scores(spark, sf_dir)
    th = M.optimal_threshold(df, SC, "label").first()["threshold"]
    return M.confusion(df, SC, "label", th)


def _cal_sql(n_bins: int = 10) -> str:
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    b = " + ".join(f"CAST(CAST({e!r} AS DOUBLE) < {SC} AS INTEGER)" for e in edges)
    return (f"SELECT CAST({b} AS INTEGER) AS bin, avg(CAST(label AS DOUBLE)) AS prob_true, avg({SC}) AS prob_pred, "
            f"count(*) AS n FROM given_scores GROUP BY 1")


@register("metrics_calibration", _cal_sql(), ("prob_true", "prob_pred"))
def q_metrics_calibration(spark, sf_dir):
    """10 uniform calibration bins (fraction positive, mean probability)."""
    return M.calibration_bins(_scores(spark, sf_dir), SC, "label")


def _sweep_sql() -> str:
    grid = M.linspace(0.01, 0.99, 200)
    vals = ", ".join(f"(CAST({g!r} AS DOUBLE))" for g in grid)
    return f"""
SELECT threshold, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (SELECT g.t AS threshold,
        CASE WHEN sum(CAST({SC} >= g.t AS BIGINT)) > 0
             THEN sum(CAST({SC} >= g.t AND label = 1 AS BIGINT)) / sum(CAST({SC} >= g.t AS BIGINT)) ELSE 0.0 END AS precision,
        CASE WHEN sum(CAST(label = 1 AS BIGINT)) > 0
             THEN sum(CAST({SC} >= g.t AND label = 1 AS BIGINT)) / sum(CAST(label = 1 AS BIGINT)) ELSE 0.0 END AS recall
      FROM (VALUES {vals}) g(t), given_scores GROUP BY g.t) x"""


@register("metrics_threshold_sweep", _sweep_sql(), ("threshold", "precision", "recall", "f1"))
def q_metrics_threshold_sweep(spark, sf_dir):
    """Precision / recall / F1 on a 200-point threshold grid (no cross join)."""
    return M.threshold_sweep(_scores(spark, sf_dir), SC, "label")


@register("metrics_class_weight", """
SELECT CAST(sum(CAST(label = 1 AS BIGINT)) AS BIGINT) AS n_pos, CAST(count(*) - sum(CAST(label = 1 AS BIGINT)) AS BIGINT) AS n_neg,
       (count(*) - sum(CAST(label = 1 AS BIGINT))) / greatest(sum(CAST(label = 1 AS BIGINT)), 1) AS scale_pos_weight
FROM account_profile""", ("scale_pos_weight",))
def q_metrics_class_weight(spark, sf_dir):
    """M2: class weight n_neg / max(n_pos, 1)."""
    return M.class_weight(fx.account_profile(spark, sf_dir), "label")


@register("metrics_folds", f"SELECT account_id, label, {fold_sql()} AS fold FROM account_profile")
def q_metrics_folds(spark, sf_dir):
    """M3: deterministic stratified 5-fold assignment (distributed exact rank)."""
    p = fx.account_profile(spark, sf_dir).select("account_id", "label")
    return stratified_folds(p, "account_id", "label", 5)


_FOLD_SQL = f"""
WITH c AS (SELECT *, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS recall FROM (
    SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
           sum(neg) OVER (PARTITION BY fold ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
           sum(pos) OVER (PARTITION BY fold) AS P, sum(neg) OVER (PARTITION BY fold) AS N
    FROM (SELECT fold, CAST({SC} AS DOUBLE) AS s, sum(CAST(label = 1 AS BIGINT)) AS pos,
                 sum(CAST(label <> 1 AS BIGINT)) AS neg FROM sf GROUP BY 1, 2) g) w),
best AS (SELECT fold, s AS threshold, precision, recall FROM c QUALIFY row_number() OVER (PARTITION BY fold
    ORDER BY CASE WHEN recall >= 0.8 THEN 0 ELSE 1 END, 2 * precision * recall / (precision + recall + 1e-9) DESC, s) = 1)
SELECT a.fold, a.pr_auc, a.roc_auc, b.brier, t.threshold, t.precision, t.recall,
  CASE WHEN t.precision + t.recall > 0 THEN 2 * t.precision * t.recall / (t.precision + t.recall) ELSE 0.0 END AS f1
FROM (SELECT fold, sum(CASE WHEN P > 0 THEN pos / P ELSE 0.0 END * precision) AS pr_auc,
             sum(pos * (N - fp + 0.5 * neg)) / (max(P) * max(N)) AS roc_auc FROM c GROUP BY fold) a
JOIN (SELECT fold, avg(({SC} - label) * ({SC} - label)) AS brier FROM sf GROUP BY fold) b ON a.fold = b.fold
JOIN best t ON a.fold = t.fold
"""
_SF = f"SELECT *, {fold_sql()} AS fold FROM given_scores"
_FM_DOUBLES = ("pr_auc", "roc_auc", "brier", "threshold", "precision", "recall", "f1")


def _scores_with_folds(spark, sf_dir):
    return stratified_folds(_scores(spark, sf_dir), "account_id", "label", 5)


@register("metrics_fold_metrics", "SELECT * FROM fm", _FM_DOUBLES, extra={"sf": _SF, "fm": _FOLD_SQL})
def q_metrics_fold_metrics(spark, sf_dir):
    """M9/M17 inputs: per-fold AP, ROC-AUC, Brier, P/R/F1 of out-of-fold scores."""
    return M.fold_metrics(_scores_with_folds(spark, sf_dir), SC, "label", "fold")


@register("metrics_cv_summary", union_all([
    f"SELECT '{m}' AS metric, avg({m}) AS mean, stddev_pop({m}) AS std FROM fm"
    for m in ("f1", "recall", "precision", "roc_auc", "pr_auc")]), ("mean", "std"),
    extra={"sf": _SF, "fm": _FOLD_SQL})
def q_metrics_cv_summary(spark, sf_dir):
    """Mean and population std of fold metrics."""
    return M.cv_summary(M.fold_metrics(_scores_with_folds(spark, sf_dir), SC, "label", "fold"))


@register("metrics_best_model", """
SELECT model, pr_auc FROM (
  SELECT 'ml_prob' AS model, sum(CASE WHEN P > 0 THEN pos / P ELSE 0.0 END * tp / (tp + fp)) AS pr_auc FROM cum
  UNION ALL
  SELECT 'anomaly_score', sum(CASE WHEN P > 0 THEN pos / P ELSE 0.0 END * tp / (tp + fp)) FROM cum2) x
ORDER BY pr_auc DESC, model LIMIT 1""", ("pr_auc",), extra={
    **CTE, "st2": """SELECT CAST(anomaly_score / 100 AS DOUBLE) AS s, CAST(sum(CAST(label = 1 AS BIGINT)) AS BIGINT) AS pos,
      CAST(sum(CAST(label <> 1 AS BIGINT)) AS BIGINT) AS neg FROM given_scores GROUP BY 1""",
    "cum2": _CUM.replace("FROM st", "FROM st2")})
def q_metrics_best_model(spark, sf_dir):
    """The model with the best out-of-fold AP (here: classifier vs anomaly score)."""
    df = _scores(spark, sf_dir).withColumn("anomaly_p", F.col("anomaly_score") / 100)
    a = M.binary_metrics(df, SC, "label").select(F.lit("ml_prob").alias("model"),
                                                 F.col("average_precision").alias("pr_auc"))
    b = M.binary_metrics(df, "anomaly_p", "label").select(F.lit("anomaly_score").alias("model"),
                                                          F.col("average_precision").alias("pr_auc"))
    return a.unionByName(b).orderBy(F.desc("pr_auc"), "model").limit(1)
