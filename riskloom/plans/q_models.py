"""Registered queries: trained models and detectors (M1, M4, M8, M9, M16, M18-M20,
F10, A3, A5, A6, A12, B21). Model fits are iterative / randomised, so most of
these are checked by property tests (tests/test_training.py) and row counts; the
deterministic projections (M1, M19, M20) also have oracle SQL."""

from __future__ import annotations

from functools import partial
from uuid import uuid4

from pyspark.sql import functions as F

from riskloom.operators import anomaly as A
from riskloom.operators import detectors as D
from riskloom.operators import metrics as M
from riskloom.operators import models as ML
from riskloom.operators import scoring
from riskloom.operators.folds import stratified_folds
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import union_all
from riskloom.sources import fixtures as fx
from riskloom.session import checkpoint_dir, cut_lineage

FEATS = [c for c in fx.NUMERIC_COLS if c not in ("n_null_dates", "n_order_keys")]


def training_set(spark, sf_dir):
    p = fx.account_profile(spark, sf_dir)
    data, feats, _ = ML.prepare_training(p, "account_id", "label", FEATS)
    return data, feats


@register("model_training_set", union_all([
    f"SELECT account_id, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), (SELECT coalesce(quantile_cont({c}, 0.5), 0.0) "
    f"FROM account_profile)) AS value FROM account_profile" for c in FEATS]), ("value",))
def q_model_training_set(spark, sf_dir):
    """M1: id excluded, all-NULL columns dropped, median-then-0 fill (long form)."""
    data, feats = training_set(spark, sf_dir)
    return data.select("account_id", *[F.col(c).cast("double") for c in feats]).unpivot(
        ["account_id"], feats, "feature", "value")


_OOF_CACHE: dict = {}


def _oof(spark, sf_dir, which=("gbt", "rf", "lr"), prepared=None):
    """OOF probabilities (15 fits) computed once per session and input, then the
    lineage is cut with a reliable checkpoint in the shared checkpoint folder.
    ``prepared``: the caller's training set, if it has fitted one."""
    key = (spark.sparkContext.applicationId, sf_dir, which)
    if key not in _OOF_CACHE:
        data, feats = prepared or training_set(spark, sf_dir)
        data = stratified_folds(data, "account_id", "label", 5)
        oof = ML.oof_predictions(data, feats, which=which)   # checkpointed inside
        _OOF_CACHE.clear()
        _OOF_CACHE[key] = (oof, feats)
    oof, feats = _OOF_CACHE[key]
    return oof, None, feats


@register("model_oof_predictions")
def q_model_oof_predictions(spark, sf_dir):
    """M5-M7, M9: out-of-fold probabilities of GBT, random forest and weighted LR."""
    oof, _, _ = _oof(spark, sf_dir)
    return oof


@register("model_stacking")
def q_model_stacking(spark, sf_dir):
    """M16 (+ M10/M12 on the result): stacked ensemble probability, evaluated on held-out
    folds (meta-model fitted on folds != f, applied to fold f)."""
    oof, _, _ = _oof(spark, sf_dir)
    kept = oof.persist()   # read several times by each fit
    models = ML.pooled([partial(ML.fit_stacking, kept.filter(F.col("fold") != f), ["gbt", "rf", "lr"]) for f in range(5)])
    kept.unpersist()
    parts = [m.transform(oof.filter(F.col("fold") == f)).select("account_id", "label", "fold", "ensemble_prob")
             for f, m in enumerate(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("model_oof_metrics")
def q_model_oof_metrics(spark, sf_dir):
    """Average precision and ROC-AUC of each learner's OOF probabilities."""
    oof, _, _ = _oof(spark, sf_dir)
    out = None
    for name in ("gbt", "rf", "lr"):
        m = M.binary_metrics(oof, f"prob_{name}", "label").select(F.lit(name).alias("model"), "average_precision",
                                                                   "roc_auc", "brier")
        out = m if out is None else out.unionByName(m)
    return out


@register("model_attributions")
def q_model_attributions(spark, sf_dir):
    """M18 (linear, exact): per-account top-5 signed attributions coef * (x - mean)."""
    data, feats = training_set(spark, sf_dir)
    lr = ML.learners()["lr"].fit(ML.assemble(data, feats))
    means = data.agg(*[F.avg(c).alias(c) for c in feats]).first().asDict()
    return ML.linear_attributions(data, feats, list(lr.coefficients.toArray()), means)


@register("model_global_attribution")
def q_model_global_attribution(spark, sf_dir):
    """M18 global: mean |attribution| per feature, ranked (top 50)."""
    data, feats = training_set(spark, sf_dir)
    lr = ML.learners()["lr"].fit(ML.assemble(data, feats))
    means = data.agg(*[F.avg(c).alias(c) for c in feats]).first().asDict()
    return ML.global_attribution(data, feats, list(lr.coefficients.toArray()), means)


_ALIGN = ["acctbal", "inflow", "not_in_table", "ev_count", "outflow"]


@register("model_align_features", f"""
SELECT account_id, coalesce(CAST(acctbal AS DOUBLE), 0.0) AS acctbal, coalesce(CAST(inflow AS DOUBLE), 0.0) AS inflow,
  CAST(0.0 AS DOUBLE) AS not_in_table, coalesce(CAST(ev_count AS DOUBLE), 0.0) AS ev_count, coalesce(CAST(outflow AS DOUBLE), 0.0) AS outflow
FROM account_profile""")
def q_model_align_features(spark, sf_dir):
    """Align to a stored feature list (absent -> 0.0, order fixed, NULL -> 0)."""
    return ML.align_features(fx.account_profile(spark, sf_dir), _ALIGN, ["account_id"])


@register("model_inference", """
SELECT account_id, p_ml, p_anom, p_beh, mule_prob,
  CASE WHEN mule_prob >= 0.5 THEN 'MULE' ELSE 'LEGITIMATE' END AS risk_label,
  CASE WHEN mule_prob >= 0.75 THEN 'CRITICAL' WHEN mule_prob >= 0.5 THEN 'HIGH' WHEN mule_prob >= 0.25 THEN 'MEDIUM'
       ELSE 'LOW' END AS risk_tier,
  CAST(p_ml >= 0.5 AS INTEGER) + CAST(p_anom >= 0.6 AS INTEGER) + CAST(p_beh >= 0.7 AS INTEGER) AS flag_count
FROM (SELECT account_id, ml_prob AS p_ml, anomaly_score / 100 AS p_anom, behavior_score / 100 AS p_beh,
        (ml_prob + anomaly_score / 100 + behavior_score / 100) / 3 AS mule_prob FROM given_scores) g""",
          ("p_ml", "p_anom", "p_beh", "mule_prob"))
def q_model_inference(spark, sf_dir):
    """M20 on given base probabilities: ensemble mean, MULE / LEGITIMATE, tier, flag count
    against each model's own threshold."""
    g = fx.given_scores(spark, sf_dir).select(
        "account_id", F.col("ml_prob").alias("p_ml"), (F.col("anomaly_score") / 100).alias("p_anom"),
        (F.col("behavior_score") / 100).alias("p_beh"))
    g = g.withColumn("ens", (F.col("p_ml") + F.col("p_anom") + F.col("p_beh")) / 3)
    out = ML.inference(g, ["p_ml", "p_anom", "p_beh"], {"p_ml": 0.5, "p_anom": 0.6, "p_beh": 0.7}, "ens")
    return out.select("account_id", "p_ml", "p_anom", "p_beh", "mule_prob", "risk_label", "risk_tier", "flag_count")


@register("model_smote")
def q_model_smote(spark, sf_dir):
    """M4: synthetic minority rows (ratio .15, k = min(5, n_pos - 1)) on the training data."""
    data, feats = training_set(spark, sf_dir)
    return D.smote(data, feats, "account_id", "label")


@register("model_tuning")
def q_model_tuning(spark, sf_dir):
    """M8: three learners searched by average precision on fold 1, successive halving."""
    data, feats = training_set(spark, sf_dir)
    return ML.search_on_fold(stratified_folds(data, "account_id", "label", 5), feats)


# M16 / M18 on stored numbers: what a loaded model applies
_STACK = {"means": [0.4, 0.5, 0.3, 0.4], "stds": [0.2, 0.25, 0.1, 0.0], "coefs": [0.8, -0.3, 1.1, 0.5], "intercept": -0.7}


@register("model_stacking_stored", """
SELECT account_id, 1.0 / (1.0 + exp(-(CAST(-0.7 AS DOUBLE) + 0.8 * ((p1 - 0.4) / 0.2) + (-0.3) * ((p2 - 0.5) / 0.25) + 1.1 * ((p3 - 0.3) / 0.1)))) AS ensemble_prob
FROM (SELECT account_id, ml_prob AS p1, anomaly_score / 100 AS p2, behavior_score / 100 AS p3 FROM given_scores) g""", ("ensemble_prob",))
def q_model_stacking_stored(spark, sf_dir):
    """The stacked probability from stored means, deviations (one is zero) and coefficients."""
    g = fx.given_scores(spark, sf_dir).select("account_id", F.col("ml_prob").alias("prob_a"), (F.col("anomaly_score") / 100).alias("prob_b"), (F.col("behavior_score") / 100).alias("prob_c"))
    return ML.stacked_probability(g, ["a", "b", "c"], **_STACK).select("account_id", "ensemble_prob")


_COEFS = {c: round(0.1 * (k + 1) * (-1) ** k, 3) for k, c in enumerate(FEATS)}
_STORED = union_all([f"SELECT account_id, {k} AS ord, '{c}' AS feature, {_COEFS[c]} * (x.{c} - m.{c}) AS value FROM x, m" for k, c in enumerate(FEATS)])
_STORED_EXTRA = {"x": "SELECT account_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT coalesce(quantile_cont({c}, 0.5), 0.0) FROM account_profile)) AS {c}" for c in FEATS) + " FROM account_profile",
                 "m": "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in FEATS) + " FROM x", "att": _STORED}


@register("model_attributions_stored", """
SELECT account_id, CAST(rank AS INTEGER) AS rank, feature, value, CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(value) DESC, ord) AS rank FROM att) r WHERE rank <= 5""", ("value",), extra=_STORED_EXTRA)
def q_model_attributions_stored(spark, sf_dir):
    """M18 (linear, exact) from stored coefficients: per-account top-5 signed attributions coef * (x - mean)."""
    data, feats = training_set(spark, sf_dir)
    means = data.agg(*[F.avg(c).alias(c) for c in feats]).first().asDict()
    return ML.linear_attributions(data, feats, [_COEFS[c] for c in feats], means)


@register("model_global_attribution_stored", "SELECT feature, avg(abs(value)) AS mean_abs_attribution FROM att GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
          ("mean_abs_attribution",), extra=_STORED_EXTRA)
def q_model_global_attribution_stored(spark, sf_dir):
    """M18 global from stored coefficients: mean |attribution| per feature over all rows, the ten largest."""
    data, feats = training_set(spark, sf_dir)
    means = data.agg(*[F.avg(c).alias(c) for c in feats]).first().asDict()
    return ML.global_attribution(data, feats, [_COEFS[c] for c in feats], means, 10)


@register("model_feature_selection")
def q_model_feature_selection(spark, sf_dir):
    """mean |attribution| of boosted trees over all engineered columns, rank, top-N plus must-keep columns, and why a
    column was dropped."""
    from riskloom.plans import q_features as QF
    return QF.pipeline(topN=60).fit(QF.feature_input(spark, sf_dir)).importance_table(spark)


# ---- detectors -------------------------------------------------------------------------

def _legit_and_all(spark, sf_dir):
    data, feats = training_set(spark, sf_dir)
    return data.filter(F.col("label") == 0), data, feats


@register("anomaly_isolation_forest")
def q_anomaly_isolation_forest(spark, sf_dir):
    """A3: isolation forest (300 trees x 256 rows) trained on legitimate accounts,
    score normalised with inverted p1 / p99 of the training scores."""
    legit, data, feats = _legit_and_all(spark, sf_dir)
    nodes = D.fit_isolation_forest(legit, feats, "account_id", n_trees=300)
    s = cut_lineage(D.score_isolation_forest(data, nodes, feats, "account_id"))   # read twice below
    tr = s.join(legit.select("account_id"), "account_id")
    return D.normalise_scores(tr, s, "iso_raw", invert=True)


@register("anomaly_lof")
def q_anomaly_lof(spark, sf_dir):
    """A5: novelty LOF (k = 20) on robust-scaled features; reference = legitimate rows."""
    legit, data, feats = _legit_and_all(spark, sf_dir)
    rs = A.fit_robust_scaler(legit, feats)
    legit_s, data_s = rs.transform(legit), rs.transform(data)
    s = cut_lineage(D.lof_scores(legit_s, data_s, feats, "account_id", 20))
    tr = s.join(legit.select("account_id"), "account_id")
    return D.normalise_scores(tr, s, "lof_raw", invert=True)


_LOF_VECTORS = """
WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT * FROM v WHERE label = 0),
pairs AS (SELECT q.id, r.id AS ref_id, list_distance(q.e, r.e) AS dist, q.label = 0 AS own FROM v q, r),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ref_id) AS n FROM pairs WHERE own AND id <> ref_id),
tn AS (SELECT * FROM t WHERE n <= 20),
kd AS (SELECT id, max(dist) AS kdist FROM tn GROUP BY id),
lrd AS (SELECT tn.id, 1.0 / (avg(greatest(tn.dist, kd.kdist)) + 1e-10) AS lrd FROM tn JOIN kd ON tn.ref_id = kd.id GROUP BY tn.id),
qn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ref_id) AS n FROM pairs) x WHERE n <= 20),
a AS (SELECT qn.id, 1.0 / (avg(greatest(qn.dist, kd.kdist)) + 1e-10) AS lrd_q, avg(lrd.lrd) AS lrd_nn
      FROM qn JOIN kd ON qn.ref_id = kd.id JOIN lrd ON qn.ref_id = lrd.id GROUP BY qn.id)
SELECT id AS account_id, -(lrd_nn / lrd_q) AS lof_raw FROM a"""


@register("anomaly_lof_vectors", _LOF_VECTORS, ("lof_raw",))
def q_anomaly_lof_vectors(spark, sf_dir):
    """A5 on the embedding table: reference = vectors of label 0, queries = all vectors."""
    v = fx.vectors(spark, sf_dir).select(F.col("vec_id").alias("account_id"), "label", "vec")
    return D.lof_scores(v.filter(F.col("label") == 0), v, "vec", "account_id", 20)


@register("anomaly_reconstruction")
def q_anomaly_reconstruction(spark, sf_dir):
    """Reconstruction error through a linear bottleneck (PCA) of a tenth of the features, normalised."""
    legit, data, feats = _legit_and_all(spark, sf_dir)
    s = cut_lineage(D.recon_error(legit, data, feats, "account_id"))
    tr = s.join(legit.select("account_id"), "account_id")
    return D.normalise_scores(tr, s, "ae_raw", invert=False)


@register("anomaly_combined")
def q_anomaly_combined(spark, sf_dir):
    """Out-of-fold probability of the trained boosted trees + the three detectors -> ensemble -> fusion, with the model's
    label, tier and flag count (12 columns)."""
    iso = q_anomaly_isolation_forest(spark, sf_dir).select("account_id", "iso_score")
    lof = q_anomaly_lof(spark, sf_dir).select("account_id", "lof_score")
    ae = q_anomaly_reconstruction(spark, sf_dir).select("account_id", "ae_score")
    oof, _, _ = _oof(spark, sf_dir)
    base = ["prob_gbt", "prob_rf", "prob_lr"]
    own = ML.inference(oof.withColumn("ens", sum(F.col(c) for c in base) / 3), base, {}, "ens")
    own = own.select("account_id", F.col("mule_prob").alias("ml_prob"), "risk_label", F.col("risk_tier").alias("model_tier"), "flag_count")
    d = own.join(iso, "account_id").join(lof, "account_id").join(ae, "account_id")
    return A.fuse(A.ensemble(d))


@register("predict_and_log")
def q_predict_and_log(spark, sf_dir):
    """Engineered features -> trained probability -> inference -> risk score -> summary -> one row an account in the prediction
    log. The batch is appended twice, as a retry would; the log holds each row once, with the schema of the entity."""
    from riskloom.operators import explain as X
    from riskloom.sources import tables as TB
    data, feats = training_set(spark, sf_dir)
    oof, _, _ = _oof(spark, sf_dir, prepared=(data, feats))
    inf = ML.inference(oof.withColumn("ens", F.col("prob_gbt")), ["prob_gbt"], {}, "ens").select("account_id", F.col("mule_prob").alias("ml_prob"))
    given = fx.given_scores(spark, sf_dir).select("account_id", "anomaly_score", "behavior_score", "alert_score")
    sc = scoring.score_components(scoring.scale_probability(inf.join(given, "account_id")))
    inputs = data.select(F.col("account_id").alias("a"), F.map_from_arrays(F.array(*map(F.lit, feats)), F.array(*[F.col(c).cast("double") for c in feats])).alias("input_features"))
    last = fx.transactions(spark, sf_dir).groupBy(F.col("account_id").alias("b")).agg(F.max("ts").alias("at"))
    told = X.narrative(sc).select(F.col("account_id").alias("c"), "narrative")
    rows = sc.join(inputs, F.col("account_id") == F.col("a")).join(last, F.col("account_id") == F.col("b"), "left").join(told, F.col("account_id") == F.col("c"))
    log = rows.select(F.sha2(F.concat_ws(":", F.col("account_id").cast("string"), F.lit("batch-1")), 256).alias("id"), F.col("account_id").cast("string").alias("account_id"),
                      "input_features", (F.col("ml_prob") / 100).alias("fraud_probability"), "anomaly_score", F.col("risk_score").alias("final_score"),
                      F.col("risk_category").alias("decision_recommendation"), F.col("narrative").alias("explanation_summary"), F.col("at").alias("timestamp"))
    root, log = f"{checkpoint_dir(spark)}/log-{uuid4().hex}", cut_lineage(log)
    for _ in range(2):
        TB.append_new(log, f"{root}/predictions", "id", "batch-1")
    return TB.read_entity(spark, root, "predictions")


@register("model_tree_attributions")
def q_model_tree_attributions(spark, sf_dir):
    """M18 (trees): path attribution of the boosted-tree margin per account, top 5
    features with signed value; bias + total = the model's raw margin."""
    data, feats = training_set(spark, sf_dir)
    gbt = ML.learners()["gbt"].fit(ML.assemble(data, feats))
    out = ML.tree_attributions(data, feats, gbt, "account_id", top_n=5)
    return out.withColumn("direction", F.when(F.col("value") >= 0, "positive").otherwise("negative"))
