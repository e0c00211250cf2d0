"""Registered queries: sources and sinks S1, S5-S9 (write to the shared folder,
read back with an explicit schema)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import models as ML
from riskloom.plans import q_alerts, q_explain
from riskloom.plans.registry import register
from riskloom.session import checkpoint_dir
from riskloom.sources import fixtures as fx
from riskloom.sources import tables as TB

CSV_SCHEMA = ("account_id LONG, acct_type STRING, nation STRING, acctbal DOUBLE, n_orders LONG, "
              "inflow DOUBLE, ev_count LONG, open_date STRING, label INT")


def _folder(spark, name: str) -> str:
    return checkpoint_dir(spark).rstrip("/") + f"/io/{name}-{uuid.uuid4().hex[:12]}"


@register("io_csv_roundtrip", """
SELECT account_id, acct_type, nation, acctbal, n_orders, inflow, ev_count, open_date, label FROM account_profile""")
def q_io_csv_roundtrip(spark, sf_dir):
    """S6 + S1: table sink as CSV with a header, scanned back with a declared schema
    (no inference pass)."""
    cols = [c.split()[0] for c in CSV_SCHEMA.split(", ")]
    path = _folder(spark, "csv")
    TB.write_table(fx.account_profile(spark, sf_dir).select(*cols), path, fmt="csv")
    return TB.read_csv(spark, path, CSV_SCHEMA)


@register("io_entity_accounts", """
SELECT CAST(account_id AS VARCHAR) AS account_id, risk_score, fraud_probability, anomaly_score,
  rules_score, category, status, CAST(coalesce(c.n, 0) AS INTEGER) AS alert_count, last_activity
FROM accounts a LEFT JOIN (SELECT account_id AS aid, count(*) AS n FROM alerts GROUP BY 1) c ON a.account_id = c.aid""",
          ("risk_score", "fraud_probability", "anomaly_score", "rules_score"), extra=q_alerts.EXTRA)
def q_io_entity_accounts(spark, sf_dir):
    """The accounts entity written with its declared schema (string ids, map
    profile, alert counts) and read back typed."""
    from riskloom.operators import alerts as AL
    a = AL.with_alert_counts(q_alerts.accounts(spark, sf_dir), q_alerts.alerts(spark, sf_dir))
    ent = a.select(F.col("account_id").cast("string").alias("account_id"),
                   F.create_map(F.lit("category"), F.col("category")).alias("profile_data"),
                   "risk_score", "fraud_probability", "anomaly_score", "rules_score",
                   F.col("category").alias("score_band"), "category", "status",
                   F.col("alert_count").cast("int").alias("alert_count"), "last_activity")
    root = _folder(spark, "entities")
    TB.append_log(ent, f"{root}/accounts")
    back = TB.read_entity(spark, root, "accounts")
    return back.select("account_id", "risk_score", "fraud_probability", "anomaly_score", "rules_score",
                       "category", "status", "alert_count", "last_activity")


@register("io_json_reports")
def q_io_json_reports(spark, sf_dir):
    """Nested JSON report sink (one object per account), read back."""
    rep = X.report_json(q_explain.scored(spark, sf_dir))
    path = _folder(spark, "json")
    TB.write_json_report(rep, path)
    return spark.read.schema("account_id LONG, report STRING").json(path)


@register("io_json_report_fields", q_explain._K17_SQL, q_explain._K17_DOUBLES, extra=q_explain._K17_EXTRA)
def q_io_json_report_fields(spark, sf_dir):
    """The same sink's reports, their fields parsed and compared."""
    return q_explain.report_fields(q_io_json_reports(spark, sf_dir))


@register("io_entity_explanations", """
SELECT CAST(s.account_id AS VARCHAR) AS account_id, n.narrative AS overall_summary, d.component AS top_feature, d.contribution AS top_value,
  a.reason_codes, 'scores-1' AS model_version FROM scored s JOIN k15 n ON s.account_id = n.account_id JOIN k10 d ON s.account_id = d.account_id AND d.rank = 1
LEFT JOIN alerts a ON s.account_id = a.account_id""", ("top_value",), extra={**q_alerts.EXTRA, **q_explain._K17_EXTRA})
def q_io_entity_explanations(spark, sf_dir):
    """The explanation log (top features, summary, reason codes, model version) appended in a batch, the batch run
    again and read back typed: each row once."""
    sc = q_explain.scored(spark, sf_dir)
    top = F.transform(X._sorted_desc(X._components(sc)), lambda c: F.struct(c["component"].alias("feature"), c["contribution"].alias("importance"), c["label"].alias("description")))
    codes = q_alerts.alerts(spark, sf_dir).select(F.col("account_id").alias("a"), "reason_codes", F.col("timestamp").alias("at"))
    log = (sc.select("account_id", top.alias("top_features")).join(X.narrative(sc), "account_id").join(codes, F.col("account_id") == F.col("a"), "left")
           .select(F.sha2(F.concat_ws(":", F.col("account_id").cast("string"), F.lit("scores-1")), 256).alias("id"), F.col("account_id").cast("string").alias("account_id"),
                   "top_features", F.col("narrative").alias("overall_summary"), "reason_codes", F.lit("scores-1").alias("model_version"), F.col("at").alias("timestamp")))
    root = _folder(spark, "entities")
    for _ in range(2):   # a retried batch adds nothing
        TB.append_new(log, f"{root}/explanation_logs", "id", "batch-1")
    back = TB.read_entity(spark, root, "explanation_logs")
    first = F.get("top_features", F.lit(0))
    return back.select("account_id", "overall_summary", first["feature"].alias("top_feature"), first["importance"].alias("top_value"),
                       F.array_join("reason_codes", " | ").alias("reason_codes"), "model_version")


@register("io_model_save_load")
def q_io_model_save_load(spark, sf_dir):
    """Fitted-state persistence — an MLlib model saved and re-loaded, scoring the
    same rows as the in-memory model (probability columns side by side)."""
    from pyspark.ml.classification import LogisticRegressionModel
    from riskloom.plans.q_models import training_set
    data, feats = training_set(spark, sf_dir)
    x = ML.assemble(data, feats)
    model = ML.learners()["lr"].fit(x)
    path = _folder(spark, "model")
    model.write().overwrite().save(path)
    loaded = LogisticRegressionModel.load(path)
    a = model.transform(x).select("account_id", ML.prob1().alias("p_fitted"))
    b = loaded.transform(x).select("account_id", ML.prob1().alias("p_loaded"))
    return a.join(b, "account_id")
