"""Registered queries: alerts (B6-B11), feature explanations (B1-B5, B22) and the
analyst serving queries (B12-B20) over entity tables derived from the driver data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import alerts as AL
from riskloom.operators import explain as X
from riskloom.operators import features as FE
from riskloom.operators import scoring, serving
from riskloom.plans import q_explain, q_features
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import union_all
from riskloom.sources import fixtures as fx
from riskloom.sources.tables import table

# ---- entity tables -----------------------------------------------------------------


def accounts(spark, sf_dir):
    """accounts entity: scores, category, status and last activity per account."""
    g = fx.given_scores(spark, sf_dir).drop("label").withColumn("fraud_probability", F.col("ml_prob"))
    s = scoring.score_components(scoring.scale_probability(g))
    last = table(spark, sf_dir, "events", "user_id", "ts").groupBy(F.col("user_id").alias("account_id")) \
        .agg(F.max("ts").alias("last_activity"))
    cat = F.col("risk_category")
    status = F.when(cat == "BLOCK", "FROZEN").when(cat == "REVIEW", "UNDER_REVIEW").otherwise("ACTIVE")
    return (s.select("account_id", "risk_score", cat.alias("category"), "fraud_probability", "anomaly_score",
                     F.col("alert_score").alias("rules_score"), status.alias("status"))
            .join(last, "account_id", "left"))


ACCOUNTS_SQL = """
SELECT s.account_id, s.risk_score, s.risk_category AS category, g.ml_prob AS fraud_probability, g.anomaly_score,
  g.alert_score AS rules_score,
  CASE s.risk_category WHEN 'BLOCK' THEN 'FROZEN' WHEN 'REVIEW' THEN 'UNDER_REVIEW' ELSE 'ACTIVE' END AS status,
  e.last_activity
FROM scored s JOIN given_scores g ON s.account_id = g.account_id
LEFT JOIN (SELECT user_id, max(ts) AS last_activity FROM events GROUP BY 1) e ON s.account_id = e.user_id
"""

SEV_SQL = """CASE WHEN risk_score >= 81 OR fraud_probability >= 0.85 THEN 'CRITICAL'
  WHEN risk_score >= 61 OR fraud_probability >= 0.65 THEN 'HIGH'
  WHEN risk_score >= 40 OR fraud_probability >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END"""
NEL_SQL = "(CAST(fraud_probability >= 0.60 AS INTEGER) + CAST(anomaly_score >= 60 AS INTEGER) + CAST(rules_score >= 60 AS INTEGER))"
TYPE_SQL = f"""CASE WHEN {NEL_SQL} >= 2 THEN 'CONVERGENT' WHEN fraud_probability >= 0.60 THEN 'MODEL_SCORE'
  WHEN anomaly_score >= 60 THEN 'ANOMALY' ELSE 'RULE' END"""


def sr(x: str, d: int) -> str:
    return q_explain.sround(x, d)


CODES_SQL = (f"array_to_string(list_filter([CASE WHEN {NEL_SQL} >= 2 THEN '{AL.REASON_CODES['convergent']}' END, "
             f"CASE WHEN fraud_probability >= 0.60 THEN '{AL.REASON_CODES['high_fraud_prob']}' END, "
             f"CASE WHEN anomaly_score >= 60 THEN '{AL.REASON_CODES['high_anomaly']}' END, "
             f"CASE WHEN rules_score >= 60 THEN '{AL.REASON_CODES['high_rules']}' END], lambda x: x IS NOT NULL), ' | ')")
PCT_SQL = f"printf('%.0f%%', {sr('fraud_probability * 100', 0)})"
DESC_SQL = f"""CASE WHEN alert_type = 'CONVERGENT' THEN printf('Convergent evidence from %d independent detection systems: %s. ',
      {NEL_SQL}, array_to_string(list_filter([
        CASE WHEN fraud_probability >= 0.60 THEN printf('ML fraud probability (%s)', {PCT_SQL}) END,
        CASE WHEN anomaly_score >= 60 THEN printf('anomaly score (%.0f/100)', {sr('anomaly_score', 0)}) END,
        CASE WHEN rules_score >= 60 THEN printf('rule engine score (%.0f/100)', {sr('rules_score', 0)}) END], lambda x: x IS NOT NULL), ', '))
  WHEN alert_type = 'MODEL_SCORE' THEN printf('ML ensemble model assigned a fraud probability of %s to this account. ', {PCT_SQL})
  WHEN alert_type = 'ANOMALY' THEN printf('Anomaly detection flagged this account with a score of %.0f/100, indicating significant deviation from normal behaviour. ', {sr('anomaly_score', 0)})
  ELSE printf('Rule-based policy engine triggered on this account (score: %.0f/100). ', {sr('rules_score', 0)}) END"""
ACTION_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AL.ACTIONS.items()) + " END"
ALERTS_SQL = f"""
SELECT substr(sha256(CAST(account_id AS VARCHAR) || ':' || alert_type || ':' || severity), 1, 16) AS alert_id,
  account_id, severity, alert_type, reason_codes, description, {ACTION_SQL} AS recommended_action,
  'OPEN' AS status, last_activity AS "timestamp", fraud_probability, anomaly_score, rules_score, risk_score
FROM (SELECT *, {DESC_SQL} AS description FROM (
  SELECT *, {SEV_SQL} AS severity, {TYPE_SQL} AS alert_type, {CODES_SQL} AS reason_codes FROM accounts) a) b
WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')
"""
EXTRA = {"scored": q_explain.SCORED_SQL, "accounts": ACCOUNTS_SQL, "alerts": ALERTS_SQL}


def alerts(spark, sf_dir):
    return AL.generate_alerts(accounts(spark, sf_dir))


# ---- B6-B11 ------------------------------------------------------------------------

@register("alerts_severity_type", f"SELECT account_id, {SEV_SQL} AS severity, {TYPE_SQL} AS alert_type FROM accounts",
          extra=EXTRA)
def q_alerts_severity_type(spark, sf_dir):
    """Alert severity and trigger type for every account."""
    a = accounts(spark, sf_dir)
    p, an, r, s = F.col("fraud_probability"), F.col("anomaly_score"), F.col("rules_score"), F.col("risk_score")
    return a.select("account_id", AL.severity(s, p).alias("severity"), AL.alert_type(p, an, r).alias("alert_type"))


@register("alerts_generate", """SELECT alert_id, account_id, severity, alert_type, reason_codes, description,
  recommended_action, status, "timestamp" FROM alerts""", extra=EXTRA)
def q_alerts_generate(spark, sf_dir):
    """Generated alerts (reason codes, description, action, deterministic id)."""
    return alerts(spark, sf_dir).select(
        "alert_id", "account_id", "severity", "alert_type",
        F.array_join("reason_codes", " | ").alias("reason_codes"), "description", "recommended_action", "status",
        "timestamp")


def _factors_sql() -> str:
    parts = [
        f"SELECT alert_id, 0 AS ord, 'ML Fraud Probability' AS factor, printf('%.1f%%', {sr('fraud_probability * 100', 1)}) AS value, "
        f"{sr('fraud_probability', 3)} AS weight FROM alerts WHERE fraud_probability > 0",
        f"SELECT alert_id, 1, 'Anomaly Detection Score', printf('%.1f/100', {sr('anomaly_score', 1)}), "
        f"{sr('anomaly_score / 100', 3)} FROM alerts WHERE anomaly_score > 0",
        f"SELECT alert_id, 2, 'Rule-Based Alert Score', printf('%.1f/100', {sr('rules_score', 1)}), "
        f"{sr('rules_score / 100', 3)} FROM alerts WHERE rules_score > 0",
        f"SELECT alert_id, 3, 'Composite Risk Score', printf('%.1f/100', {sr('risk_score', 1)}), "
        f"{sr('risk_score / 100', 3)} FROM alerts"]
    return (f"SELECT alert_id, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY weight DESC, ord) AS INTEGER) AS rank, "
            f"factor, value, weight FROM ({union_all(parts)}) t")


@register("alerts_factors", _factors_sql(), ("weight",), extra=EXTRA)
def q_alerts_factors(spark, sf_dir):
    """Contributing factors per alert, by weight desc."""
    x = alerts(spark, sf_dir).select("alert_id", F.posexplode("contributing_factors").alias("pos", "f"))
    return x.select("alert_id", (F.col("pos") + 1).alias("rank"), "f.factor", "f.value", "f.weight")


@register("alerts_account_counts", """SELECT a.account_id, CAST(coalesce(c.n, 0) AS INTEGER) AS alert_count
FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS n FROM alerts GROUP BY 1) c ON a.account_id = c.account_id""",
          extra=EXTRA)
def q_alerts_account_counts(spark, sf_dir):
    """alert_count per account after generation (keyed left join)."""
    return AL.with_alert_counts(accounts(spark, sf_dir), alerts(spark, sf_dir)).select("account_id", "alert_count")


# ---- B12-B20 serving -----------------------------------------------------------------

@register("serving_account_search", """
SELECT account_id, risk_score, category, status, total FROM (
  SELECT *, count(*) OVER () AS total FROM accounts
  WHERE CAST(account_id AS VARCHAR) ILIKE '%1%' AND status = 'ACTIVE' AND risk_score >= 20.0 AND risk_score <= 80.0) f
ORDER BY risk_score DESC, account_id LIMIT 20 OFFSET 20""", ("risk_score",), extra=EXTRA)
def q_serving_account_search(spark, sf_dir):
    """Search (ilike), status and score-range filters, sort, page 2 of 20, total count."""
    return serving.search_accounts(accounts(spark, sf_dir), search="1", status="ACTIVE", risk_min=20.0, risk_max=80.0, page=2).select(
        "account_id", "risk_score", "category", "status", "total")


@register("serving_account_search_by_activity", """
SELECT account_id, risk_score, category, status, total FROM (
  SELECT *, count(*) OVER () AS total FROM accounts WHERE risk_score >= 0 AND risk_score <= 100) f
ORDER BY last_activity ASC NULLS LAST, account_id LIMIT 10 OFFSET 0""", ("risk_score",), extra=EXTRA)
def q_serving_account_search_by_activity(spark, sf_dir):
    """No filter, longest inactive first, page 1 of 10."""
    return serving.search_accounts(accounts(spark, sf_dir), sort_by="last_activity", descending=False, page_size=10).select(
        "account_id", "risk_score", "category", "status", "total")


def predictions(spark, sf_dir):
    """prediction log derived from purchase events (one prediction per request)."""
    t = fx.transactions(spark, sf_dir).filter(F.col("type") == "purchase")
    return t.select(F.col("transaction_id").alias("prediction_id"), "account_id",
                    F.least(F.col("amount") / 5, F.lit(100.0)).alias("final_score"), F.col("ts").alias("timestamp"))


@register("serving_account_detail", """
SELECT a.account_id, a.category, a.risk_score, p.prediction_id AS latest_prediction_id,
  p.final_score AS latest_final_score, p.ts AS latest_timestamp
FROM accounts a LEFT JOIN (
  SELECT account_id, arg_max(transaction_id, (ts, transaction_id)) AS prediction_id,
         arg_max(least(amount / 5, 100.0), (ts, transaction_id)) AS final_score, max(ts) AS ts
  FROM transactions WHERE type = 'purchase' GROUP BY account_id) p ON a.account_id = p.account_id""",
          ("risk_score", "latest_final_score"), extra=EXTRA)
def q_serving_account_detail(spark, sf_dir):
    """Account detail with its latest prediction (max_by on timestamp, id tie-break)."""
    p = predictions(spark, sf_dir)
    key = F.struct("timestamp", "prediction_id")
    latest = p.groupBy("account_id").agg(
        F.max_by("prediction_id", key).alias("latest_prediction_id"),
        F.max_by("final_score", key).alias("latest_final_score"), F.max("timestamp").alias("latest_timestamp"))
    return accounts(spark, sf_dir).select("account_id", "category", "risk_score").join(latest, "account_id", "left")


@register("serving_transactions_account", """
SELECT transaction_id, account_id, amount, type, ts, count(*) OVER () AS total FROM transactions WHERE account_id = 7
ORDER BY ts DESC, transaction_id DESC LIMIT 50""")
def q_serving_transactions_account(spark, sf_dir):
    """One account's transactions, newest first, first page of 50."""
    return serving.account_transactions(fx.transactions(spark, sf_dir), 7).select("transaction_id", "account_id", "amount", "type", "ts", "total")


@register("serving_transactions_all", """
SELECT transaction_id, account_id, amount, type, ts, count(*) OVER () AS total FROM transactions
ORDER BY ts DESC, transaction_id DESC LIMIT 50 OFFSET 100""")
def q_serving_transactions_all(spark, sf_dir):
    """ALL accounts, newest first, page 3 of 50 (top-k with offset)."""
    return serving.account_transactions(fx.transactions(spark, sf_dir), "ALL", page=3).select("transaction_id", "account_id", "amount", "type", "ts", "total")


@register("serving_risk_summary", """
SELECT account_id, risk_score, fraud_probability, anomaly_score, rules_score, category AS score_band,
  CASE WHEN risk_score > 60 THEN 'pass-through, velocity, new-account' ELSE 'safe' END AS risk_tags,
  CASE WHEN risk_score >= 81 THEN 'Immediate block recommended' WHEN risk_score >= 61 THEN 'Review required'
       ELSE 'No action' END AS decision_recommendation
FROM accounts""", ("risk_score", "fraud_probability", "anomaly_score", "rules_score"), extra=EXTRA)
def q_serving_risk_summary(spark, sf_dir):
    """Risk summary with tags (> 60) and recommendation (>= 81 / >= 61)."""
    a = accounts(spark, sf_dir)
    s = F.col("risk_score")
    return a.select("account_id", "risk_score", "fraud_probability", "anomaly_score", "rules_score",
                    F.col("category").alias("score_band"),
                    F.when(s > 60, "pass-through, velocity, new-account").otherwise("safe").alias("risk_tags"),
                    F.when(s >= 81, "Immediate block recommended").when(s >= 61, "Review required")
                    .otherwise("No action").alias("decision_recommendation"))


def _alert_list_sql(where: str, size: int, offset: int) -> str:
    return f"""
SELECT alert_id, account_id, severity, alert_type, status, "timestamp", total FROM (
  SELECT * REPLACE (coalesce(status, 'OPEN') AS status), count(*) OVER () AS total FROM alerts WHERE {where}) f
ORDER BY "timestamp" DESC NULLS LAST, alert_id LIMIT {size} OFFSET {offset}"""


_ALERT_COLS = ("alert_id", "account_id", "severity", "alert_type", "status", "timestamp", "total")


@register("serving_alert_list", _alert_list_sql("severity = 'CRITICAL' AND coalesce(status, 'OPEN') = 'OPEN' AND CAST(account_id AS VARCHAR) ILIKE '%2%'", 25, 0),
          extra=EXTRA)
def q_serving_alert_list(spark, sf_dir):
    """Critical open alerts of accounts with a 2, newest first, first page of 25."""
    return serving.list_alerts(alerts(spark, sf_dir), severity="critical", status="open", search="2", page_size=25).select(*_ALERT_COLS)


@register("serving_alert_list_by_type", _alert_list_sql("alert_type = 'CONVERGENT' AND account_id = 9", 10, 0), extra=EXTRA)
def q_serving_alert_list_by_type(spark, sf_dir):
    """One account's convergent alerts."""
    return serving.list_alerts(alerts(spark, sf_dir), alert_type="convergent", account_id=9, page_size=10).select(*_ALERT_COLS)


@register("serving_alert_list_page", _alert_list_sql("alert_type = 'RULE'", 50, 50), extra=EXTRA)
def q_serving_alert_list_page(spark, sf_dir):
    """Rule alerts, page 2 of 50."""
    return serving.list_alerts(alerts(spark, sf_dir), alert_type="RULE", page=2).select(*_ALERT_COLS)


def status_events(spark, sf_dir):
    """Analyst actions on alerts as an event log (derived deterministically from the alert)."""
    a = alerts(spark, sf_dir).select("alert_id", "account_id", "timestamp")
    k = F.pmod(F.col("account_id"), F.lit(4))
    ev = F.array(
        F.struct(F.lit("ACKNOWLEDGED").alias("status"), (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("changed_at"),
                 (k >= 1).alias("ok")),
        F.struct(F.lit("ESCALATED").alias("status"), (F.col("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("changed_at"),
                 (k == 2).alias("ok")),
        F.struct(F.lit("RESOLVED").alias("status"), (F.col("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("changed_at"),
                 (k == 3).alias("ok")))
    x = a.filter(F.col("timestamp").isNotNull()).select("alert_id", F.explode(ev).alias("e"))
    return x.filter("e.ok").select("alert_id", "e.status", "e.changed_at")


_EVENTS_SQL = """
SELECT alert_id, 'ACKNOWLEDGED' AS status, "timestamp" + INTERVAL 1 HOUR AS changed_at FROM alerts WHERE "timestamp" IS NOT NULL AND account_id % 4 >= 1
UNION ALL SELECT alert_id, 'ESCALATED', "timestamp" + INTERVAL 2 HOUR FROM alerts WHERE "timestamp" IS NOT NULL AND account_id % 4 = 2
UNION ALL SELECT alert_id, 'RESOLVED', "timestamp" + INTERVAL 3 HOUR FROM alerts WHERE "timestamp" IS NOT NULL AND account_id % 4 = 3"""


@register("serving_alert_transitions", """
SELECT a.alert_id, coalesce(s.status, 'OPEN') AS status, s.acknowledged_at, s.escalated_at, s.resolved_at
FROM alerts a LEFT JOIN (
  SELECT alert_id, arg_max(status, changed_at) AS status,
    max(CASE WHEN status = 'ACKNOWLEDGED' THEN changed_at END) AS acknowledged_at,
    max(CASE WHEN status = 'ESCALATED' THEN changed_at END) AS escalated_at,
    max(CASE WHEN status = 'RESOLVED' THEN changed_at END) AS resolved_at
  FROM status_events GROUP BY alert_id) s ON a.alert_id = s.alert_id""", extra={**EXTRA, "status_events": _EVENTS_SQL})
def q_serving_alert_transitions(spark, sf_dir):
    """Latest status per alert with the audit timestamp of each transition (pivot)."""
    ev = status_events(spark, sf_dir)
    st = ev.groupBy("alert_id").agg(
        F.max_by("status", "changed_at").alias("status"),
        F.max(F.when(F.col("status") == "ACKNOWLEDGED", F.col("changed_at"))).alias("acknowledged_at"),
        F.max(F.when(F.col("status") == "ESCALATED", F.col("changed_at"))).alias("escalated_at"),
        F.max(F.when(F.col("status") == "RESOLVED", F.col("changed_at"))).alias("resolved_at"))
    a = alerts(spark, sf_dir).select("alert_id")
    return (a.join(st, "alert_id", "left")
            .select("alert_id", F.coalesce("status", F.lit("OPEN")).alias("status"), "acknowledged_at",
                    "escalated_at", "resolved_at"))


@register("serving_dashboard", """
SELECT (SELECT count(*) FROM transactions) AS total_transactions,
  count(*) FILTER (WHERE risk_score >= 60) AS suspicious_accounts,
  (SELECT count(*) FROM alerts WHERE severity IN ('CRITICAL', 'HIGH') AND status = 'OPEN') AS high_risk_alerts,
  count(*) FILTER (WHERE fraud_probability < 0.1) AS bin_0_10,
  count(*) FILTER (WHERE fraud_probability >= 0.1 AND fraud_probability < 0.3) AS bin_10_30,
  count(*) FILTER (WHERE fraud_probability >= 0.3 AND fraud_probability < 0.6) AS bin_30_60,
  count(*) FILTER (WHERE fraud_probability >= 0.6 AND fraud_probability < 0.8) AS bin_60_80,
  count(*) FILTER (WHERE fraud_probability >= 0.8) AS bin_80_100
FROM accounts""", extra=EXTRA)
def q_serving_dashboard(spark, sf_dir):
    """Dashboard counters in one conditional aggregate per table (the reference issues 9 queries)."""
    a = accounts(spark, sf_dir)
    p = F.col("fraud_probability")
    acc = a.agg(F.count_if(F.col("risk_score") >= 60).alias("suspicious_accounts"),
                F.count_if(p < 0.1).alias("bin_0_10"), F.count_if((p >= 0.1) & (p < 0.3)).alias("bin_10_30"),
                F.count_if((p >= 0.3) & (p < 0.6)).alias("bin_30_60"), F.count_if((p >= 0.6) & (p < 0.8)).alias("bin_60_80"),
                F.count_if(p >= 0.8).alias("bin_80_100"))
    al = alerts(spark, sf_dir).agg(F.count_if(F.col("severity").isin("CRITICAL", "HIGH") & (F.col("status") == "OPEN"))
                                   .alias("high_risk_alerts"))
    tx = table(spark, sf_dir, "events", "event_id").agg(F.count(F.lit(1)).alias("total_transactions"))
    return tx.join(acc, how="inner").join(al, how="inner").select(
        "total_transactions", "suspicious_accounts", "high_risk_alerts", "bin_0_10", "bin_10_30", "bin_30_60",
        "bin_60_80", "bin_80_100")


@register("serving_dashboard_top_cases", """
SELECT a.account_id, risk_score, category, status, fraud_probability, strftime(last_activity, '%Y-%m-%d %H:%M') AS last_activity,
  coalesce(c.n, 0) AS alert_count
FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS n FROM alerts GROUP BY 1) c ON a.account_id = c.account_id
WHERE risk_score >= 60 ORDER BY risk_score DESC, a.account_id LIMIT 5""", ("risk_score",), extra=EXTRA)
def q_serving_dashboard_top_cases(spark, sf_dir):
    """The five highest-risk cases with their alerts (a top-k report)."""
    return serving.top_cases(accounts(spark, sf_dir), alerts(spark, sf_dir)).select(
        "account_id", "risk_score", "category", "status", "fraud_probability",
        F.date_format("last_activity", "yyyy-MM-dd HH:mm").alias("last_activity"), "alert_count")


@register("serving_daily_trend", """
SELECT CAST(date_trunc('day', "timestamp") AS DATE) AS day, count(*) AS flag_count FROM alerts
WHERE "timestamp" IS NOT NULL GROUP BY 1""", extra=EXTRA)
def q_serving_daily_trend(spark, sf_dir):
    """Daily count of flagged accounts (alerts per day) — hard-coded in the reference."""
    a = alerts(spark, sf_dir).filter(F.col("timestamp").isNotNull())
    return a.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("flag_count"))


@register("serving_alert_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE a.severity = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE coalesce(s.status, 'OPEN') = 'OPEN') AS open,
  count(*) FILTER (WHERE coalesce(s.status, 'OPEN') = 'ESCALATED') AS escalated
FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(status, changed_at) AS status FROM status_events GROUP BY 1) s
  ON a.alert_id = s.alert_id""", extra={**EXTRA, "status_events": _EVENTS_SQL})
def q_serving_alert_stats(spark, sf_dir):
    """Alert counters (total / critical / open / escalated) after transitions."""
    st = status_events(spark, sf_dir).groupBy("alert_id").agg(F.max_by("status", "changed_at").alias("cur"))
    a = alerts(spark, sf_dir).join(st, "alert_id", "left").withColumn("cur", F.coalesce("cur", F.lit("OPEN")))
    return a.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
                 F.count_if(F.col("cur") == "OPEN").alias("open"), F.count_if(F.col("cur") == "ESCALATED").alias("escalated"))


# each account's drivers: how far its numbers lie from the mean of all accounts, in standard deviations
_DRIVER_COLS = ("acctbal", "n_orders", "total_price", "n_lines", "inflow", "outflow", "ev_count", "ev_value_sum")
_DEVIATIONS = "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _DRIVER_COLS) + """ FROM account_profile)
SELECT account_id, feature, value FROM (""" + " UNION ALL ".join(
    f"SELECT account_id, '{c}' AS feature, round(({c} - {c}_m) / {c}_s, 6) AS value FROM account_profile, m" for c in _DRIVER_COLS) + """) x
WHERE value IS NOT NULL"""


def deviations(spark, sf_dir):
    """(account_id, feature, value): long table of a fixed number of rows per account."""
    p = fx.account_profile(spark, sf_dir)
    m = p.agg(*[F.avg(c).alias(f"{c}_m") for c in _DRIVER_COLS], *[F.stddev_pop(c).alias(f"{c}_s") for c in _DRIVER_COLS])
    z = [F.round((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s"), 6).alias(c) for c in _DRIVER_COLS]
    x = p.join(F.broadcast(m), how="inner").select("account_id", *z)
    return x.unpivot(["account_id"], list(_DRIVER_COLS), "feature", "value").where("value is not null")


@register("serving_driver_split", """
SELECT account_id, side, CAST(row_number() OVER (PARTITION BY account_id, side ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank, feature, value,
  abs(value) / greatest(max(abs(value)) OVER (PARTITION BY account_id, side), 0.001) AS bar_share
FROM (SELECT *, CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END AS side FROM dev) d""", ("value", "bar_share"), extra={"dev": _DEVIATIONS})
def q_serving_driver_split(spark, sf_dir):
    """Per-account positive and negative drivers with bar share = |value| / max(|values|, .001) of their side."""
    return serving.split_drivers(deviations(spark, sf_dir), "account_id", "value", "feature")


@register("serving_component_split", f"""
SELECT account_id, 'positive' AS side, rank, component, contribution, contribution / greatest(max(contribution) OVER (PARTITION BY account_id), 0.001)
  AS bar_share FROM (SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY contribution DESC, component) AS INTEGER) AS rank
                     FROM (SELECT account_id, component, contribution FROM ({q_explain._K10}) k0) k1) k""",
          ("contribution", "bar_share"), extra={"scored": q_explain.SCORED_SQL})
def q_serving_component_split(spark, sf_dir):
    """B22 on the four score components, none of which is negative."""
    return serving.split_drivers(X.component_explanation(q_explain.scored(spark, sf_dir)), "account_id", "contribution", "component")


_HIT = lambda words: " OR ".join(f"contains(lower(feature), '{w}')" for w in words)
_DRIVER_ALERTS = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(value) DESC, feature) AS n FROM dev),
d AS (SELECT account_id, count(*) AS size, string_agg(feature, '; ' ORDER BY n) FILTER (WHERE n <= 3) AS told""" + "".join(
    f", bool_or({_HIT(words)}) FILTER (WHERE n <= 5) AS {code}" for words, code in AL.DRIVER_CODES) + """ FROM r GROUP BY 1)
SELECT a.alert_id, a.account_id, a.reason_codes""" + "".join(
    f" || CASE WHEN coalesce(d.{code}, false) THEN CASE WHEN a.reason_codes = '' THEN '' ELSE ' | ' END || '{AL.REASON_CODES[code]}' ELSE '' END"
    for _, code in AL.DRIVER_CODES) + """ AS reason_codes,
  a.description || CASE WHEN coalesce(d.size, 0) >= 2 THEN 'Primary drivers: ' || d.told || '.' ELSE '' END AS description
FROM alerts a LEFT JOIN d ON a.account_id = d.account_id"""


@register("alerts_with_drivers", "SELECT * FROM driver_alerts", extra={**EXTRA, "dev": _DEVIATIONS, "driver_alerts": _DRIVER_ALERTS})
def q_alerts_with_drivers(spark, sf_dir):
    """B8 + B10 with each account's own drivers: codes from their names, the three strongest in the text."""
    own = F.sort_array(F.collect_list(F.struct((-F.abs("value")).alias("o"), "feature", "value")))   # a fixed number per account
    drivers = deviations(spark, sf_dir).groupBy("account_id").agg(own.alias("d")).select("account_id", F.transform("d", lambda x: F.struct(
        x["feature"].alias("feature"), x["value"].alias("importance"), F.lit(None).cast("string").alias("description"))).alias("drivers"))
    a = accounts(spark, sf_dir).join(drivers, "account_id", "left")
    a = a.withColumn("drivers", F.coalesce("drivers", F.array().cast("array<struct<feature:string,importance:double,description:string>>")))
    return AL.generate_alerts(a, drivers="drivers").select("alert_id", "account_id", F.array_join("reason_codes", " | ").alias("reason_codes"), "description")


# ---- B1-B5 feature explanations over engineered features -------------------------------
EXPL_FEATS = q_features.F5_COLS + ["out_outlier_rate", "out_max_zscore", "out_total_flag_count"] + \
    ["beh_flow_imbalance", "beh_positive_sum", "beh_negative_sum", "beh_net_flow", "beh_entropy",
     "beh_high_activity", "beh_row_skew", "beh_row_mean", "beh_distinct_values"]


def feature_importance(spark, sf_dir):
    """Signed correlation of each engineered feature with the label (global importance)."""
    df = q_features.feature_input(spark, sf_dir)
    for st in (FE.RatioFeatures(q_features.NUM, 200), FE.OutlierFeatures(q_features.NUM, 100),
               FE.BehaviourFeatures(q_features.NUM, 300, acct_col="acct_type")):
        df = st.fit(df).transform(df)
    y = F.col("label").cast("double")
    row = df.agg(*[F.try_divide(F.covar_pop(F.col(c).cast("double"), y),
                                F.stddev_pop(F.col(c).cast("double")) * F.stddev_pop(y)).alias(c) for c in EXPL_FEATS])
    parts = ", ".join(f"'{c}', `{c}`" for c in EXPL_FEATS)
    long = row.selectExpr(f"stack({len(EXPL_FEATS)}, {parts}) AS (feature, importance)")
    return long.withColumn("direction", F.when(F.col("importance") >= 0, "positive").otherwise("negative"))


def _importance_sql() -> str:
    return union_all([f"SELECT '{c}' AS feature, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) * stddev_pop(CAST(label AS DOUBLE)) = 0 "
                      f"THEN NULL ELSE covar_pop(CAST({c} AS DOUBLE), CAST(label AS DOUBLE)) / (stddev_pop(CAST({c} AS DOUBLE)) * "
                      f"stddev_pop(CAST(label AS DOUBLE))) END AS importance FROM ef" for c in EXPL_FEATS])


_EF = ("SELECT p.account_id, p.label, r.*, o.*, b.* FROM feature_input p JOIN f5 r ON p.account_id = r.account_id "
       "JOIN f7 o ON p.account_id = o.account_id JOIN f8 b ON p.account_id = b.account_id")


def _f5_body() -> str:
    return f"""SELECT account_id,
  sd0 / (abs(mean) + 1e-9) AS ratio_numeric_cv, mx / (abs(med) + 1e-9) AS ratio_top_to_median,
  ({len(q_features.NUM)} - coalesce(nzero, 0)) / ({float(len(q_features.NUM))} + 1e-9) AS ratio_nonzero_fraction,
  coalesce(npos, 0) / (coalesce(nneg, 0) + 1e-9) AS ratio_pos_to_neg, (mx - mn) / (abs(mean) + 1e-9) AS ratio_extreme_range
FROM rowstats"""


def _desc_case(col: str) -> str:
    """B1 in SQL: exact key, else the first key (dictionary order) contained either way, else a title."""
    esc = {k: v.replace("'", "''") for k, v in AL.FEATURE_DESCRIPTIONS.items()}
    exact = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in esc.items())
    part = " ".join(f"WHEN contains({col}, '{k}') OR contains('{k}', {col}) THEN '{v}'" for k, v in esc.items())
    return (f"CASE {exact} {part} ELSE 'Engineered signal: ' || "
            f"array_to_string(list_transform(string_split(replace({col}, '_', ' '), ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ') END")


_IMP_EXTRA = {**q_features.EXTRA, "long": q_features._LONG, "rowstats": q_features._ROWSTATS,
              "ent": q_features._ENT, "f5": _f5_body(), "f7": q_features._f7_sql(), "f8": q_features._F8_SQL,
              "ef": _EF, "imp": _importance_sql()}


@register("explain_feature_importance", f"""
SELECT feature, importance, direction, description,
  description || ' — this ' || CASE WHEN abs(importance) > 0.15 THEN 'significantly' WHEN abs(importance) > 0.05 THEN 'moderately'
    ELSE 'slightly' END || ' ' || CASE WHEN direction = 'positive' THEN 'increases' ELSE 'reduces' END
    || ' the fraud risk score.' AS explanation,
  round(abs(importance), 4) AS magnitude, round(abs(importance) / sum(abs(importance)) OVER () * 100, 1) AS percent,
  CAST(row_number() OVER (ORDER BY round(abs(importance), 9) DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, importance, CASE WHEN importance >= 0 THEN 'positive' ELSE 'negative' END AS direction,
             {_desc_case('feature')} AS description
      FROM imp WHERE importance IS NOT NULL ORDER BY round(abs(importance), 9) DESC, feature LIMIT 10) t""",
          ("importance", "magnitude", "percent"), extra=_IMP_EXTRA)
def q_explain_feature_importance(spark, sf_dir):
    """Top-10 features by |importance| with magnitude, percentage, description lookup and sentence."""
    imp = feature_importance(spark, sf_dir).filter(F.col("importance").isNotNull())
    top = AL.top_importance(imp, 10)
    d = AL.describe_features(top)
    return d.select("feature", "importance", "direction", "description",
                    AL.explanation_sentence(F.col("description"), F.col("importance"), F.col("direction")).alias("explanation"),
                    "magnitude", "percent", "rank")


def _b45_sql() -> str:
    pat = " || ".join(
        f"CASE WHEN bool_or({' OR '.join(f'contains(lower(feature), {k!r})' for k in keys)}) FILTER (WHERE rank <= 5) "
        f"THEN '{p}' || ', ' ELSE '' END" for keys, p in AL.NARRATIVE_PATTERNS)
    codes = " || ".join(
        f"CASE WHEN bool_or({' OR '.join(f'contains(lower(feature), {k!r})' for k in keys)}) FILTER (WHERE rank <= 5) "
        f"THEN '{c}' || ' | ' ELSE '' END" for keys, c in AL.FEATURE_REASON_RULES)
    return f"""
SELECT a.account_id,
  CASE WHEN g.codes = '' THEN '{AL.DEFAULT_REASON}' ELSE left(g.codes, length(g.codes) - 3) END AS reason_codes,
  CASE WHEN g.pos IS NULL THEN printf('The model assigned a fraud probability of %.0f%% and composite risk score of %.0f/100 to this account. Insufficient feature data to generate detailed narrative.', {sr('a.fraud_probability * 100', 0)}, {sr('a.risk_score', 0)})
       ELSE printf('This account received a composite risk score of %.0f/100 and a fraud probability of %.0f%%. ', {sr('a.risk_score', 0)}, {sr('a.fraud_probability * 100', 0)})
            || 'The primary risk drivers are: ' || g.pos || '. '
            || CASE WHEN g.neg IS NULL THEN '' ELSE 'Mitigating factors include: ' || g.neg || '. ' END
            || CASE WHEN g.pats = '' THEN '' ELSE 'Detected patterns consistent with: ' || left(g.pats, length(g.pats) - 2) || '.' END
  END AS narrative,
  printf('Fraud probability %.0f%% — driven by %s.', {sr('a.fraud_probability * 100', 0)}, g.first_desc) AS summary
FROM accounts a, (
  SELECT string_agg(description, '; ' ORDER BY rank) FILTER (WHERE direction = 'positive' AND drank <= 3) AS pos,
         string_agg(description, '; ' ORDER BY rank) FILTER (WHERE direction = 'negative' AND drank <= 2) AS neg,
         {pat} AS pats, {codes} AS codes,
         lower(max(description) FILTER (WHERE rank = 1)) AS first_desc
  FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY rank) AS drank FROM top8) t) g"""


_TOP8 = f"""SELECT feature, importance, direction, {_desc_case('feature')} AS description, rank FROM (
  SELECT feature, importance, CASE WHEN importance >= 0 THEN 'positive' ELSE 'negative' END AS direction,
         row_number() OVER (ORDER BY round(abs(importance), 9) DESC, feature) AS rank
  FROM imp WHERE importance IS NOT NULL) x WHERE rank <= 8"""


@register("explain_account_narrative", _b45_sql(), extra={**EXTRA, **_IMP_EXTRA, "top8": _TOP8})
def q_explain_account_narrative(spark, sf_dir):
    """B4 + B5: reason codes from the top-5 feature names and the per-account narrative
    (top 3 risk drivers, top 2 mitigating factors, detected patterns, summary)."""
    imp = feature_importance(spark, sf_dir).filter(F.col("importance").isNotNull())
    top = AL.describe_features(AL.top_importance(imp, 8))
    one = F.sort_array(F.collect_list(F.struct("rank", "feature", "importance", "direction", "description")))   # <= 8 rows
    drivers = top.agg(F.transform(one, lambda x: x.dropFields("rank")).alias("drivers"))
    return AL.account_narratives(accounts(spark, sf_dir).join(F.broadcast(drivers), how="inner"))
