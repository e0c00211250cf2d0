"""Registered queries: velocity V1-V5 (batch) and the streaming jobs V4, V6, V7
(each checked against the batch SQL of the same result)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import velocity as V
from riskloom.plans import q_alerts as QA
from riskloom.plans.registry import register
from riskloom.sources import fixtures as fx
from riskloom.streaming import jobs


def _tx(spark, sf_dir):
    return fx.transactions(spark, sf_dir)


def _range(name: str, secs: int) -> str:
    return (f"count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL {secs} SECOND PRECEDING "
            f"AND CURRENT ROW) AS cnt_{name}, sum(amount) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN "
            f"INTERVAL {secs} SECOND PRECEDING AND CURRENT ROW) AS sum_{name}")


@register("velocity_trailing", "SELECT account_id, transaction_id, ts, amount, "
          + ", ".join(_range(n, s) for n, s in V.WINDOWS.items()) + " FROM transactions",
          [f"sum_{n}" for n in V.WINDOWS])
def q_velocity_trailing(spark, sf_dir):
    """V1: trailing 24h / 7d / 30d count and amount per transaction."""
    return V.velocity_features(_tx(spark, sf_dir))


# amounts are multiples of 1024, as 1e17 is, so that sums are exact in any order
_ODD = """SELECT transaction_id, CASE WHEN transaction_id % 3 = 0 THEN NULL WHEN transaction_id % 3 = 1 THEN '7' ELSE CAST(account_id AS VARCHAR) END AS account_id,
  CASE WHEN transaction_id % 31 = 0 THEN NULL WHEN transaction_id % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts,
  CASE WHEN transaction_id % 7 = 0 THEN NULL WHEN transaction_id % 997 = 0 THEN 1e17 ELSE 1024.0 * floor(amount) END AS amount FROM transactions"""


@register("velocity_trailing_odd", "SELECT account_id, transaction_id, ts, amount, "
          + ", ".join(_range(n, s) for n, s in V.WINDOWS.items()) + f" FROM ({_ODD}) o")
def q_velocity_trailing_odd(spark, sf_dir):
    """V1 over odd rows: NaN, NULL and 1e17 amounts, a third of all events without an account, a third on one account,
    events without a time, many at the same instant."""
    k, amount = F.col("transaction_id"), F.col("amount")
    odd = F.when(k % 14 == 0, float("nan")).when(k % 7 == 0, None).when(k % 997 == 0, 1e17).otherwise(F.floor(amount) * 1024.0)
    ts = F.when(k % 31 == 0, None).when(k % 2 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    tx = _tx(spark, sf_dir).select("transaction_id", F.when(k % 3 == 0, None).when(k % 3 == 1, "7").otherwise(F.col("account_id").cast("string")).alias("account_id"),
                                   ts.alias("ts"), odd.alias("amount"))
    return V.velocity_features(tx)


@register("velocity_in_out", """
SELECT account_id, date_trunc('day', ts) AS window_start,
  sum(CASE WHEN type = 'purchase' THEN amount ELSE 0.0 END) AS inflow,
  sum(CASE WHEN type <> 'purchase' THEN amount ELSE 0.0 END) AS outflow,
  CASE WHEN sum(CASE WHEN type = 'purchase' THEN amount ELSE 0.0 END) = 0 THEN NULL
       ELSE sum(CASE WHEN type <> 'purchase' THEN amount ELSE 0.0 END) / sum(CASE WHEN type = 'purchase' THEN amount ELSE 0.0 END)
  END AS out_in_ratio
FROM transactions GROUP BY 1, 2""", ("inflow", "outflow", "out_in_ratio"))
def q_velocity_in_out(spark, sf_dir):
    """V2: daily inflow / outflow per account and their ratio."""
    return V.in_out_ratio(_tx(spark, sf_dir))


@register("velocity_first_activity", """
SELECT p.account_id, p.first_order, f.first_tx, CAST(CAST(f.first_tx AS DATE) - CAST(p.first_order AS DATE) AS INTEGER) AS delay_days
FROM account_profile p JOIN (SELECT account_id, min(ts) AS first_tx FROM transactions GROUP BY 1) f
  ON p.account_id = f.account_id""")
def q_velocity_first_activity(spark, sf_dir):
    """V3: days from account creation (first order) to first transaction."""
    return V.first_activity_delay(fx.account_profile(spark, sf_dir), _tx(spark, sf_dir))


_V4_SQL = """SELECT date_trunc('day', ts) AS window_start, type, count(*) AS n_events, sum(amount) AS total_amount
FROM transactions GROUP BY 1, 2"""


@register("velocity_tumbling", _V4_SQL, ("total_amount",))
def q_velocity_tumbling(spark, sf_dir):
    """V4 batch twin: daily counts per event type."""
    return V.tumbling_counts(_tx(spark, sf_dir))


@register("velocity_sessions", """
SELECT account_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events,
  sum(amount) AS total_amount
FROM (SELECT *, sum(new_s) OVER (PARTITION BY account_id ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY account_id ORDER BY ts, transaction_id) IS NULL
                             OR ts - lag(ts) OVER (PARTITION BY account_id ORDER BY ts, transaction_id) >= INTERVAL 30 MINUTE
                           THEN 1 ELSE 0 END AS new_s FROM transactions) a) b
GROUP BY account_id, sid""", ("total_amount",))
def q_velocity_sessions(spark, sf_dir):
    """V5: 30-minute-gap activity sessions (halo buckets, equal to session windows); oracle by gaps-and-islands."""
    return V.sessions(_tx(spark, sf_dir))


@register("stream_tumbling", _V4_SQL, ("total_amount",))
def q_stream_tumbling(spark, sf_dir):
    """V4 streaming: watermark (1 h) + 1-day tumbling window, update mode, idempotent sink."""
    return jobs.tumbling_counts_stream(spark, sf_dir)


_SCORED_TX = """SELECT t.transaction_id, t.account_id, s.risk_score, s.risk_category, g.ml_prob AS fraud_probability, g.anomaly_score,
  g.alert_score AS rules_score FROM transactions t LEFT JOIN scored s ON t.account_id = s.account_id LEFT JOIN given_scores g ON t.account_id = g.account_id"""


@register("stream_scorer", f"""
SELECT transaction_id, account_id, risk_score, risk_category, severity, alert_type, reason_codes, {QA.DESC_SQL} AS description, n_factors, top_factor
FROM (SELECT *, {QA.SEV_SQL} AS severity, {QA.TYPE_SQL} AS alert_type, {QA.CODES_SQL} AS reason_codes,
  CAST(1 + (fraud_probability > 0)::INT + (anomaly_score > 0)::INT + (rules_score > 0)::INT AS INTEGER) AS n_factors,
  CASE greatest(CASE WHEN fraud_probability > 0 THEN {QA.sr('fraud_probability', 3)} ELSE 0 END, CASE WHEN anomaly_score > 0 THEN {QA.sr('anomaly_score / 100', 3)} ELSE 0 END,
                CASE WHEN rules_score > 0 THEN {QA.sr('rules_score / 100', 3)} ELSE 0 END, {QA.sr('risk_score / 100', 3)})
    WHEN CASE WHEN fraud_probability > 0 THEN {QA.sr('fraud_probability', 3)} END THEN 'ML Fraud Probability'
    WHEN CASE WHEN anomaly_score > 0 THEN {QA.sr('anomaly_score / 100', 3)} END THEN 'Anomaly Detection Score'
    WHEN CASE WHEN rules_score > 0 THEN {QA.sr('rules_score / 100', 3)} END THEN 'Rule-Based Alert Score' ELSE 'Composite Risk Score' END AS top_factor
  FROM ({_SCORED_TX}) x) y
""", ("risk_score",), extra={"scored": QA.q_explain.SCORED_SQL})
def q_stream_scorer(spark, sf_dir):
    """V6: streaming scorer — stream-static join, K9 + B6-B10 projections, foreachBatch sink."""
    out = jobs.scoring_stream(spark, sf_dir, fx.given_scores(spark, sf_dir).drop("label"))
    factors = F.from_json("contributing_factors", "array<struct<factor:string,value:string,weight:double>>")
    return out.withColumns({"n_factors": F.size(factors), "top_factor": F.get(factors, F.lit(0))["factor"]}).drop("contributing_factors")


@register("stream_alert_counts", """
SELECT account_id, count(DISTINCT transaction_id) AS alert_count FROM transactions WHERE amount > 200.0 GROUP BY 1""")
def q_stream_alert_counts(spark, sf_dir):
    """V7: de-duplicated rule alerts and a per-account running count in streaming state."""
    return jobs.running_alert_counts(spark, sf_dir).select("account_id", F.col("alert_count").cast("long"))
