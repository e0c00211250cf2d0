"""Registered queries: risk explanations K10-K17 over the scored accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import scoring
from riskloom.operators.scoring import COMPONENT_LABELS, COMPONENTS, CONTRIB_NAMES, WEIGHTS
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import union_all
from riskloom.sources import fixtures as fx

def sround(x: str, d: int) -> str:
    """Spark's round(): HALF_UP on the shortest decimal text of the double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {d}) AS DOUBLE)"


# every column of the Spark scored frame, for the given scores (ml_prob scaled x100)
SCORED_SQL = """
SELECT *, least(greatest(base_score * boost_multiplier, 0.0), 100.0) AS risk_score,
  CASE WHEN least(greatest(base_score * boost_multiplier, 0.0), 100.0) BETWEEN 81 AND 100 THEN 'BLOCK'
       WHEN least(greatest(base_score * boost_multiplier, 0.0), 100.0) BETWEEN 61 AND 80 THEN 'REVIEW'
       WHEN least(greatest(base_score * boost_multiplier, 0.0), 100.0) BETWEEN 31 AND 60 THEN 'MONITOR'
       ELSE 'SAFE' END AS risk_category
FROM (
  SELECT *, ml_contrib + anomaly_contrib + behavior_contrib + alert_contrib AS base_score,
    1.0 + hs_ml_prob + hs_anomaly_score + hs_behavior_score + hs_alert_score + critical_boost + interaction_boost
      AS boost_multiplier
  FROM (
    SELECT *, CASE WHEN n_elevated >= 3 THEN CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE)
                   WHEN n_elevated >= 2 THEN CAST(0.1 AS DOUBLE) ELSE 0.0 END AS interaction_boost
    FROM (
      SELECT account_id, ml_prob, anomaly_score, behavior_score, alert_score,
        0.40 * ml_prob AS ml_contrib, 0.25 * anomaly_score AS anomaly_contrib,
        0.20 * behavior_score AS behavior_contrib, 0.15 * alert_score AS alert_contrib,
        CASE WHEN ml_prob > 75 THEN CAST(0.12 AS DOUBLE) ELSE 0.0 END AS hs_ml_prob,
        CASE WHEN anomaly_score > 75 THEN CAST(0.10 AS DOUBLE) ELSE 0.0 END AS hs_anomaly_score,
        CASE WHEN behavior_score > 75 THEN CAST(0.08 AS DOUBLE) ELSE 0.0 END AS hs_behavior_score,
        CASE WHEN alert_score > 75 THEN CAST(0.15 AS DOUBLE) ELSE 0.0 END AS hs_alert_score,
        CASE WHEN alert_score > 85 THEN CAST(0.20 AS DOUBLE) ELSE 0.0 END AS critical_boost,
        CAST((ml_prob > 60)::INT + (anomaly_score > 60)::INT + (behavior_score > 60)::INT
             + (alert_score > 60)::INT AS INTEGER) AS n_elevated
      FROM (SELECT account_id, ml_prob * 100 AS ml_prob, anomaly_score, behavior_score, alert_score
            FROM given_scores) g) a) b) c
"""
EXTRA = {"scored": SCORED_SQL}


def scored(spark, sf_dir):
    g = fx.given_scores(spark, sf_dir).drop("label")
    return scoring.score_components(scoring.scale_probability(g))


def _comp_rows() -> str:
    parts = []
    for i, c in enumerate(COMPONENTS):
        parts.append(f"""SELECT account_id, {i} AS ord, '{c}' AS component, '{COMPONENT_LABELS[c]}' AS label,
  {c} AS raw_score, CAST({WEIGHTS[c]!r} AS DOUBLE) AS weight, {CONTRIB_NAMES[c]} AS contribution,
  CASE WHEN risk_score > 0 THEN {CONTRIB_NAMES[c]} / risk_score * 100 ELSE 0.0 END AS pct_of_total,
  CASE WHEN {c} >= 75 THEN 'HIGH' WHEN {c} >= 60 THEN 'ELEVATED' WHEN {c} >= 30 THEN 'MODERATE' ELSE 'LOW' END AS level
FROM scored""")
    return union_all(parts)


_K10 = f"""SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY contribution DESC, ord) AS INTEGER) AS rank,
  component, label, raw_score, weight, contribution, pct_of_total, level FROM ({_comp_rows()}) t"""


@register("explain_components", _K10, ("raw_score", "weight", "contribution", "pct_of_total"), extra=EXTRA)
def q_explain_components(spark, sf_dir):
    """Component contributions per account, sorted, with share of the final score and level."""
    return X.component_explanation(scored(spark, sf_dir))


@register("explain_dominant_signal", f"""SELECT account_id, component, label, raw_score, contribution, pct_of_total
FROM ({_K10}) k WHERE rank = 1""", ("raw_score", "contribution", "pct_of_total"), extra=EXTRA)
def q_explain_dominant_signal(spark, sf_dir):
    """The dominant component (largest contribution, first on ties)."""
    return X.dominant_signal(scored(spark, sf_dir))


def _k11_sql() -> str:
    parts = []
    for i, c in enumerate(COMPONENTS):
        lab = COMPONENT_LABELS[c]
        parts.append(f"""SELECT account_id, {i} AS ord, 'HIGH_SIGNAL: {lab}' AS rule, '{lab} > 75.0' AS condition,
  printf('%.1f', {sround(c, 1)}) AS value, printf('+%.3f×', {sround('hs_' + c, 3)}) AS boost_added, true AS fired
FROM scored WHERE hs_{c} > 0""")
    parts.append(f"""SELECT account_id, 4, 'CRITICAL_ALERT: Rule-Based Alert', 'Alert Score > 85.0',
  printf('%.1f', {sround('alert_score', 1)}), printf('+%.3f×', {sround('critical_boost', 3)}), true FROM scored WHERE critical_boost > 0""")
    parts.append(f"""SELECT account_id, 5, printf('CONVERGENT_EVIDENCE: %d signals elevated', n_elevated),
  printf('≥%d scores > 60.0', n_elevated), printf('n=%d', n_elevated), printf('+%.3f×', {sround('interaction_boost', 3)}), true
FROM scored WHERE interaction_boost > 0""")
    parts.append("""SELECT account_id, 6, 'HIGH_SIGNAL: No component exceeded threshold', 'Any score > 75.0', 'N/A', '+0.000×', false
FROM scored WHERE hs_ml_prob = 0 AND hs_anomaly_score = 0 AND hs_behavior_score = 0 AND hs_alert_score = 0""")
    return (f"SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY ord) AS INTEGER) AS rank, "
            f"rule, condition, value, boost_added, fired FROM ({union_all(parts)}) t")


@register("explain_boosts", _k11_sql(), extra=EXTRA)
def q_explain_boosts(spark, sf_dir):
    """Fired boost rules per account (and the 'none fired' row)."""
    return X.boost_rules(scored(spark, sf_dir))


def _k13_sql() -> str:
    parts = []
    for i, c in enumerate(COMPONENTS):
        parts.append(f"""SELECT account_id, {i} AS ord, '{c}' AS component, '{COMPONENT_LABELS[c]}' AS label, {c} AS current,
  greatest(0.0, {c} - red / ({WEIGHTS[c]!r} * boost_multiplier)) AS needed, red / ({WEIGHTS[c]!r} * boost_multiplier) AS drop_needed,
  current_category, target_category, target_score, red AS reduction_needed
FROM (SELECT *, risk_category AS current_category,
        CASE risk_category WHEN 'BLOCK' THEN 'REVIEW' WHEN 'REVIEW' THEN 'MONITOR' ELSE 'SAFE' END AS target_category,
        CAST(CASE risk_category WHEN 'BLOCK' THEN 80 WHEN 'REVIEW' THEN 60 ELSE 30 END AS INTEGER) AS target_score,
        risk_score - CASE risk_category WHEN 'BLOCK' THEN 80 WHEN 'REVIEW' THEN 60 ELSE 30 END AS red
      FROM scored WHERE risk_category <> 'SAFE') s""")
    return f"""SELECT account_id, rank, current_category, target_category, target_score, reduction_needed, component, label,
  current, needed, drop_needed FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY drop_needed, ord) AS INTEGER) AS rank
  FROM ({union_all(parts)}) u WHERE drop_needed <= current) t WHERE rank <= 2"""


@register("explain_counterfactual", _k13_sql(), ("reduction_needed", "current", "needed", "drop_needed"),
          extra=EXTRA)
def q_explain_counterfactual(spark, sf_dir):
    """The two smallest single-component drops that reach the next lower category."""
    return X.counterfactual(scored(spark, sf_dir))


_NOTES_SQL = f"""
SELECT s.account_id, CASE WHEN s.risk_category = 'SAFE' THEN '{X.SAFE_MESSAGE}' WHEN k.label IS NULL THEN '' ELSE
  printf('{X.DROP_NOTE}', k.label, {sround(sround('k.current', 1), 0)}, {sround(sround('k.needed', 1), 0)}, k.target_category) END AS note
FROM scored s LEFT JOIN (SELECT * FROM k13 WHERE rank = 1) k ON s.account_id = k.account_id"""


@register("explain_counterfactual_notes", _NOTES_SQL, extra={**EXTRA, "k13": _k13_sql()})
def q_explain_counterfactual_notes(spark, sf_dir):
    """The SAFE message or the note sentence of each account."""
    return X.counterfactual_notes(scored(spark, sf_dir))


def _k14_sql() -> str:
    parts = []
    for i, c in enumerate(COMPONENTS):
        parts.append(f"""SELECT account_id, {i} AS ord, '{COMPONENT_LABELS[c]}' AS factor,
  CASE WHEN {c} >= 75 THEN 'HIGH' WHEN {c} >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS impact, {c} AS raw_score,
  {CONTRIB_NAMES[c]} AS contribution FROM scored""")
    parts.append("""SELECT account_id, 4, printf('Convergent Evidence (%d signals elevated)', n_elevated), 'HIGH',
  CAST(n_elevated AS DOUBLE), interaction_boost * base_score FROM scored WHERE n_elevated >= 2""")
    parts.append("""SELECT account_id, 5, 'Critical Alert Override', 'CRITICAL', alert_score, critical_boost * base_score
FROM scored WHERE critical_boost > 0""")
    return (f"SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY contribution DESC, ord) AS INTEGER) "
            f"AS rank, factor, impact, raw_score, contribution FROM ({union_all(parts)}) t")


@register("explain_severity_drivers", _k14_sql(), ("raw_score", "contribution"), extra=EXTRA)
def q_explain_severity_drivers(spark, sf_dir):
    """Severity drivers including the convergence and critical-override boosts."""
    return X.severity_drivers(scored(spark, sf_dir))


def _k16_sql() -> str:
    # running sums left-to-right exactly as the Spark expression builds them
    parts = []
    acc = "0.0"
    for i, c in enumerate(COMPONENTS):
        v = CONTRIB_NAMES[c]
        parts.append(f"SELECT account_id, {i + 1} AS step, '{c}' AS label, 'component' AS type, {v} AS value, "
                     f"{acc} AS start_at, {acc} + {v} AS end_at FROM scored")
        acc = f"({acc} + {v})"
    parts.append(f"SELECT account_id, 5, printf('Boost x%.3f', {sround('boost_multiplier', 3)}), 'boost', "
                 f"risk_score - base_score, {acc}, {acc} + (risk_score - base_score) FROM scored "
                 f"WHERE risk_score - base_score > 0.01")
    parts.append("SELECT account_id, 6, 'FINAL', 'total', risk_score, 0.0, risk_score FROM scored")
    return f"SELECT account_id, CAST(step AS INTEGER) AS step, label, type, value, start_at, end_at FROM ({union_all(parts)}) t"


@register("explain_waterfall", _k16_sql(), ("value", "start_at", "end_at"), extra=EXTRA)
def q_explain_waterfall(spark, sf_dir):
    """Waterfall steps (running start / end), boost step and total."""
    return X.waterfall(scored(spark, sf_dir))


def _k15_sql() -> str:
    cat_text = "CASE risk_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.CATEGORY_TEXT.items()) + " END"
    action = "CASE risk_category " + " ".join(f"WHEN '{c}' THEN '{a}'" for _, _, c, a in scoring.RISK_CATEGORIES) + " END"
    elev = ", ".join(f"CASE WHEN {c} >= 60 THEN printf('{COMPONENT_LABELS[c]} (%.0f)', {sround(c, 0)}) END" for c in COMPONENTS)
    highs = ", ".join(f"CASE WHEN hs_{c} > 0 THEN '{COMPONENT_LABELS[c]}' END" for c in COMPONENTS)
    return f"""
SELECT s.account_id,
  printf('This account %s with a composite risk score of %.1f/100 (category: %s). ', {cat_text}, {sround('risk_score', 1)}, risk_category)
  || printf('The primary risk driver is the %s (%s: %.1f/100), which contributes %.1f points (%.0f%%) to the final score. ',
            d.label, replace(d.component, '_', ' '), {sround('d.raw_score', 1)}, {sround('d.contribution', 1)}, {sround('d.pct_of_total', 0)})
  || CASE WHEN len(list_filter([{elev}], lambda x: x IS NOT NULL)) > 0
          THEN 'The following signals are elevated (≥60): ' || array_to_string(list_filter([{elev}], lambda x: x IS NOT NULL), ', ') || '. '
          ELSE '' END
  || CASE WHEN boost_multiplier - 1.0 > 0.01
          THEN printf('The base score of %.1f was amplified by a boost multiplier of %.3f× (total boost: +%.0f%%) due to: ',
                      {sround('base_score', 1)}, {sround('boost_multiplier', 3)}, {sround('(boost_multiplier - 1.0) * 100', 0)})
               || array_to_string(list_filter([
                    CASE WHEN len(list_filter([{highs}], lambda x: x IS NOT NULL)) > 0
                         THEN 'high-signal thresholds exceeded in ' || array_to_string(list_filter([{highs}], lambda x: x IS NOT NULL), ', ') END,
                    CASE WHEN critical_boost > 0 THEN 'critical alert threshold exceeded' END,
                    CASE WHEN interaction_boost > 0 THEN printf('convergent evidence from %d independent signals', n_elevated) END],
                    lambda x: x IS NOT NULL), '; ') || '. '
          ELSE 'No signal amplification boosts were triggered. ' END
  || 'Recommended action: ' || {action} || '.' AS narrative
FROM scored s JOIN (SELECT * FROM ({_K10}) k WHERE rank = 1) d ON s.account_id = d.account_id
"""


@register("explain_narrative", _k15_sql(), extra=EXTRA)
def q_explain_narrative(spark, sf_dir):
    """The narrative text per account."""
    return X.narrative(scored(spark, sf_dir))


REPORT_FIELDS = """score double, category string, inputs struct<ml_prob:double,alert_score:double>, components struct<ml_prob:double>,
  boost struct<base_score:double,boost_multiplier:double,critical_alert:double,n_elevated:int>,
  explanation struct<dominant_signal:string,component_breakdown:array<struct<component:string,contribution:double>>,narrative:string>"""
_K17_SQL = f"""SELECT s.account_id, s.risk_score AS score, s.risk_category AS category, s.ml_prob, s.alert_score, s.ml_contrib, s.base_score, s.boost_multiplier,
  s.critical_boost, s.n_elevated, d.component AS dominant_signal, l.component AS last_component, l.contribution AS last_contribution, n.narrative
FROM scored s JOIN k10 d ON s.account_id = d.account_id AND d.rank = 1 JOIN k10 l ON s.account_id = l.account_id AND l.rank = {len(COMPONENTS)}
JOIN k15 n ON s.account_id = n.account_id"""
_K17_DOUBLES = ("score", "ml_prob", "alert_score", "ml_contrib", "base_score", "boost_multiplier", "critical_boost", "last_contribution")
_K17_EXTRA = {**EXTRA, "k10": _K10, "k15": _k15_sql()}


def report_fields(reports):
    """Fields of the nested reports (account_id, report as JSON text), as a reader of the sink parses them."""
    r = reports.select("account_id", F.from_json("report", REPORT_FIELDS).alias("r"))
    last = F.element_at("r.explanation.component_breakdown", -1)
    return r.select("account_id", "r.score", "r.category", "r.inputs.ml_prob", "r.inputs.alert_score", F.col("r.components.ml_prob").alias("ml_contrib"), "r.boost.base_score",
                    "r.boost.boost_multiplier", F.col("r.boost.critical_alert").alias("critical_boost"), "r.boost.n_elevated", "r.explanation.dominant_signal",
                    last["component"].alias("last_component"), last["contribution"].alias("last_contribution"), "r.explanation.narrative")


@register("explain_report")
def q_explain_report(spark, sf_dir):
    """Full nested report per account as JSON (its fields: explain_report_fields)."""
    return X.report_json(scored(spark, sf_dir))


@register("explain_report_fields", _K17_SQL, _K17_DOUBLES, extra=_K17_EXTRA)
def q_explain_report_fields(spark, sf_dir):
    """The nested report's fields, parsed back from the JSON."""
    return report_fields(X.report_json(scored(spark, sf_dir)))

