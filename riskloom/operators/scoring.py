"""Risk scoring (K1-K9, K18): weighted components, non-linear boosts, category.

The reference scores a pandas frame row by row; here the whole batch is one
projection (a single whole-stage-codegen span, no shuffle), so it scales
linearly with the number of rows and parallelises across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.exprs import clip, col_sum

# ---- fixed values of the scoring model (must equal the reference) -----------
COMPONENTS = ["ml_prob", "anomaly_score", "behavior_score", "alert_score"]
WEIGHTS = {"ml_prob": 0.40, "anomaly_score": 0.25, "behavior_score": 0.20, "alert_score": 0.15}
HIGH_THRESH = 75.0
CRITICAL_THRESH = 85.0
ELEVATED_THRESH = 60.0
HIGH_SIGNAL_BOOST = {"ml_prob": 0.12, "anomaly_score": 0.10, "behavior_score": 0.08,
                     "alert_score": 0.15}
CRITICAL_ALERT_BOOST = 0.20
INTERACTION_BOOST_2 = 0.10
INTERACTION_BOOST_3 = 0.20
# (lo, hi, category, action) — inclusive bounds, first match wins, else SAFE
RISK_CATEGORIES = [
    (81, 100, "BLOCK", "Immediate block, SAR filing, escalation"),
    (61, 80, "REVIEW", "Hold for analyst review, delay transaction"),
    (31, 60, "MONITOR", "Enhanced monitoring, flag for review queue"),
    (0, 30, "SAFE", "Standard processing, no action required"),
]
COMPONENT_LABELS = {"ml_prob": "ML Fraud Probability", "anomaly_score": "Anomaly Detection",
                    "behavior_score": "Transaction Behaviour", "alert_score": "Rule-Based Alerts"}
CONTRIB_NAMES = {"ml_prob": "ml_contrib", "anomaly_score": "anomaly_contrib",
                 "behavior_score": "behavior_contrib", "alert_score": "alert_contrib"}


def check_weights(weights: dict[str, float]) -> None:
    total = sum(weights.values())
    if not abs(total - 1.0) < 1e-6:
        raise ValueError(f"Weights must sum to 1.0, got {total:.4f}")


def out_of_range(cols: list[str] = COMPONENTS) -> Column:
    """K1 predicate: any component outside [0, 100] (NULL counts as invalid)."""
    bad = [~F.coalesce(F.col(c).between(0.0, 100.0), F.lit(False)) for c in cols]
    return bad[0] if len(bad) == 1 else F.greatest(*[b.cast("int") for b in bad]) == 1


def validate(df: DataFrame, cols: list[str] = COMPONENTS) -> DataFrame:
    """K1 strict mode: a row outside [0,100] fails the job, like the reference's ValueError."""
    # The guard wraps a column that is kept, so column pruning cannot drop it.
    guarded = F.when(out_of_range(cols), F.raise_error(F.lit(
        "risk input must be in [0, 100]; multiply probabilities by 100 first"))
    ).otherwise(F.col(cols[0]))
    return df.withColumn(cols[0], guarded)


def quarantine(df: DataFrame, cols: list[str] = COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """K1 lenient mode: (valid rows, rejected rows) by one predicate — no job failure."""
    bad = out_of_range(cols)
    return df.filter(~bad), df.filter(bad)


def scale_probability(df: DataFrame, col: str = "ml_prob") -> DataFrame:
    """K2: a raw probability in [0,1] becomes a score in [0,100]."""
    return df.withColumn(col, F.col(col) * 100)


def category_expr(score: Column, gap_mode: str = "reference") -> Column:
    """K8. ``reference``: inclusive bands, scores in the gaps (30,31), (60,61), (80,81)
    fall to SAFE as in the reference. ``contiguous``: >=81 / >=61 / >=31."""
    if gap_mode == "contiguous":
        return (F.when(score >= 81, "BLOCK").when(score >= 61, "REVIEW")
                .when(score >= 31, "MONITOR").otherwise("SAFE"))
    e = None
    for lo, hi, cat, _ in RISK_CATEGORIES:
        cond = (score >= lo) & (score <= hi)
        e = F.when(cond, cat) if e is None else e.when(cond, cat)
    return e.otherwise("SAFE")


def action_expr(category: Column) -> Column:
    e = None
    for _, _, cat, act in RISK_CATEGORIES:
        e = F.when(category == cat, act) if e is None else e.when(category == cat, act)
    return e


def score_components(df: DataFrame, weights: dict[str, float] = WEIGHTS,
                     high_thresh: float = HIGH_THRESH, critical_thresh: float = CRITICAL_THRESH,
                     elevated_thresh: float = ELEVATED_THRESH,
                     high_signal_boost: dict[str, float] = HIGH_SIGNAL_BOOST,
                     critical_alert_boost: float = CRITICAL_ALERT_BOOST,
                     interaction_boost_2: float = INTERACTION_BOOST_2,
                     interaction_boost_3: float = INTERACTION_BOOST_3,
                     gap_mode: str = "reference") -> DataFrame:
    """K3-K8 as one projection. Adds contributions, base, boost parts, score, category."""
    check_weights(weights)
    v = {c: F.col(c) for c in COMPONENTS}
    contrib = {c: (F.lit(weights[c]) * v[c]) for c in COMPONENTS}
    base = col_sum([F.col(CONTRIB_NAMES[c]) for c in COMPONENTS])
    high = {c: F.when(v[c] > high_thresh, F.lit(high_signal_boost[c])).otherwise(F.lit(0.0))
            for c in COMPONENTS}
    crit = F.when(v["alert_score"] > critical_thresh, F.lit(critical_alert_boost)).otherwise(0.0)
    n_elev = col_sum([(v[c] > elevated_thresh).cast("int") for c in COMPONENTS])
    inter = (F.when(F.col("n_elevated") >= 3, F.lit(interaction_boost_2 + interaction_boost_3))
             .when(F.col("n_elevated") >= 2, F.lit(interaction_boost_2)).otherwise(F.lit(0.0)))
    boost = col_sum([F.lit(1.0)] + [F.col(f"hs_{c}") for c in COMPONENTS]
                    + [F.col("critical_boost"), F.col("interaction_boost")])
    out = (df
           .select("*", *[contrib[c].alias(CONTRIB_NAMES[c]) for c in COMPONENTS],
                   *[high[c].alias(f"hs_{c}") for c in COMPONENTS],
                   crit.alias("critical_boost"), n_elev.alias("n_elevated"))
           .withColumn("interaction_boost", inter)
           .withColumn("base_score", base)
           .withColumn("boost_multiplier", boost))
    score = clip(F.col("base_score") * F.col("boost_multiplier"), 0.0, 100.0)
    return (out.withColumn("risk_score", score)
            .withColumn("risk_category", category_expr(F.col("risk_score"), gap_mode)))


BATCH_COLUMNS = ["account_id", "risk_score", "risk_category", "ml_contrib", "anomaly_contrib",
                 "behavior_contrib", "alert_contrib", "base_score", "boost_multiplier",
                 "n_elevated"]


def score_batch(df: DataFrame, raw_prob: bool = False, strict: bool = True,
                gap_mode: str = "reference", **params) -> DataFrame:
    """K9: the reference's ``batch_compute`` output (10 columns), for any number of rows."""
    if raw_prob:
        df = scale_probability(df)
    if strict:
        df = validate(df)
    return score_components(df, gap_mode=gap_mode, **params).select(*BATCH_COLUMNS)


def integrate(accounts: DataFrame, ml: DataFrame | None, anomaly: DataFrame | None,
              extra: DataFrame | None = None, key: str = "account_id") -> DataFrame:
    """Accounts + classifier + anomaly + behaviour/alert columns -> scored rows.

    Inputs are joined by account id (the reference concatenates by position).
    Missing behaviour / alert columns count as 0; a missing model is an error.
    """
    if ml is None or anomaly is None:
        raise ValueError("classifier and anomaly scores are required")
    df = accounts.join(ml, key, "left").join(anomaly, key, "left")
    if extra is not None:
        df = df.join(extra, key, "left")
    for c in COMPONENTS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return df
