"""Registered queries: feature engineering F1-F9, F11 over the account table.

Each stage runs on the same stage input (the account profile plus one derived
categorical) so that its oracle SQL stays independent of the other stages;
F9 and the F11 pipeline chain the stages.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from riskloom.operators import features as FE
from riskloom.operators.feature_pipeline import FeaturePipeline, FeaturePipelineModel
from riskloom.operators.folds import fold_sql, stratified_folds
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import union_all
from riskloom.session import checkpoint_dir
from riskloom.sources import fixtures as fx

NUM = list(fx.NUMERIC_COLS)
CATS = ["acct_type", "nation", "region", "seg_nation"]
MISS_COLS = ["acct_type", "nation", "region", "acctbal", "n_orders", "n_order_keys", "total_price",
             "max_price", "max_urgent_big", "n_lines", "qty", "inflow", "outflow", "n_urgent",
             "n_null_dates", "open_date", "ev_count", "ev_value_sum", "ev_value_avg",
             "ev_value_max", "n_purchase", "n_error", "seg_nation"]
FI = "feature_input"
EXTRA = {FI: "SELECT *, acct_type || '|' || nation AS seg_nation FROM account_profile"}


def feature_input(spark, sf_dir):
    p = fx.account_profile(spark, sf_dir)
    return p.withColumn("seg_nation", F.concat(F.col("acct_type"), F.lit("|"), F.col("nation")))


def _ids(df, cols):
    return df.select("account_id", *cols)


# ---- F1 -----------------------------------------------------------------------
F1_COLS = ["mv_row_missing_count", "mv_row_missing_rate", "mv_has_any_missing",
           "mv_missing_block_score", "mv_col_miss_cluster"]


def _f1_sql() -> str:
    n = len(MISS_COLS)
    cnt = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in MISS_COLS)
    rstats = ", ".join(f"avg(CAST({c} IS NULL AS DOUBLE)) AS r_{c}, "
                       f"avg(CASE WHEN label = 1 THEN CAST({c} IS NULL AS DOUBLE) END) AS m_{c}" for c in MISS_COLS)
    w = {c: f"(CASE WHEN s.r_{c} >= 0.01 AND s.r_{c} <= 0.95 THEN coalesce(s.m_{c}, 0.0) ELSE 0.0 END)"
         for c in MISS_COLS}
    wsum = " + ".join(w[c] for c in MISS_COLS)
    num = " + ".join(f"CAST(p.{c} IS NULL AS DOUBLE) * {w[c]}" for c in MISS_COLS)
    return f"""
SELECT account_id, mv_row_missing_count, mv_row_missing_rate, mv_has_any_missing,
       mv_missing_block_score,
       CAST(greatest(len(list_filter(e, lambda x: x < mv_row_missing_rate)) - 1, 0) AS INTEGER) AS mv_col_miss_cluster
FROM (
  SELECT b.*, (SELECT list_distinct(quantile_cont(r, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))
               FROM (SELECT ({cnt}) / {float(n)} AS r FROM {FI}) z) AS e
  FROM (
    SELECT p.account_id, CAST({cnt.replace('CAST(', 'CAST(p.')} AS INTEGER) AS mv_row_missing_count,
           ({cnt.replace('CAST(', 'CAST(p.')}) / {float(n)} AS mv_row_missing_rate,
           CAST(({cnt.replace('CAST(', 'CAST(p.')}) > 0 AS INTEGER) AS mv_has_any_missing,
           CASE WHEN ({wsum}) > 0 THEN ({num}) / (({wsum}) + 1e-9) ELSE 0.0 END AS mv_missing_block_score
    FROM {FI} p, (SELECT {rstats} FROM {FI}) s) b) t
"""


@register("features_missing", _f1_sql(), ("mv_row_missing_rate", "mv_missing_block_score"), extra=EXTRA)
def q_features_missing(spark, sf_dir):
    """F1a/F1c/F1d: row missing count/rate/any, mule-weighted block score, rate quintile."""
    df = feature_input(spark, sf_dir)
    m = FE.MissingFeatures(MISS_COLS).fit(df)
    return _ids(m.transform(df, with_indicators=False), F1_COLS)


# ---- F2 -----------------------------------------------------------------------
def _f2_sql(src: str = FI, cats: list[str] = CATS, key: str = "account_id") -> str:
    sel, joins = [], []
    for c in cats:
        joins.append(f"""LEFT JOIN (SELECT value, cnt / sum(cnt) OVER () AS freq,
              CAST(row_number() OVER (ORDER BY cnt DESC, value) AS INTEGER) AS rnk
            FROM (SELECT {c} AS value, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) g) t_{c}
          ON p.{c} = t_{c}.value""")
        sel += [f"coalesce(t_{c}.freq, 0.0) AS {c}_freq", f"coalesce(t_{c}.rnk, 9999) AS {c}_freq_rank",
                f"CAST(coalesce(t_{c}.freq, 0.0) < 0.01 AS INTEGER) AS {c}_is_rare"]
    comp = " + ".join(f"coalesce(t_{c}.freq, 0.0)" for c in cats)
    rar = " + ".join(f"CAST(coalesce(t_{c}.freq, 0.0) < 0.01 AS INTEGER)" for c in cats)
    return (f"SELECT p.{key}, {', '.join(sel)}, ({comp}) / {len(cats)} AS freq_composite, "
            f"CAST({rar} AS INTEGER) AS freq_rarity_score FROM {src} p " + "\n".join(joins))


F2_COLS = [f"{c}_{s}" for c in CATS for s in ("freq", "freq_rank", "is_rare")] + ["freq_composite", "freq_rarity_score"]


@register("features_frequency", _f2_sql(), [f"{c}_freq" for c in CATS] + ["freq_composite"], extra=EXTRA)
def q_features_frequency(spark, sf_dir):
    """F2: frequency encoding, rank, rarity; composite and rarity score."""
    df = feature_input(spark, sf_dir)
    return _ids(FE.FrequencyEncoder(CATS).fit(df).transform(df), F2_COLS)


# ---- F3 -----------------------------------------------------------------------
def _f3_sql(src: str = FI, cats: list[str] = CATS, key: str = "account_id") -> str:
    sel, joins = [], []
    g = f"(SELECT avg(CAST(label AS DOUBLE)) FROM {src})"
    for c in cats:
        joins.append(f"""LEFT JOIN (SELECT {c} AS value, (count(*) * avg(CAST(label AS DOUBLE)) + 20 * {g}) / (count(*) + 20) AS te
            FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) t_{c} ON p.{c} = t_{c}.value""")
        te = f"coalesce(t_{c}.te, {g})"
        sel += [f"{te} AS {c}_te", f"{te} - {g} AS {c}_te_deviation", f"CAST({te} > 2 * {g} AS INTEGER) AS {c}_te_high_risk"]
    tes = [f"coalesce(t_{c}.te, {g})" for c in cats]
    return (f"SELECT p.{key}, {', '.join(sel)}, ({' + '.join(tes)}) / {len(cats)} AS te_mean_risk, "
            f"greatest({', '.join(tes)}) AS te_max_risk, greatest({', '.join(tes)}) - least({', '.join(tes)}) AS te_risk_spread "
            f"FROM {src} p " + "\n".join(joins))


F3_COLS = [f"{c}_{s}" for c in CATS for s in ("te", "te_deviation", "te_high_risk")] + \
    ["te_mean_risk", "te_max_risk", "te_risk_spread"]


@register("features_target_encoding", _f3_sql(),
          [f"{c}_{s}" for c in CATS for s in ("te", "te_deviation")] + ["te_mean_risk", "te_max_risk", "te_risk_spread"],
          extra=EXTRA)
def q_features_target_encoding(spark, sf_dir):
    """F3a-c: smoothed target encoding (k=20), deviation, high-risk flag, composites."""
    df = feature_input(spark, sf_dir)
    return _ids(FE.TargetEncoder(CATS).fit(df).transform(df), F3_COLS)


def _f3d_sql() -> str:
    sel = []
    for c in CATS:
        sel.append(f"""CASE WHEN coalesce(o_{c}.n, 0) > 0
            THEN (o_{c}.s + 20 * pr.g) / (o_{c}.n + 20) ELSE pr.g END AS {c}_te_oof""")
    joins = "\n".join(f"""LEFT JOIN (
      SELECT value, fold, sum(n) OVER (PARTITION BY value) - n AS n, sum(s) OVER (PARTITION BY value) - s AS s
      FROM (SELECT {c} AS value, fold, count(*) AS n, sum(CAST(label AS DOUBLE)) AS s FROM ff
            WHERE {c} IS NOT NULL GROUP BY 1, 2) a) o_{c} ON f.{c} = o_{c}.value AND f.fold = o_{c}.fold"""
                      for c in CATS)
    return f"""
SELECT f.account_id, f.fold, {', '.join(sel)}
FROM ff f
JOIN (SELECT fold, (ts - fs) / (tn - fn) AS g FROM
        (SELECT fold, count(*) AS fn, sum(CAST(label AS DOUBLE)) AS fs FROM ff GROUP BY fold) a,
        (SELECT count(*) AS tn, sum(CAST(label AS DOUBLE)) AS ts FROM ff) b) pr ON f.fold = pr.fold
{joins}"""


@register("features_target_encoding_oof", _f3d_sql(), [f"{c}_te_oof" for c in CATS],
          extra={**EXTRA, "ff": f"SELECT *, {fold_sql()} AS fold FROM {FI}"})
def q_features_target_encoding_oof(spark, sf_dir):
    """F3d + M3: out-of-fold target encoding over 5 stratified folds (no per-fold loop)."""
    df = stratified_folds(feature_input(spark, sf_dir), "account_id", "label", 5)
    out = FE.oof_target_encode(df, CATS, "fold")
    return out.select("account_id", "fold", *[f"{c}_te_oof" for c in CATS])


# ---- F4 -----------------------------------------------------------------------
F4_COLS = ["date_open_year", "date_open_month", "date_open_day", "date_open_dayofweek",
           "date_open_quarter", "date_open_is_weekend", "date_open_is_month_end",
           "date_open_is_month_start", "account_age_days", "account_age_years", "account_age_bucket",
           "date_open_same_date_count", "date_open_same_month_count", "date_open_cohort_risk"]

_F4_SQL = f"""
SELECT account_id,
  CAST(coalesce(year(d), -1) AS INTEGER) AS date_open_year,
  CAST(coalesce(month(d), -1) AS INTEGER) AS date_open_month,
  CAST(coalesce(day(d), -1) AS INTEGER) AS date_open_day,
  CAST(coalesce(isodow(d) - 1, -1) AS INTEGER) AS date_open_dayofweek,
  CAST(coalesce(quarter(d), -1) AS INTEGER) AS date_open_quarter,
  CAST(coalesce(isodow(d) - 1 >= 5, false) AS INTEGER) AS date_open_is_weekend,
  CAST(coalesce(day(d) >= 28, false) AS INTEGER) AS date_open_is_month_end,
  CAST(coalesce(day(d) <= 3, false) AS INTEGER) AS date_open_is_month_start,
  CAST(coalesce(days, -1) AS INTEGER) AS account_age_days,
  coalesce(days / CAST(365.25 AS DOUBLE), -1.0) AS account_age_years,
  CAST(CASE WHEN days IS NULL THEN -1 WHEN days > -1 AND days <= 90 THEN 0 WHEN days > 90 AND days <= 365 THEN 1
       WHEN days > 365 AND days <= 1095 THEN 2 WHEN days > 1095 AND days <= 3650 THEN 3 WHEN days > 3650 THEN 4
       ELSE -1 END AS INTEGER) AS account_age_bucket,
  CAST(coalesce(dc.cnt, 1) AS BIGINT) AS date_open_same_date_count,
  CAST(coalesce(mc.cnt, 1) AS BIGINT) AS date_open_same_month_count,
  (coalesce(dc.cnt, 1) - st.m) / (CASE WHEN st.s > 0 THEN st.s ELSE 1.0 END) AS date_open_cohort_risk
FROM (SELECT account_id, d, DATE '2026-01-01' - d AS days
      FROM (SELECT account_id, CAST(try_strptime(open_date, '%-m-%-d-%Y') AS DATE) AS d FROM {FI}) a) x
LEFT JOIN dcnt dc ON x.d = dc.dk
LEFT JOIN (SELECT date_trunc('month', d) AS m, count(*) AS cnt FROM pd GROUP BY 1) mc ON date_trunc('month', x.d) = mc.m
CROSS JOIN (SELECT avg(cnt) AS m, stddev_pop(cnt) AS s FROM dcnt) st
"""


_PD = (f"SELECT CAST(try_strptime(open_date, '%-m-%-d-%Y') AS DATE) AS d FROM {FI} "
       f"WHERE try_strptime(open_date, '%-m-%-d-%Y') IS NOT NULL")
_DCNT = "SELECT d AS dk, count(*) AS cnt FROM pd GROUP BY d"


@register("features_dates", _F4_SQL, ("account_age_years", "date_open_cohort_risk"),
          extra={**EXTRA, "pd": _PD, "dcnt": _DCNT})
def q_features_dates(spark, sf_dir):
    """open-date parts, weekend / month edges, age, age bucket, cohort counts."""
    df = feature_input(spark, sf_dir)
    return _ids(FE.DateFeatures("open_date").fit(df).transform(df), F4_COLS)


# ---- row-statistic stages (F5, F8) via long form in the oracle ----------------------
_LONG = (f"SELECT account_id, v FROM (UNPIVOT (SELECT account_id, "
         + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)
         + f" FROM {FI}) ON {', '.join(NUM)} INTO NAME k VALUE v) u")
_ROWSTATS = f"""
SELECT p.account_id, s.n, s.mean, s.sd0, s.mx, s.mn, s.med, s.npos, s.nneg, s.nzero, s.m2, s.m3, s.m4,
       s.possum, s.negsum, s.ndist
FROM {FI} p LEFT JOIN (
  SELECT l.account_id, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS sd0, max(v) AS mx, min(v) AS mn,
         median(v) AS med, count(*) FILTER (WHERE v > 0) AS npos, count(*) FILTER (WHERE v < 0) AS nneg,
         count(*) FILTER (WHERE v = 0) AS nzero,
         avg(power(v - mu, 2)) AS m2, avg(power(v - mu, 3)) AS m3, avg(power(v - mu, 4)) AS m4,
         sum(CASE WHEN v > 0 THEN v ELSE 0.0 END) AS possum, sum(CASE WHEN v < 0 THEN v ELSE 0.0 END) AS negsum,
         count(DISTINCT v) AS ndist
  FROM long l JOIN (SELECT account_id, avg(v) AS mu FROM long GROUP BY 1) mm ON l.account_id = mm.account_id
  GROUP BY l.account_id) s ON p.account_id = s.account_id
"""
F5_COLS = ["ratio_numeric_cv", "ratio_top_to_median", "ratio_nonzero_fraction", "ratio_pos_to_neg",
           "ratio_extreme_range"]


_F5_SQL = f"""
SELECT account_id,
  sd0 / (abs(mean) + 1e-9) AS ratio_numeric_cv,
  mx / (abs(med) + 1e-9) AS ratio_top_to_median,
  ({len(NUM)} - coalesce(nzero, 0)) / ({float(len(NUM))} + 1e-9) AS ratio_nonzero_fraction,
  coalesce(npos, 0) / (coalesce(nneg, 0) + 1e-9) AS ratio_pos_to_neg,
  (mx - mn) / (abs(mean) + 1e-9) AS ratio_extreme_range
FROM rowstats"""


@register("features_ratios", _F5_SQL, F5_COLS, extra={**EXTRA, "long": _LONG, "rowstats": _ROWSTATS})
def q_features_ratios(spark, sf_dir):
    """row CV, top/median, non-zero share (NULL counts as non-zero), pos/neg, range."""
    df = feature_input(spark, sf_dir)
    return _ids(FE.RatioFeatures(NUM, 200).fit(df).transform(df), F5_COLS)


F8_COLS = ["beh_row_mean", "beh_row_std", "beh_row_skew", "beh_row_kurtosis", "beh_positive_sum",
           "beh_negative_sum", "beh_net_flow", "beh_flow_imbalance", "beh_high_activity",
           "beh_zero_fraction", "beh_distinct_values", "beh_entropy", "beh_acct_type_risk",
           "beh_employment_risk", "beh_channel_risk"]

_ENT = f"""
SELECT account_id, sum(-p * log2(p + 1e-12)) AS ent FROM (
  SELECT b.account_id, cnt / (r.n + 1e-9) AS p FROM (
    SELECT l.account_id, CASE WHEN r.mx = r.mn THEN 5 ELSE least(floor((v - r.mn) * 10 / (r.mx - r.mn)), 9) END AS bin,
           count(*) AS cnt
    FROM long l JOIN rowstats r ON l.account_id = r.account_id GROUP BY 1, 2) b
  JOIN rowstats r ON b.account_id = r.account_id) t GROUP BY account_id
"""


_F8_SQL = f"""
SELECT r.account_id, r.mean AS beh_row_mean, r.sd0 AS beh_row_std,
  CASE WHEN r.n > 2 THEN (CASE WHEN r.m2 = 0 THEN NULL ELSE r.m3 / power(r.m2, 1.5) END) ELSE 0.0 END AS beh_row_skew,
  CASE WHEN r.n > 3 THEN (CASE WHEN r.m2 = 0 THEN NULL ELSE r.m4 / (r.m2 * r.m2) - 3.0 END) ELSE 0.0 END AS beh_row_kurtosis,
  coalesce(r.possum, 0.0) AS beh_positive_sum, coalesce(r.negsum, 0.0) AS beh_negative_sum,
  coalesce(r.possum, 0.0) + coalesce(r.negsum, 0.0) AS beh_net_flow,
  abs(abs(coalesce(r.possum, 0.0)) - abs(coalesce(r.negsum, 0.0)))
    / (abs(coalesce(r.possum, 0.0)) + abs(coalesce(r.negsum, 0.0)) + 1e-9) AS beh_flow_imbalance,
  CAST(coalesce(r.mean > pop.a + 2 * (CASE WHEN pop.s = 0 THEN 1.0 ELSE pop.s END), false) AS INTEGER) AS beh_high_activity,
  coalesce(r.nzero, 0) / ({float(len(NUM))} + 1e-9) AS beh_zero_fraction,
  CAST(coalesce(r.ndist, 0) AS INTEGER) AS beh_distinct_values,
  coalesce(e.ent, 0.0) AS beh_entropy,
  CAST(0.5 AS DOUBLE) AS beh_acct_type_risk, CAST(0.5 AS DOUBLE) AS beh_employment_risk, CAST(0.5 AS DOUBLE) AS beh_channel_risk
FROM rowstats r
CROSS JOIN (SELECT avg(mean) AS a, stddev_samp(mean) AS s FROM rowstats) pop
LEFT JOIN ent e ON r.account_id = e.account_id
"""


@register("features_behaviour", _F8_SQL, [c for c in F8_COLS if c not in ("beh_high_activity", "beh_distinct_values")],
          extra={**EXTRA, "long": _LONG, "rowstats": _ROWSTATS, "ent": _ENT})
def q_features_behaviour(spark, sf_dir):
    """F8: population row moments, signed flows, activity flag, zero share, distinct
    values, 10-bin entropy, fixed categorical risk maps (account type mapped)."""
    df = feature_input(spark, sf_dir)
    m = FE.BehaviourFeatures(NUM, 300, acct_col="acct_type").fit(df)
    return _ids(m.transform(df), F8_COLS)


# ---- F6 interactions (long form: the names follow the fitted variance order) -----
def _f6_sql(k: int = 15) -> str:
    var = union_all([f"SELECT '{c}' AS c, var_samp(CAST({c} AS DOUBLE)) AS v FROM {FI}" for c in NUM])
    rank = (f"SELECT c, row_number() OVER (ORDER BY (v IS NULL), v DESC, c) AS r FROM ({var}) x")
    pairs = []
    for a in NUM:
        for b in NUM:
            if a == b:
                continue
            pairs.append(f"SELECT account_id, 'interact_{a}_x_{b}' AS feature, CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE) AS value, "
                         f"'{a}' AS a, '{b}' AS b FROM {FI}")
            pairs.append(f"SELECT account_id, 'interact_{a}_diff_{b}' AS feature, CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE) AS value, "
                         f"'{a}' AS a, '{b}' AS b FROM {FI}")
    top_sum = " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) * (SELECT CAST(r <= {k} AS INTEGER) FROM vr WHERE c = '{c}')"
                         for c in NUM)
    top_sq = " + ".join(f"coalesce(CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE), 0.0) * (SELECT CAST(r <= {k} AS INTEGER) FROM vr WHERE c = '{c}')"
                        for c in NUM)
    return f"""
SELECT p.account_id, p.feature, p.value FROM ({union_all(pairs)}) p
JOIN vr ra ON p.a = ra.c JOIN vr rb ON p.b = rb.c
WHERE ra.r <= {k} AND rb.r <= {k} AND ra.r < rb.r
UNION ALL SELECT account_id, 'interact_sum_top', {top_sum} FROM {FI}
UNION ALL SELECT account_id, 'interact_sum_sq_top', {top_sq} FROM {FI}
""", rank


_F6, _F6_RANK = _f6_sql()


@register("features_interactions", _F6, (), extra={**EXTRA, "vr": _F6_RANK})
def q_features_interactions(spark, sf_dir):
    """pairwise x / diff of the 15 highest-variance columns, row sums of them."""
    df = feature_input(spark, sf_dir)
    m = FE.InteractionFeatures(NUM, [], 15).fit(df)
    names = m.feature_names()
    out = m.transform(df).select("account_id", *names)
    return out.unpivot(["account_id"], names, "feature", "value")


# ---- F7 outliers ---------------------------------------------------------------------
F7_COLS = ["out_iqr_count", "out_zscore_count", "out_total_flag_count", "out_outlier_rate",
           "out_max_zscore", "out_composite_score"]


def _f7_sql() -> str:
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}, "
                      f"avg({c}) AS mu_{c}, CASE WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 1e-9 "
                      f"ELSE stddev_samp({c}) END AS sd_{c}" for c in NUM)
    iqr = " + ".join(f"CAST(coalesce({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}), false) AS INTEGER)"
                     for c in NUM)
    z = " + ".join(f"CAST(coalesce(abs(({c} - mu_{c}) / sd_{c}) > 3.0, false) AS INTEGER)" for c in NUM)
    zmax = "greatest(" + ", ".join(f"abs(({c} - mu_{c}) / sd_{c})" for c in NUM) + ")"
    n = len(NUM)
    return f"""
SELECT account_id, ic AS out_iqr_count, zc AS out_zscore_count, ic + zc AS out_total_flag_count,
       (ic + zc) / ({2 * n} + 1e-9) AS out_outlier_rate, zmax AS out_max_zscore,
       (ic + zc) / ({2 * n} + 1e-9) AS out_composite_score
FROM (SELECT account_id, CAST({iqr} AS INTEGER) AS ic, CAST({z} AS INTEGER) AS zc, {zmax} AS zmax
      FROM (SELECT p.account_id, {', '.join(f'CAST(p.{c} AS DOUBLE) AS {c}' for c in NUM)}, s.* FROM {FI} p,
            (SELECT {stats} FROM {FI}) s) a) b
"""


@register("features_outliers", _f7_sql(), ("out_outlier_rate", "out_max_zscore", "out_composite_score"), extra=EXTRA)
def q_features_outliers(spark, sf_dir):
    """IQR / z-score outlier counts, rate, max |z| over the top-100 variance columns."""
    df = feature_input(spark, sf_dir)
    m = FE.OutlierFeatures(NUM, 100).fit(df)
    return _ids(m.transform(df, with_flags=False), F7_COLS)


# ---- F9 risk profile (chains F1, F2, F3, F4, F7, F8) ---------------------------------
F9_COLS = ["risk_profile_score"] + FE.RISK_FLAGS + ["risk_emp_channel_combo", "risk_flag_count",
                                                     "risk_composite_score", "risk_tier"]


def pipeline(**own):
    """F11 with the columns of the account table; selection off unless asked for."""
    return FeaturePipeline(**{"categoricalCols": CATS, "numericCols": NUM, "missingCols": MISS_COLS, "dateCol": "open_date", "accountTypeCol": "acct_type", "topN": 0, **own})


_F9_BASE = """
SELECT f1.account_id,
  f3.te_mean_risk * 0.25 + f7.out_outlier_rate * 0.2 + f8.beh_flow_imbalance * 0.2
    + f2.freq_rarity_score / 8.0 * 0.2 + f1.mv_missing_block_score * 0.15 AS risk_profile_score,
  CAST(f4.account_age_days < 90 AND f8.beh_high_activity = 1 AS INTEGER) AS risk_new_acct_flag,
  CAST(f4.date_open_cohort_risk > 2.0 AS INTEGER) AS risk_batch_open_flag,
  CAST(f2.freq_rarity_score >= 2 AS INTEGER) AS risk_synthetic_id_flag,
  CAST(f8.beh_flow_imbalance < 0.15 AS INTEGER) AS risk_flow_thru_flag,
  CAST(f7.out_total_flag_count > p90.p AS INTEGER) AS risk_outlier_heavy_flag,
  f8.beh_employment_risk * f8.beh_channel_risk AS risk_emp_channel_combo
FROM f1 JOIN f2 ON f1.account_id = f2.account_id JOIN f3 ON f1.account_id = f3.account_id
JOIN f4 ON f1.account_id = f4.account_id JOIN f7 ON f1.account_id = f7.account_id
JOIN f8 ON f1.account_id = f8.account_id
CROSS JOIN (SELECT quantile_cont(CAST(out_total_flag_count AS DOUBLE), 0.9) AS p FROM f7) p90
"""
_F9_EXTRA = {
    **EXTRA, "pd": _PD, "dcnt": _DCNT, "f1": _f1_sql(), "f2": _f2_sql(), "f3": _f3_sql(), "f4": _F4_SQL,
    "long": _LONG, "rowstats": _ROWSTATS, "ent": _ENT, "f7": _f7_sql(), "f8": _F8_SQL}


def _engineered(spark, sf_dir):
    """Stages 1-9 as one lazy plan, fitted on the stages' inputs: a query that needs a few of the ~350 columns prunes the rest."""
    df = feature_input(spark, sf_dir)
    stages = [FE.MissingFeatures(MISS_COLS), FE.FrequencyEncoder(CATS), FE.TargetEncoder(CATS), FE.DateFeatures("open_date"),
              FE.OutlierFeatures(NUM, 100), FE.BehaviourFeatures(NUM, 300, acct_col="acct_type")]
    models = [st.fit(df) for st in stages]
    models.append(FE.RiskProfileFeatures().fit(models[4].transform(df, with_flags=False)))
    for m in models:
        df = m.transform(df)
    return df


@register("features_risk_profile", "SELECT account_id, risk_profile_score, risk_new_acct_flag, risk_batch_open_flag, "
          "risk_synthetic_id_flag, risk_flow_thru_flag, risk_outlier_heavy_flag FROM (" + _F9_BASE + ") t",
          ("risk_profile_score",), extra=_F9_EXTRA)
def q_features_risk_profile(spark, sf_dir):
    """F9a/b: risk profile score and the five binary risk flags on chained stages."""
    return _engineered(spark, sf_dir).select("account_id", "risk_profile_score", *FE.RISK_FLAGS)


# F9e reads all numeric columns of the chain: the base columns, F1-F8 and F9a, c, d, as (account_id, value) rows
def _f9e_sql() -> str:
    f = {"f1": F1_COLS, "f2": F2_COLS, "f3": F3_COLS, "f4": F4_COLS, "f5": F5_COLS, "f7": F7_COLS, "f8": F8_COLS, FI: NUM,
         "f9": ["risk_profile_score", "risk_emp_channel_combo", "risk_flag_count", "risk_composite_score", "risk_tier"]}
    parts = [f"SELECT account_id, CAST({c} AS DOUBLE) AS v FROM {t}" for t, cols in f.items() for c in cols]
    parts += [f"SELECT account_id, CAST({c} IS NULL AS DOUBLE) FROM {FI} WHERE (SELECT avg(CAST({c} IS NULL AS DOUBLE)) BETWEEN 0.01 AND 0.95 FROM {FI})" for c in MISS_COLS]
    parts.append("SELECT account_id, value FROM f6")
    te = [f"{c}_te" for c in CATS]
    parts += [f"SELECT account_id, {a} * {b} FROM f3" for i, a in enumerate(te) for b in te[i + 1:]]
    parts.append(f"SELECT account_id, CAST(i <= out_total_flag_count AS DOUBLE) FROM f7, range(1, {2 * len(NUM) + 1}) t(i)")   # the flags themselves, as many ones
    return f"""SELECT account_id, stddev_pop(v) / (avg(abs(v)) + 1e-9) AS risk_anomaly_score
FROM (SELECT account_id, coalesce(v, 0.0) AS v FROM ({" UNION ALL ".join(parts)}) u) w GROUP BY account_id"""


_F9_SQL = """SELECT account_id, risk_profile_score, risk_new_acct_flag, risk_batch_open_flag, risk_synthetic_id_flag, risk_flow_thru_flag, risk_outlier_heavy_flag,
  risk_emp_channel_combo, CAST(fc AS INTEGER) AS risk_flag_count, comp AS risk_composite_score,
  CAST(CASE WHEN comp > -0.001 AND comp <= 0.25 THEN 0 WHEN comp > 0.25 AND comp <= 0.5 THEN 1
            WHEN comp > 0.5 AND comp <= 0.75 THEN 2 WHEN comp > 0.75 AND comp <= 1.001 THEN 3 ELSE 0 END AS INTEGER) AS risk_tier
FROM (SELECT *, 0.5 * (fc / 5) + 0.5 * least(greatest(risk_profile_score, 0.0), 1.0) AS comp FROM (
  SELECT *, risk_new_acct_flag + risk_batch_open_flag + risk_synthetic_id_flag + risk_flow_thru_flag
            + risk_outlier_heavy_flag AS fc FROM (""" + _F9_BASE + """) a) b) c"""
F9_ALL = F9_COLS + ["risk_anomaly_score"]
# every risk column is kept by the selection, unless it is all zero, constant or near constant
_F11_LONG = union_all([f"SELECT f9.account_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM f9 JOIN f9e ON f9.account_id = f9e.account_id" for c in F9_ALL])
_F11_KEPT = """SELECT feature FROM (SELECT feature, value, count(*) AS c FROM f11 GROUP BY 1, 2) g GROUP BY feature
HAVING count(value) > 1 AND max(c) <= 0.999 * sum(c)"""
_F11_SQL = "SELECT account_id, feature, value FROM f11 WHERE feature IN (SELECT feature FROM f11_kept)"
_F11_EXTRA = {**_F9_EXTRA, "f5": _F5_SQL, "vr": _F6_RANK, "f6": _F6, "f9": _F9_SQL, "f9e": _f9e_sql(), "f11": _F11_LONG, "f11_kept": _F11_KEPT}


def _risk_columns(out):
    names = [c for c in out.columns if c.startswith("risk_")]
    return out.select("account_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["account_id"], names, "feature", "value")


def _leaky_input(spark, sf_dir):
    """The account table with a known leakage column and one that is nearly the label; both must go."""
    df = feature_input(spark, sf_dir)
    return df.withColumns({"settled_case": F.col("label") * 3, "almost_label": F.col("label") * 100 + F.pmod("account_id", F.lit(7))})


@register("features_pipeline", _F11_SQL, ("value",), extra=_F11_EXTRA)
def q_features_pipeline(spark, sf_dir):
    """leakage drop, the stages 1-9, attribution-driven selection and clean-up in one estimator; the kept risk columns
    (F9a-e) of all rows in long form."""
    df = _leaky_input(spark, sf_dir)
    model = pipeline(topN=150, leakageCols=["settled_case"]).fit(df)
    return _risk_columns(model.transform(df))


@register("features_pipeline_reload", _F11_SQL, ("value",), extra=_F11_EXTRA)
def q_features_pipeline_reload(spark, sf_dir):
    """F11 + S8: the same from a model that was saved and loaded again, applied to rows without their label."""
    path = f"{checkpoint_dir(spark)}/models/features-{uuid4().hex}"
    df = _leaky_input(spark, sf_dir)
    pipeline(topN=40, leakageCols=["settled_case"], maxIter=4).fit(df).write().save(path)
    return _risk_columns(FeaturePipelineModel.load(path).transform(df.drop("label")))


# ---- F2 / F3 on the labelled document table (text measures over whole texts) ----------
DOC_CATS = ["lang", "source"]


@register("features_doc_encoding", f"""
SELECT f.doc_id, {', '.join(f'f.{c}_freq, f.{c}_freq_rank, f.{c}_is_rare, t.{c}_te' for c in DOC_CATS)},
  t.te_mean_risk, d.n_digits, d.n_upper, d.n_newlines
FROM ({_f2_sql('doc_labelled', DOC_CATS, 'doc_id')}) f
JOIN ({_f3_sql('doc_labelled', DOC_CATS, 'doc_id')}) t ON f.doc_id = t.doc_id
JOIN doc_labelled d ON f.doc_id = d.doc_id""",
          [f"{c}_freq" for c in DOC_CATS] + [f"{c}_te" for c in DOC_CATS] + ["te_mean_risk"])
def q_features_doc_encoding(spark, sf_dir):
    """F2 + F3 on documents x labels (label = toxic): frequency and target encodings of
    language and source, plus digit / upper-case / line counts over the whole texts."""
    d = fx.doc_labelled(spark, sf_dir)
    out = FE.FrequencyEncoder(DOC_CATS).fit(d).transform(d)
    out = FE.TargetEncoder(DOC_CATS).fit(d).transform(out)
    return out.select("doc_id", *[x for c in DOC_CATS for x in (f"{c}_freq", f"{c}_freq_rank", f"{c}_is_rare", f"{c}_te")],
                      "te_mean_risk", "n_digits", "n_upper", "n_newlines")


@register("features_risk_composite", """
SELECT account_id, risk_emp_channel_combo, CAST(fc AS INTEGER) AS risk_flag_count, comp AS risk_composite_score,
  CAST(CASE WHEN comp > -0.001 AND comp <= 0.25 THEN 0 WHEN comp > 0.25 AND comp <= 0.5 THEN 1
            WHEN comp > 0.5 AND comp <= 0.75 THEN 2 WHEN comp > 0.75 AND comp <= 1.001 THEN 3 ELSE 0 END AS INTEGER) AS risk_tier
FROM (SELECT *, 0.5 * (fc / 5) + 0.5 * least(greatest(risk_profile_score, 0.0), 1.0) AS comp FROM (
  SELECT *, risk_new_acct_flag + risk_batch_open_flag + risk_synthetic_id_flag + risk_flow_thru_flag
            + risk_outlier_heavy_flag AS fc FROM (""" + _F9_BASE + """) a) b) c""",
          ("risk_emp_channel_combo", "risk_composite_score"), extra=_F9_EXTRA)
def q_features_risk_composite(spark, sf_dir):
    """F9c/F9d: employment x channel combo, flag count, composite score and tier."""
    return _engineered(spark, sf_dir).select("account_id", "risk_emp_channel_combo", "risk_flag_count", "risk_composite_score", "risk_tier")


def _f1b_sql() -> str:
    parts = [f"SELECT account_id, '{c}_is_missing' AS feature, CAST({c} IS NULL AS INTEGER) AS value FROM {FI} "
             f"WHERE (SELECT avg(CAST({c} IS NULL AS DOUBLE)) BETWEEN 0.01 AND 0.95 FROM {FI})" for c in MISS_COLS]
    return union_all(parts)


@register("features_missing_indicators", _f1b_sql(), extra=EXTRA)
def q_features_missing_indicators(spark, sf_dir):
    """{c}_is_missing for every column whose null share is in [0.01, 0.95] (long form)."""
    df = feature_input(spark, sf_dir)
    m = FE.MissingFeatures(MISS_COLS).fit(df)
    names = [f"{c}_is_missing" for c in m.indicator_cols]
    out = m.transform(df).select("account_id", *names)
    if not names:
        return df.sparkSession.createDataFrame([], "account_id long, feature string, value int")
    return out.unpivot(["account_id"], names, "feature", "value")


# ---- F8f on categories that the risk maps know -------------------------------------------
_KINDS = {"acct_kind": (list(FE.ACCT_TYPE_RISK), FE.ACCT_TYPE_RISK, 1), "employment": (list(FE.EMPLOYMENT_RISK), FE.EMPLOYMENT_RISK, 3),
          "channel": (list(FE.CHANNEL_RISK), FE.CHANNEL_RISK, 5)}


def _f8f_sql() -> str:
    kinds = ", ".join(f"CASE WHEN account_id % 11 = 0 THEN NULL WHEN account_id % 13 = 0 THEN 'unlisted' ELSE [{', '.join(repr(v) for v in values)}][account_id * {m} % {len(values)} + 1] END AS {c}"
                      for c, (values, _, m) in _KINDS.items())
    risks = ", ".join(f"CAST(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in risk.items()) + f" ELSE 0.5 END AS DOUBLE) AS {name}"
                      for (c, (_, risk, _)), name in zip(_KINDS.items(), ("beh_acct_type_risk", "beh_employment_risk", "beh_channel_risk")))
    return f"SELECT account_id, {', '.join(_KINDS)}, {risks} FROM (SELECT account_id, {kinds} FROM {FI}) k"


@register("features_risk_maps", _f8f_sql(), extra=EXTRA)
def q_features_risk_maps(spark, sf_dir):
    """F8f: account-type, employment and channel risk of listed, unlisted and missing categories (dealt to the accounts by id)."""
    k = F.col("account_id")
    kind = lambda values, m: F.when(k % 11 == 0, None).when(k % 13 == 0, "unlisted").otherwise(
        F.get(F.array(*map(F.lit, values)), (k * m % len(values)).cast("int")))
    df = feature_input(spark, sf_dir).withColumns({c: kind(values, m) for c, (values, _, m) in _KINDS.items()})
    out = FE.BehaviourFeatures(NUM, 300, "acct_kind", "employment", "channel").fit(df).transform(df)
    return _ids(out, [*_KINDS, "beh_acct_type_risk", "beh_employment_risk", "beh_channel_risk"])
