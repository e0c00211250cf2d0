"""Registered queries: scans S3 and profiling P1-P14 over ``account_profile``."""

from __future__ import annotations

from riskloom.operators import profile as P
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import (NUMERIC_FEATURES, PROFILE_CLASS, PROFILE_COLS, candidates_sql,
                                   corr_expr, dup_of_sql, pos, union_all)
from riskloom.sources import fixtures as fx
from riskloom.sources.tables import scan_totals

SRC = "account_profile"
NUMERIC = [c for c in PROFILE_COLS if PROFILE_CLASS[c] == "numeric" and c != "account_id"]
NON_NUMERIC = [c for c in PROFILE_COLS if PROFILE_CLASS[c] != "numeric"]
SPARK_DTYPE = {"string": "string", "timestamp": "timestamp_ntz"}


def _prof(spark, sf_dir):
    return fx.account_profile(spark, sf_dir)


def _null_part(i, c, extra=""):
    return (f"SELECT '{c}' AS column_name, {pos(i)} AS position{extra}, "
            f"count(*) - count({c}) AS null_count, "
            f"CAST((count(*) - count({c})) * 100.0 / count(*) AS DOUBLE) AS null_pct")


_S3_SQL = f"""
SELECT count(*) AS n_rows,
       CAST(sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in PROFILE_COLS)}) AS BIGINT) AS n_null_cells,
       CAST(sum(CAST(label = 1 AS BIGINT)) AS BIGINT) AS n_pos,
       CAST(sum(CAST(label = 0 AS BIGINT)) AS BIGINT) AS n_neg
FROM {SRC}"""


@register("scan_totals", _S3_SQL)
def q_scan_totals(spark, sf_dir):
    """S3: rows, null cells and class counts as one partial+final aggregate."""
    return scan_totals(_prof(spark, sf_dir), "label")


_P1_SQL = union_all([
    _null_part(i, c, f", '{'numeric' if PROFILE_CLASS[c] == 'numeric' else ('categorical' if PROFILE_CLASS[c] == 'string' else 'other')}' AS dtype_class")
    + f", count(DISTINCT {c}) AS nunique FROM {SRC}" for i, c in enumerate(PROFILE_COLS)])


@register("profile_columns", _P1_SQL, ("null_pct",))
def q_profile_columns(spark, sf_dir):
    """Per-column dtype class, null count / %, exact distinct count."""
    return P.column_profile(_prof(spark, sf_dir), PROFILE_COLS)


_P2_SQL = union_all([
    f"""SELECT '{c}' AS column_name, '{SPARK_DTYPE[PROFILE_CLASS[c]]}' AS dtype,
       (SELECT count(DISTINCT {c}) FROM {SRC}) AS nunique,
       (SELECT string_agg(v, ', ' ORDER BY account_id) FROM
          (SELECT account_id, CAST({c} AS VARCHAR) AS v FROM {SRC} WHERE {c} IS NOT NULL
           ORDER BY account_id LIMIT 5) s) AS sample_values""" for c in NON_NUMERIC])


@register("profile_non_numeric", _P2_SQL)
def q_profile_non_numeric(spark, sf_dir):
    """Non-numeric columns with distinct count and the first 5 values by id."""
    return P.non_numeric_report(_prof(spark, sf_dir), "account_id", NON_NUMERIC)


_P3_SQL = union_all([_null_part(i, c) + f" FROM {SRC}" for i, c in enumerate(PROFILE_COLS)])


@register("profile_nulls", _P3_SQL, ("null_pct",))
def q_profile_nulls(spark, sf_dir):
    """Null count and rate for every column."""
    return P.null_counts(_prof(spark, sf_dir), PROFILE_COLS)


@register("profile_missing_summary", f"""
SELECT CAST(sum(null_count) AS BIGINT) AS total_missing_cells,
       CAST(sum(null_count) * 100.0 / (max(n) * {len(PROFILE_COLS)}) AS DOUBLE) AS percent_missing_cells,
       CAST(sum(CAST(null_count > 0 AS BIGINT)) AS BIGINT) AS columns_with_any_missing,
       CAST(sum(CAST(null_pct > 50 AS BIGINT)) AS BIGINT) AS columns_over_50_pct_missing,
       CAST(sum(CAST(null_pct = 100 AS BIGINT)) AS BIGINT) AS columns_100_pct_missing
FROM ({union_all([_null_part(i, c, f', count(*) AS n') + f' FROM {SRC}' for i, c in enumerate(PROFILE_COLS)])}) t
""", ("percent_missing_cells",))
def q_profile_missing_summary(spark, sf_dir):
    """Missing-cell summary."""
    return P.missing_summary(_prof(spark, sf_dir), PROFILE_COLS)


@register("profile_top_missing", f"""
SELECT column_name, null_pct AS percent FROM ({_P3_SQL}) t
ORDER BY null_pct DESC, column_name LIMIT 30
""", ("percent",))
def q_profile_top_missing(spark, sf_dir):
    """Top-30 columns by null share (a top-k report)."""
    return P.top_missing(_prof(spark, sf_dir), PROFILE_COLS, 30)


@register("profile_constant", union_all([
    f"SELECT '{c}' AS column_name, {pos(i)} AS position FROM {SRC} "
    f"HAVING min({c}) IS NOT DISTINCT FROM max({c})" for i, c in enumerate(PROFILE_COLS)]))
def q_profile_constant(spark, sf_dir):
    """P5: constant columns (<= 1 distinct non-null value)."""
    return P.constant_columns(_prof(spark, sf_dir), PROFILE_COLS)


_DUP_COLS = [c for c in PROFILE_COLS if c != "account_id"]


@register("profile_duplicates", dup_of_sql(_DUP_COLS))
def q_profile_duplicates(spark, sf_dir):
    """Duplicate columns (NULL -> -99999), fingerprint + exact confirmation."""
    return P.duplicate_columns(_prof(spark, sf_dir), "account_id", _DUP_COLS)


_CAND = candidates_sql(NUMERIC)
_PAIRS = [(i, j) for i in range(len(NUMERIC)) for j in range(i + 1, len(NUMERIC))]
_PAIR_SQL = union_all([
    f"SELECT '{NUMERIC[i]}' AS feature1, '{NUMERIC[j]}' AS feature2, "
    f"abs({corr_expr(NUMERIC[i], NUMERIC[j])}) AS correlation FROM imputed "
    f"HAVING (SELECT cand_{NUMERIC[i]} AND cand_{NUMERIC[j]} FROM flags)" for i, j in _PAIRS])


@register("profile_correlated", f"""
SELECT feature1, feature2, correlation FROM ({_PAIR_SQL}) t
WHERE correlation > 0.95 ORDER BY correlation DESC, feature1, feature2 LIMIT 50
""", ("correlation",), extra=_CAND)
def q_profile_correlated(spark, sf_dir):
    """|Pearson| > 0.95 pairs after median impute, top 50."""
    return P.correlated_pairs(_prof(spark, sf_dir), "account_id")


_LEAK_SQL = union_all([
    f"SELECT '{c}' AS column_name, abs({corr_expr(c, 'label')}) AS correlation FROM imputed "
    f"HAVING (SELECT cand_{c} AND cand_label FROM flags)" for c in NUMERIC if c != "label"])


@register("profile_leakage", f"""
SELECT column_name, correlation FROM ({_LEAK_SQL}) t WHERE correlation > 0.8
""", ("correlation",), extra=_CAND)
def q_profile_leakage(spark, sf_dir):
    """Leakage candidates |corr(feature, label)| > 0.8."""
    return P.leakage_candidates(_prof(spark, sf_dir), "account_id", "label")


@register("profile_leakage_scores", f"""
SELECT column_name, correlation FROM ({_LEAK_SQL}) t
""", ("correlation",), extra=_CAND)
def q_profile_leakage_scores(spark, sf_dir):
    """P8 (full table): |corr(feature, label)| for every candidate feature."""
    return P.leakage_candidates(_prof(spark, sf_dir), "account_id", "label", threshold=-1.0)


@register("profile_class_distribution", f"""
SELECT label, count(*) AS n, CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DOUBLE) AS pct
FROM {SRC} GROUP BY label
""", ("pct",))
def q_profile_class_distribution(spark, sf_dir):
    """Class counts with share."""
    return P.class_distribution(_prof(spark, sf_dir), "label")


@register("profile_null_histogram", f"""
SELECT bin, lo + bin * (hi - lo) / 50 AS bin_lo, count(*) AS n FROM (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((null_pct - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin,
         lo, hi
  FROM (SELECT null_pct, min(null_pct) OVER () AS lo, max(null_pct) OVER () AS hi FROM ({_P3_SQL}) a) b) c
GROUP BY bin, lo, hi
""", ("bin_lo",))
def q_profile_null_histogram(spark, sf_dir):
    """50-bin histogram of column null shares."""
    return P.null_rate_histogram(_prof(spark, sf_dir), PROFILE_COLS)


_TC_RANK = union_all([
    f"SELECT '{c}' AS f, {i} AS i, abs({corr_expr(c, 'label')}) AS r FROM imputed "
    f"HAVING (SELECT cand_{c} FROM flags)" for i, c in enumerate(NUMERIC)])
_TC_PAIRS = union_all([
    f"SELECT '{NUMERIC[i]}' AS a, '{NUMERIC[j]}' AS b, {corr_expr(NUMERIC[i], NUMERIC[j])} AS correlation "
    f"FROM imputed" for i, j in [(i, j) for i in range(len(NUMERIC)) for j in range(len(NUMERIC)) if i != j]])


@register("profile_target_corr_matrix", f"""
SELECT p.a AS feature1, p.b AS feature2, p.correlation
FROM ({_TC_PAIRS}) p
JOIN (SELECT f, row_number() OVER (ORDER BY coalesce(r, -1.0) DESC, f) AS k
      FROM ({_TC_RANK}) t) ra ON p.a = ra.f
JOIN (SELECT f, row_number() OVER (ORDER BY coalesce(r, -1.0) DESC, f) AS k
      FROM ({_TC_RANK}) t) rb ON p.b = rb.f
WHERE ra.k <= 16 AND rb.k <= 16 AND ra.k < rb.k
""", ("correlation",), extra=_CAND)
def q_profile_target_corr_matrix(spark, sf_dir):
    """Pairwise correlations among the 16 columns most correlated with the target."""
    return P.target_corr_matrix(_prof(spark, sf_dir), "account_id", "label", 16)


_USE_COLS = [c for c in PROFILE_COLS if c != "label"]


def _useless_part(i, c):
    az = (f"bool_and(coalesce({c}, 0) = 0)" if PROFILE_CLASS[c] == "numeric" else "false")
    return f"""SELECT '{c}' AS column_name, {pos(i)} AS position,
  CASE WHEN {az} THEN 'all_zero'
       WHEN min({c}) IS NOT DISTINCT FROM max({c}) THEN 'constant'
       WHEN (SELECT top_cnt FROM topc WHERE col = '{c}') * 1.0 / count(*) > 0.999
         THEN 'near_constant' END AS reason
FROM {SRC}"""


_TOPC = union_all([f"SELECT '{c}' AS col, max(cnt) AS top_cnt FROM "
                   f"(SELECT count(*) AS cnt FROM {SRC} GROUP BY {c}) g" for c in _USE_COLS])


@register("profile_useless", f"""
SELECT * FROM ({union_all([_useless_part(i, c) for i, c in enumerate(_USE_COLS)])}) t
WHERE reason IS NOT NULL
""", extra={"topc": _TOPC})
def q_profile_useless(spark, sf_dir):
    """All-zero / constant / near-constant columns (target excluded)."""
    return P.useless_columns(_prof(spark, sf_dir), "label", _USE_COLS)


@register("profile_inspect", union_all([
    f"""SELECT '{c}' AS column_name, bool_and(coalesce({c}, 0) = 0) AS all_zero,
  count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS nunique,
  CAST((count(*) - count({c})) * 100.0 / count(*) AS DOUBLE) AS null_pct,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {SRC}"""
    for c in NUMERIC_FEATURES]), ("null_pct", "min", "max"))
def q_profile_inspect(spark, sf_dir):
    """Column inspector over the numeric features."""
    return P.column_inspector(_prof(spark, sf_dir), NUMERIC_FEATURES)
