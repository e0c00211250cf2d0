"""Small helpers that generate column-wise oracle SQL (DuckDB) from column lists."""

from __future__ import annotations

# Fixed schema of the derived ``account_profile`` view: (name, class).
PROFILE_SCHEMA = [
    ("account_id", "numeric"), ("acct_type", "string"), ("nation", "string"),
    ("region", "string"), ("acctbal", "numeric"), ("n_orders", "numeric"),
    ("n_order_keys", "numeric"), ("total_price", "numeric"), ("max_price", "numeric"),
    ("max_urgent_big", "numeric"), ("n_lines", "numeric"), ("qty", "numeric"),
    ("inflow", "numeric"), ("outflow", "numeric"), ("n_urgent", "numeric"),
    ("n_null_dates", "numeric"), ("first_order", "timestamp"), ("last_order", "timestamp"),
    ("open_date", "string"), ("ev_count", "numeric"), ("ev_value_sum", "numeric"),
    ("ev_value_avg", "numeric"), ("ev_value_max", "numeric"), ("n_purchase", "numeric"),
    ("n_error", "numeric"), ("label", "numeric"),
]
PROFILE_COLS = [c for c, _ in PROFILE_SCHEMA]
PROFILE_CLASS = dict(PROFILE_SCHEMA)
NUMERIC_FEATURES = [c for c, k in PROFILE_SCHEMA if k == "numeric" and c not in ("account_id",)]


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def pos(i: int) -> str:
    return f"CAST({i} AS INTEGER)"


def filled(c: str) -> str:
    """The duplicate-detection value: numeric as double, NULL -> -99999."""
    if PROFILE_CLASS.get(c) == "numeric":
        return f"coalesce(CAST({c} AS DOUBLE), -99999.0)"
    return f"coalesce(CAST({c} AS VARCHAR), '-99999.0')"


def dup_of_sql(cols: list[str], src: str = "account_profile") -> str:
    """Rows (column_name, duplicate_of): j duplicates the first earlier i with equal values."""
    pairs = [(i, j) for j in range(len(cols)) for i in range(j)
             if (PROFILE_CLASS.get(cols[i]) == "numeric") == (PROFILE_CLASS.get(cols[j]) == "numeric")]
    if not pairs:
        return "SELECT CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS duplicate_of WHERE false"
    flags = ",\n  ".join(f"bool_and({filled(cols[i])} = {filled(cols[j])}) AS e{i}_{j}" for i, j in pairs)
    rows = union_all([f"SELECT '{cols[j]}' AS column_name, '{cols[i]}' AS duplicate_of, {i} AS i, {j} AS j, "
                      f"e{i}_{j} AS eq FROM eqs" for i, j in pairs])
    return f"""
SELECT column_name, duplicate_of FROM (
  SELECT column_name, duplicate_of, row_number() OVER (PARTITION BY j ORDER BY i) AS rn
  FROM (WITH eqs AS MATERIALIZED (SELECT {flags} FROM {src}) {rows}) t WHERE eq) u WHERE rn = 1
"""


def candidates_sql(cols: list[str], src: str = "account_profile") -> dict[str, str]:
    """CTEs (dups, flags, imputed) for the correlation candidate rule of P7.

    candidate = not constant, null share <= 50 %, not a duplicate, median not NULL.
    """
    stats = ", ".join(
        f"count({c}) AS nn_{c}, (min({c}) IS NOT DISTINCT FROM max({c})) AS const_{c}, "
        f"median({c}) AS med_{c}" for c in cols)
    flags = f"""
SELECT s.*, {", ".join(
        f"(NOT const_{c} AND (n - nn_{c}) * 100.0 / n <= 50 AND med_{c} IS NOT NULL "
        f"AND '{c}' NOT IN (SELECT column_name FROM dups)) AS cand_{c}" for c in cols)}
FROM (SELECT count(*) AS n, {stats} FROM {src}) s
"""
    imputed = f"""
SELECT {", ".join(f"coalesce(CAST(p.{c} AS DOUBLE), f.med_{c}) AS {c}" for c in cols)}
FROM {src} p, flags f
"""
    return {"dups": dup_of_sql(cols, src), "flags": flags, "imputed": imputed}


def corr_expr(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL "
            f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")
