"""DuckDB SQL twins of ``riskloom.sources.fixtures`` (oracle side only).

Each entry is a CTE body over the driver's pre-registered views. ``with_views``
prepends the CTEs a query mentions (and their dependencies) so every oracle
string is self-contained SQL.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}

VIEWS["order_flows"] = """
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         p.o_lines, p.o_qty, p.o_inflow, p.o_outflow
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, count(*) AS o_lines, sum(l_quantity) AS o_qty,
           sum(l_extendedprice * (1 - l_discount)) AS o_inflow,
           sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) AS o_outflow
    FROM lineitem GROUP BY l_orderkey) p ON o.o_orderkey = p.l_orderkey
"""

VIEWS["account_profile"] = """
  SELECT c.c_custkey AS account_id, c.c_mktsegment AS acct_type, g.n_name AS nation,
         g.r_name AS region, c.c_acctbal AS acctbal,
         f.n_orders, f.n_order_keys, f.total_price, f.max_price, f.max_urgent_big, f.n_lines,
         f.qty, f.inflow, f.outflow, f.n_urgent, f.n_null_dates, f.first_order, f.last_order,
         CASE WHEN c.c_custkey % 17 = 16 THEN 'unknown'
              ELSE strftime(f.first_order, '%-m-%-d-%Y') END AS open_date,
         a.ev_count, a.ev_value_sum, a.ev_value_avg, a.ev_value_max, a.n_purchase, a.n_error,
         CAST(CASE WHEN (c.c_custkey * 37) % 53 < 2 OR c.c_acctbal < -900 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM customer c
  LEFT JOIN (SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n
             LEFT JOIN region r ON n.n_regionkey = r.r_regionkey) g ON c.c_nationkey = g.n_nationkey
  LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, count(o_orderkey) AS n_order_keys,
           round(sum(o_totalprice), 2) AS total_price, max(o_totalprice) AS max_price,
           max(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 490000 THEN o_totalprice END) AS max_urgent_big,
           CAST(sum(o_lines) AS BIGINT) AS n_lines,
           sum(o_qty) AS qty, round(sum(o_inflow), 4) AS inflow, round(sum(o_outflow), 4) AS outflow,
           CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_urgent,
           CAST(sum(CASE WHEN o_orderdate IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_dates,
           min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
    FROM order_flows GROUP BY o_custkey) f ON c.c_custkey = f.o_custkey
  LEFT JOIN (
    SELECT user_id, count(*) AS ev_count, round(sum(value), 2) AS ev_value_sum, round(sum(value), 2) / count(*) AS ev_value_avg,
           max(value) AS ev_value_max,
           CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_purchase,
           CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error
    FROM events GROUP BY user_id) a ON c.c_custkey = a.user_id
"""
DEPS["account_profile"] = ["order_flows"]

VIEWS["given_scores"] = """
  SELECT c.c_custkey AS account_id,
         ((c.c_custkey * 7919 + 13) % 1000
           + 600 * (CASE WHEN (c.c_custkey * 37) % 53 < 2 OR c.c_acctbal < -900 THEN 1 ELSE 0 END)) / 1600 AS ml_prob,
         ((c.c_custkey * 104729 + 7) % 1001) / 10 AS anomaly_score,
         ((c.c_custkey * 31337 + coalesce(o.n_orders, 0) * 13) % 1001) / 10 AS behavior_score,
         CAST((c.c_custkey * 7907 + 3) % 101 AS DOUBLE) AS alert_score,
         CAST(CASE WHEN (c.c_custkey * 37) % 53 < 2 OR c.c_acctbal < -900 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o
    ON c.c_custkey = o.o_custkey
"""

VIEWS["transactions"] = """
  SELECT event_id AS transaction_id, user_id AS account_id, value AS amount,
         event_type AS type, ts FROM events
"""

VIEWS["doc_labelled"] = """
  SELECT d.doc_id, d.lang, d.source, d.n_chars,
         length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS n_digits,
         length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g')) AS n_upper,
         length(d.text) - length(replace(d.text, chr(10), '')) AS n_newlines,
         l.quality, l.toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["vectors"] = """
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings
"""


def _needed(sql: str) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for d in DEPS.get(name, []):
            visit(d)
        if name not in out:
            out.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return out


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every fixture view (and ``extra``) it uses."""
    names = _needed(sql + " ".join((extra or {}).values()))
    # MATERIALIZED: a view used by many branches of a UNION is computed once.
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names]
    ctes += [f"{n} AS MATERIALIZED ({body})" for n, body in (extra or {}).items()]
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql
