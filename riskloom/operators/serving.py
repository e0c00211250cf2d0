"""Analyst serving operators (B12, B14, B16, B18, B22): searches, pages and reports over the entity tables.

A page is a top-k report: ``orderBy().offset().limit()`` keeps ``page * page_size`` rows per task and merges them, so deep
pages cost more, as anywhere. Each row of a page carries the ``total`` of matching rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCOUNT_ORDERS = ("account_id", "risk_score", "fraud_probability", "anomaly_score", "rules_score", "category", "status", "last_activity")


def _like(col: str, text: str) -> Column:
    """Contains ``text``, whatever the case; its % and _ are ordinary signs."""
    return F.contains(F.lower(F.col(col).cast("string")), F.lit(text.lower()))


def _page(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    total = df.agg(F.count(F.lit(1)).alias("total"))   # one row
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size).join(F.broadcast(total), how="inner")


def search_accounts(accounts: DataFrame, search: str | None = None, status: str | None = None, risk_min: float = 0.0,
                    risk_max: float = 100.0, sort_by: str = "risk_score", descending: bool = True, page: int = 1,
                    page_size: int = 20) -> DataFrame:
    """Accounts by id text, status and score range, sorted by one column (ties by id)."""
    if sort_by not in ACCOUNT_ORDERS:
        raise ValueError(f"accounts cannot be sorted by {sort_by}")
    found = accounts.where(F.col("risk_score").between(risk_min, risk_max))
    if search:
        found = found.where(_like("account_id", search))
    if status:
        found = found.where(F.col("status") == status)
    order = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
    return _page(found, [order, F.col("account_id")], page, page_size)


def account_transactions(transactions: DataFrame, account_id: int | str = "ALL", page: int = 1, page_size: int = 50) -> DataFrame:
    """One account's transactions, or those of ALL, newest first."""
    found = transactions if account_id == "ALL" else transactions.where(F.col("account_id") == account_id)
    return _page(found, [F.col("ts").desc_nulls_last(), F.col("transaction_id").desc()], page, page_size)


def list_alerts(alerts: DataFrame, severity: str | None = None, status: str | None = None, alert_type: str | None = None,
                account_id: int | str | None = None, search: str | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
    """Alerts by severity, status, type, account and account text, newest first (an alert without a status is open)."""
    found = alerts.withColumn("status", F.coalesce("status", F.lit("OPEN")))
    for name, value in (("severity", severity), ("status", status), ("alert_type", alert_type)):
        if value:
            found = found.where(F.col(name) == value.upper())
    if account_id is not None:
        found = found.where(F.col("account_id") == account_id)
    if search:
        found = found.where(_like("account_id", search))
    return _page(found, [F.col("timestamp").desc_nulls_last(), F.col("alert_id")], page, page_size)


def top_cases(accounts: DataFrame, alerts: DataFrame, n: int = 5, risk_min: float = 60.0) -> DataFrame:
    """The n highest-risk accounts with their number of alerts."""
    top = accounts.where(F.col("risk_score") >= risk_min).orderBy(F.desc("risk_score"), "account_id").limit(n)
    counts = alerts.join(F.broadcast(top.select("account_id")), "account_id", "left_semi").groupBy("account_id").agg(F.count(F.lit(1)).alias("alert_count"))
    return top.join(F.broadcast(counts), "account_id", "left").withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))


def split_drivers(drivers: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Each row's drivers parted by sign, strongest first, with its bar: |value| by the side's largest (at least 0.001).
    ``drivers`` has a bounded number of rows per key."""
    side = F.when(F.col(value) >= 0, "positive").otherwise("negative")
    df = drivers.withColumn("side", side)
    whole = Window.partitionBy(key, "side")
    order = whole.orderBy(F.abs(F.col(value)).desc(), F.col(name))
    return df.select(key, "side", F.row_number().over(order).alias("rank"), name, value,
                     (F.abs(F.col(value)) / F.greatest(F.max(F.abs(F.col(value))).over(whole), F.lit(0.001))).alias("bar_share"))
