"""Account-level views derived from the driver tables (FIXTURES.md part C).

The reference reads one wide account table; here that table is *derived* by
Spark from the star schema, so every query's work grows with the inputs:

* ``account_profile`` — one row per customer: categorical attributes, order
  and line-item flows, event activity (NULL for customers without events,
  which gives natural missing values), an open-date text and a label.
* ``given_scores`` — four deterministic component scores per account.
* ``transactions`` — the events table seen as account transactions.
* ``doc_labelled`` / ``vectors`` — text and vector tables for encoders / kNN.

Plan notes (100 TB): line items are pre-aggregated per order (map-side
partial aggregate) and the result is already hash-partitioned on the order
key, so the join with ``orders`` adds no extra exchange for that side.
``nation``/``region`` are fixed-size dimension tables (25 / 5 rows by the
schema's definition) and are the only broadcast sides here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.exprs import nan_to_null, normalise_nan
from riskloom.sources.tables import table

# Fixed column roles of the derived account table.
NUMERIC_COLS = ["acctbal", "n_orders", "n_order_keys", "total_price", "max_price",
                "max_urgent_big", "n_lines", "qty", "inflow", "outflow", "n_urgent",
                "n_null_dates", "ev_count", "ev_value_sum", "ev_value_avg", "ev_value_max",
                "n_purchase", "n_error"]
CATEGORICAL_COLS = ["acct_type", "nation", "region"]
DATE_COL = "open_date"
LABEL_COL = "label"
ID_COL = "account_id"


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line aggregates joined to their order (inflow / returned outflow)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_returnflag")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("o_lines"),
        F.sum("l_quantity").alias("o_qty"),
        F.sum(net).alias("o_inflow"),
        F.sum(F.when(F.col("l_returnflag") == "R", net).otherwise(F.lit(0.0))).alias("o_outflow"),
    )
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    return orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")


def customer_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_flows(spark, sf_dir)
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count("o_orderkey").alias("n_order_keys"),
        F.round(F.sum("o_totalprice"), 2).alias("total_price"),
        F.max("o_totalprice").alias("max_price"),
        F.max(F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 490000),
                     F.col("o_totalprice"))).alias("max_urgent_big"),
        F.sum("o_lines").alias("n_lines"),
        F.sum("o_qty").alias("qty"),
        F.round(F.sum("o_inflow"), 4).alias("inflow"),
        F.round(F.sum("o_outflow"), 4).alias("outflow"),
        F.sum((F.col("o_orderpriority") == "1-URGENT").cast("long")).alias("n_urgent"),
        F.sum(F.col("o_orderdate").isNull().cast("long")).alias("n_null_dates"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
    )


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("ev_count"),
        F.round(F.sum("value"), 2).alias("ev_value_sum"),
        (F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("ev_value_avg"),
        F.max("value").alias("ev_value_max"),
        F.sum((F.col("event_type") == "purchase").cast("long")).alias("n_purchase"),
        F.sum((F.col("event_type") == "error").cast("long")).alias("n_error"),
    )


def label_expr(key: str = "c_custkey", bal: str = "c_acctbal"):
    """Deterministic 0/1 label: a key rule (~3.8 %) plus a learnable balance rule."""
    return (((F.pmod(F.col(key) * 37, F.lit(53)) < 2) | (F.col(bal) < -900))
            .cast("int"))


_MATERIALISED: dict = {}


def materialised(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a derived view once per session and input and keep it persisted
    (MEMORY_AND_DISK): the many analyses over the account table then read the
    materialised rows instead of re-running the lineitem/orders joins each time.
    Lost blocks are recomputed from lineage; ``RISKLOOM_MATERIALISE=0`` disables it."""
    import os
    if os.environ.get("RISKLOOM_MATERIALISE", "1") == "0":
        return build(spark, sf_dir)
    from pyspark import StorageLevel
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _MATERIALISED:
        for k in [k for k in _MATERIALISED if k[0] != app]:
            del _MATERIALISED[k]
        df = build(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        _MATERIALISED[key] = df
    return _MATERIALISED[key]


def account_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived account table (materialised once per session and input)."""
    return materialised(spark, sf_dir, "account_profile", build_account_profile)


def given_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "given_scores", build_given_scores)


def build_account_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal",
                 "c_mktsegment")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    flows = customer_flows(spark, sf_dir)
    act = user_activity(spark, sf_dir)
    df = (cust
          .join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey, "left")
          .join(flows, cust.c_custkey == flows.o_custkey, "left")
          .join(act, cust.c_custkey == act.user_id, "left"))
    open_date = (F.when(F.pmod(F.col("c_custkey"), F.lit(17)) == 16, F.lit("unknown"))
                 .otherwise(F.date_format("first_order", "M-d-yyyy")))
    return normalise_nan(df.select(
        F.col("c_custkey").alias(ID_COL),
        F.col("c_mktsegment").alias("acct_type"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("acctbal"),
        "n_orders", "n_order_keys", "total_price", "max_price", "max_urgent_big", "n_lines",
        "qty", "inflow", "outflow", "n_urgent", "n_null_dates", "first_order", "last_order",
        open_date.alias(DATE_COL),
        "ev_count", "ev_value_sum", "ev_value_avg", "ev_value_max", "n_purchase", "n_error",
        label_expr().alias(LABEL_COL),
    ))


def build_given_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four component scores per account, from key arithmetic plus order counts.

    ml_prob is a probability in [0,1]; the other three are in [0,100].
    """
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders", "o_custkey")
    n_ord = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    df = cust.join(n_ord, cust.c_custkey == n_ord.o_custkey, "left")
    k = F.col("c_custkey")
    lab = label_expr()
    return df.select(
        k.alias(ID_COL),
        ((F.pmod(k * 7919 + 13, F.lit(1000)) + lab * 600) / 1600).alias("ml_prob"),
        (F.pmod(k * 104729 + 7, F.lit(1001)) / 10).alias("anomaly_score"),
        (F.pmod(k * 31337 + F.coalesce(F.col("n_orders"), F.lit(0)) * 13, F.lit(1001)) / 10)
        .alias("behavior_score"),
        F.pmod(k * 7907 + 3, F.lit(101)).cast("double").alias("alert_score"),
        lab.alias(LABEL_COL),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "value", "event_type", "ts")
    return ev.select(F.col("event_id").alias("transaction_id"),
                     F.col("user_id").alias(ID_COL),
                     nan_to_null(F.col("value")).alias("amount"),
                     F.col("event_type").alias("type"),
                     F.col("ts"))


def doc_labelled(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """documents joined with labels; numeric text measures computed on whole texts."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    d = docs.join(labels, "doc_id", how)
    t = F.col("text")
    return d.select(
        "doc_id", "lang", "source", "n_chars",
        (F.length(t) - F.length(F.regexp_replace(t, "[0-9]", ""))).cast("long").alias("n_digits"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.regexp_replace(t, "\n", ""))).cast("long").alias("n_newlines"),
        "quality", F.col("toxic").alias(LABEL_COL),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return emb.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                      "label")
