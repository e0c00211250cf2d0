"""Scans (S1, S3, S5) and sinks.

Parquet is the main format; every reader takes an explicit column list so that
Catalyst prunes the scan (``ReadSchema``) and pushes filters into row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.exprs import normalise_nan

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Parquet scan of one driver table; optional projection for pruning."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV scan, NaN read as NULL. With a schema there is no inference pass over the data."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        return normalise_nan(r.schema(schema).csv(path))
    return normalise_nan(r.option("inferSchema", True).csv(path))


def scan_totals(df: DataFrame, label_col: str) -> DataFrame:
    """S3: running totals of a chunked scan == one partial+final aggregate.

    rows, null cells, and per-class counts, computed map-side per partition and
    merged in a single tiny shuffle.
    """
    null_cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(null_cells).alias("n_null_cells"),
        F.sum((F.col(label_col) == 1).cast("long")).alias("n_pos"),
        F.sum((F.col(label_col) == 0).cast("long")).alias("n_neg"),
    )


# ---- S5: entity tables of the serving layer -------------------------------

ACCOUNTS_SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("profile_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("rules_score", T.DoubleType()),
    T.StructField("score_band", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("alert_count", T.IntegerType()),
    T.StructField("last_activity", T.TimestampNTZType()),
])

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("account_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("type", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

FACTOR = T.StructType([T.StructField("factor", T.StringType()),
                       T.StructField("value", T.StringType()),
                       T.StructField("weight", T.DoubleType())])

ALERTS_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType(), False),
    T.StructField("account_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("reason_codes", T.ArrayType(T.StringType())),
    T.StructField("contributing_factors", T.ArrayType(FACTOR)),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("acknowledged_at", T.TimestampNTZType()),
    T.StructField("escalated_at", T.TimestampNTZType()),
    T.StructField("resolved_at", T.TimestampNTZType()),
    T.StructField("action_by", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("account_id", T.StringType()),
    T.StructField("input_features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("decision_recommendation", T.StringType()),
    T.StructField("explanation_summary", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

TOP_FEATURE = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType()), T.StructField("description", T.StringType())])

EXPLANATIONS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("account_id", T.StringType()),
    T.StructField("top_features", T.ArrayType(TOP_FEATURE)),
    T.StructField("overall_summary", T.StringType()),
    T.StructField("reason_codes", T.ArrayType(T.StringType())),
    T.StructField("model_version", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

ENTITY_SCHEMAS = {"accounts": ACCOUNTS_SCHEMA, "transactions": TRANSACTIONS_SCHEMA,
                  "alerts": ALERTS_SCHEMA, "predictions": PREDICTIONS_SCHEMA,
                  "explanation_logs": EXPLANATIONS_SCHEMA}


def read_entity(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Typed entity table (Parquet with the declared schema)."""
    return spark.read.schema(ENTITY_SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


# ---- sinks -----------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Table sink. Parquet by default; CSV keeps a header like the reference."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON report sink — one JSON object per row (struct columns nest)."""
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append prediction / alert rows (idempotent ids are the caller's job)."""
    df.write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, key: str, batch: str) -> None:
    """Append the rows whose ``key`` (a content id) the table does not hold yet, as one batch that can be retried.

    Each batch owns the folder ``batch=<name>`` and overwrites it, so a batch that failed half-way, or runs twice, leaves its rows
    once; keys of other batches are left out by an anti join, whose build side is the key column alone. Rows of a batch that
    share a key go in once."""
    spark, name = df.sparkSession, f"batch={batch}"
    rows = df.dropDuplicates([key])
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        kept = spark.read.schema(f"{key} {dict(df.dtypes)[key]}, batch string").parquet(path).where(F.col("batch") != batch).select(F.col(key).alias("__held"))
        rows = rows.join(kept, F.col(key) == F.col("__held"), "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
