"""Structured Streaming jobs (V4, V6, V7) and the helper that runs them to completion.

Sources are file streams over the event table; every job writes through
``foreachBatch`` into a table under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), tagging rows with the micro-batch id so that a
retried batch overwrites its own partition instead of duplicating rows
(idempotent sink). Stream state lives in the checkpoint, so a lost executor or
a restarted driver resumes from the last committed batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import alerts as AL
from riskloom.operators import scoring
from riskloom.session import checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Transactions as a stream: the files of the event table, whether it is one file or a folder of them
    (a stream takes a single file by a pattern only)."""
    s = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
         .parquet(f"{sf_dir}/events.parque[t]"))
    return s.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account_id"),
                    F.col("value").alias("amount"), F.col("event_type").alias("type"),
                    utc_instant("ts").alias("ts"))  # event time must be a TIMESTAMP (instant)


def utc_instant(col: str):
    """Naive event time read as UTC, whatever the session time zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)"))


def utc_naive(col: str):
    """Back from an instant to the naive UTC wall-clock time."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{col}`), TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def run_until_done(stream: DataFrame, name: str, output_mode: str = "append",
                   transform=None) -> DataFrame:
    """Run a streaming query over all available input (availableNow) into an
    idempotent batch-id-partitioned table; return that table as a batch DataFrame."""
    spark = stream.sparkSession
    root = checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex[:12]}"
    out, ckpt = root + "/table", root + "/_checkpoint"

    written: list[int] = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        b = transform(batch) if transform else batch
        written.append(batch_id)
        (b.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{out}/batch_id={batch_id}"))

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if not written:   # no input at all: an empty table of the same schema
        empty = spark.createDataFrame([], stream.schema)
        return (transform(empty) if transform else empty).withColumn("batch_id", F.lit(0))
    return spark.read.parquet(out)


def latest_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """Update-mode output: keep the row of the latest micro-batch per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return table.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "batch_id")


# ---- V4: tumbling daily counts with a watermark (late data dropped) --------------------

def tumbling_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    agg = s.groupBy(F.window("ts", "1 day").alias("w"), "type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("amount").alias("total_amount"))
    t = run_until_done(agg, "v4-tumbling", "update")
    t = latest_per_key(t.withColumn("window_start", F.col("w.start")).drop("w"), ["window_start", "type"])
    return t.select(utc_naive("window_start").alias("window_start"), "type", "n_events", "total_amount")


# ---- V6: stateless streaming scorer ----------------------------------------------------

def scoring_stream(spark: SparkSession, sf_dir: str, scores: DataFrame) -> DataFrame:
    """Each incoming transaction is scored with its account's component scores
    (stream-static join) through the same K9 and B6-B10 projections as batch."""
    s = event_stream(spark, sf_dir)
    j = s.join(scores, "account_id", "left")
    sc = scoring.score_components(scoring.scale_probability(
        j.withColumn("fraud_probability", F.col("ml_prob"))))
    p, a, r, risk = F.col("fraud_probability"), F.col("anomaly_score"), F.col("alert_score"), F.col("risk_score")
    out = sc.select("transaction_id", "account_id", "risk_score", "risk_category",
                    AL.severity(risk, p).alias("severity"), AL.alert_type(p, a, r).alias("alert_type"),
                    F.array_join(AL.reason_codes(p, a, r), " | ").alias("reason_codes"), AL.description(AL.alert_type(p, a, r), p, a, r).alias("description"),
                    F.to_json(F.transform(AL.contributing_factors(p, a, r, risk), lambda f: F.struct(f["factor"], f["value"], f["weight"]))).alias("contributing_factors"))
    return run_until_done(out, "v6-scorer", "append").drop("batch_id")


# ---- V7: stateful running alert count with idempotent de-duplication ---------------------

ALERT_THRESHOLD = 200.0


def running_alert_counts(spark: SparkSession, sf_dir: str, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Rule alerts (amount > threshold) keyed by a content hash, de-duplicated within the
    watermark, then a per-account running count (partial counts per task meet in the state store)."""
    s = event_stream(spark, sf_dir).filter(F.col("amount") > threshold)
    a = s.withColumn("alert_id", F.sha2(F.concat_ws(":", F.col("account_id").cast("string"),
                                                    F.col("transaction_id").cast("string")), 256))
    d = a.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["alert_id"])
    counts = d.groupBy("account_id").agg(F.count(F.lit(1)).alias("alert_count"))
    t = run_until_done(counts, "v7-alert-counts", "update")
    return latest_per_key(t, ["account_id"])
