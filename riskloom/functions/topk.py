"""Skew-safe top-k per group.

A plain ``row_number() over (partition by g order by o)`` sends a whole group
to one task; with one group holding a third of all rows that task becomes the
job. Here the group is first split by a salt (hash of the row key), the top k
is kept inside each (group, salt) slice, and only then ranked per group — the
second window sees at most ``k * salts`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def top_k(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
          salt_cols: list[str] | None = None, salts: int = 64,
          rank_col: str = "rank") -> DataFrame:
    """Rows with rank <= k per group (rank 1 = first by ``order``); ``order`` must be
    a total order (include a unique key as last tie-break) for deterministic output."""
    if salt_cols:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts))
        w1 = Window.partitionBy(*group_cols, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", salt)
              .withColumn("__r1", F.row_number().over(w1))
              .filter(F.col("__r1") <= k).drop("__r1", "__salt"))
    if not group_cols:
        # Global top-k: TakeOrderedAndProject keeps k rows per task, then merges.
        small = df.orderBy(*order).limit(k)
        return small.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank", parts: int | None = None) -> DataFrame:
    """Exact 1-based rank of every row under a total ``order`` without a
    single-partition window: the rows are range-partitioned on the order key
    (sampled bounds keep partitions balanced), numbered inside each partition,
    and shifted by the row counts of the preceding partitions (a table with one
    row per partition). The partitioned rows are checkpointed, so that numbers and
    counts are of the same partitions."""
    n_parts = parts or df.sparkSession.sparkContext.defaultParallelism
    ranged = cut_lineage(df.repartitionByRange(n_parts, *order).withColumn("__pid", F.spark_partition_id()))
    local = ranged.withColumn("__lr", F.row_number().over(Window.partitionBy("__pid").orderBy(*order)))
    sizes = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offs = sizes.select("__pid", F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    return (local.join(F.broadcast(offs), "__pid")
            .withColumn(rank_col, (F.col("__off") + F.col("__lr")).cast("int"))
            .drop("__pid", "__lr", "__off"))
