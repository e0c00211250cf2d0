"""Deterministic stratified k-fold assignment (M3) with a distributed exact rank.

Fold = (rank of the row inside its class by a hash key, minus 1) mod k, so fold
sizes within a class differ by at most one. A window partitioned only by the
class would put the whole majority class into one task; instead the key space
is cut into ``buckets`` ranges, counts per (class, bucket) form a small table
whose running sums give each bucket's offset, and the row number is taken
inside (class, bucket) slices only. The hash key is plain modular arithmetic,
so DuckDB can reproduce it: ``pmod(id * 2654435761 + seed, 2^32)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULT = 2654435761
MOD = 4294967296
ID_MOD = 2147483648  # id reduced below 2^31 so id * MULT < 2^63


def hash_key(id_col: str, seed: int = 42) -> Column:
    # reduce the id first so the product stays inside a long (ANSI overflow raises)
    return F.pmod(F.pmod(F.col(id_col), F.lit(ID_MOD)) * MULT + seed, F.lit(MOD))


BUCKET_ROWS = 50_000


def exact_rank(df: DataFrame, part_col: str, key: Column, id_col: str, buckets: int | None = None,
               key_max: int = MOD, rank_col: str = "rank") -> DataFrame:
    """1-based rank of each row within ``part_col`` ordered by (key, id), computed
    without a single-partition window. Keys spread evenly; unless given, the number of
    buckets follows from the row count, about BUCKET_ROWS rows to a bucket."""
    buckets = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    b = F.floor(key * buckets / key_max).cast("int")
    x = df.withColumn("__key", key).withColumn("__bucket", b)
    counts = x.groupBy(part_col, "__bucket").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(part_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part_col, "__bucket",
                            F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    # offsets has at most (#classes x buckets) rows: bounded by construction
    x = x.join(F.broadcast(offsets), [part_col, "__bucket"], "left")
    w2 = Window.partitionBy(part_col, "__bucket").orderBy("__key", id_col)
    return (x.withColumn(rank_col, F.col("__off") + F.row_number().over(w2))
            .drop("__key", "__bucket", "__off"))


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42,
                     buckets: int | None = None, fold_col: str = "fold") -> DataFrame:
    r = exact_rank(df, label_col, hash_key(id_col, seed), id_col, buckets, rank_col="__rank")
    return r.withColumn(fold_col, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def fold_sql(id_col: str = "account_id", label_col: str = "label", k: int = 5, seed: int = 42) -> str:
    """The same assignment as a DuckDB expression (oracle side)."""
    key = f"((({id_col} % {ID_MOD}) + {ID_MOD}) % {ID_MOD} * {MULT} + {seed}) % {MOD}"
    return (f"CAST((row_number() OVER (PARTITION BY {label_col} ORDER BY {key}, {id_col}) - 1) % {k} "
            f"AS INTEGER)")
