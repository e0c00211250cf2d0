"""Sharding by extendible hashing.

A document hashes to 60 bits of the MD5 of its id and text. A directory is indexed by hash-prefix bits; a bucket whose
documents exceed the byte limit splits on the next bit, and only such buckets do, until every shard fits. Each round
sums bytes by a prefix a few bits longer than the last (map-side), rolls the sums up to every shorter prefix, and gives
each cell the shortest prefix that fits. Cells that fit nowhere go on to the next round, so the work after the first
round is that of the oversized buckets alone.

Defined cases: a document larger than the limit ends in a shard of its own; rows equal in id and text cannot be told
apart by a hash and stay together (``oversize`` marks both kinds); null text has no bytes; extra columns are ignored; an
empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut_lineage, md5_bits, small, whole_row

BITS = 60
SHARD_BYTES = 1 << 20
STEP = 6


def shard_hash() -> Column:
    return md5_bits(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("bytes"), shard_hash().alias("hash"))


def assign(keys: DataFrame, limit: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """``keys`` (materialised; hash, bytes, any other columns) with shard, depth, shard_bytes, shard_docs, oversize."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    base, depth = 0, min(BITS, max(1, math.ceil(math.log2(max(2, total / limit))) + 2))
    rest, done = keys, []
    while True:
        cell = F.shiftright("hash", BITS - depth)
        cells = cut_lineage(rest.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("cell_bytes"), F.count(F.lit(1)).alias("cell_docs")))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(depth))))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("cell_bytes").alias("shard_bytes"), F.sum("cell_docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS)
        shortest = levels.join(buckets.where(fits), ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        leaf = cut_lineage(cells.select("cell").join(shortest, "cell", "left"))
        placed = rest.withColumn("cell", cell).join(small(leaf.where("s is not null")), "cell")
        done.append(placed.drop("cell"))
        open_cells = leaf.where("s is null").select("cell")
        if open_cells.isEmpty():
            break
        rest = cut_lineage(rest.withColumn("cell", cell).join(small(open_cells), "cell").drop("cell"))
        base, depth = depth + 1, min(BITS, depth + step)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    bits = F.when(F.col("s.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(s.prefix), s.depth, '0')"))
    return out.select(*[c for c in out.columns if c != "s"], bits.alias("shard"), F.col("s.depth").alias("depth"), F.col("s.shard_bytes").alias("shard_bytes"),
                      F.col("s.shard_docs").alias("shard_docs"), (F.col("s.shard_bytes") > limit).alias("oversize"))


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, bytes, shard (its hash-prefix bits), depth, shard_bytes, shard_docs, oversize."""
    return assign(cut_lineage(hashed(docs)), limit).drop("hash")


def sharded(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """All columns of ``docs`` and a struct ``shard_info`` (shard, depth, shard_bytes, shard_docs, oversize; replaces any there)."""
    docs = docs.drop("shard_info")
    keys = cut_lineage(hashed(docs).drop("doc_id"))
    place = assign(keys, limit).groupBy("hash").agg(F.first(F.struct("shard", "depth", "shard_bytes", "shard_docs", "oversize")).alias("info"))
    rows = docs.select(whole_row(docs), shard_hash().alias("row_key"))
    rows = rows.join(small(cut_lineage(place)), F.col("row_key") == F.col("hash"))
    return rows.select("row.*", F.col("info").alias("shard_info"))
