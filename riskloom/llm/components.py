"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type); root is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the links no longer change. The minimum
    of a node's neighbours is aggregated map-side and joined back. The minima are written before each join: both of its sides then come
    from plain shuffles, so adaptive execution (session.py turns its skew join on) splits the partition of a hub's links over tasks,
    which it can't where one side ends in the aggregate. Each round is cut by a reliable checkpoint.
    """
    links = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _digest(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut_lineage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # after large-star every link points from the larger to the smaller node
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        links = cut_lineage(small)
        now = _digest(links)
        if now == state:
            break
        state = now
    heads = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(heads)


def _digest(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
