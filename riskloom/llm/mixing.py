"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its share, by weight, of ``total_share`` times all words, stopped at ``max_epochs`` times the
source's size with the excess reshared (water-filling). A source gives whole epochs first; the rest of its budget is
filled by documents in order of an exponential key -ln(u) / quality, u from a hash of the document, until the prefix sum
of their sizes reaches the budget. The document across the edge is taken if at least half of it fits.

The prefix sums need no sorted source: quantile edges of the key cut a source into slices, slice sums show which one
holds the edge, and that slice is cut again until it is small. Only its rows are sorted.

Defined cases: null or empty text has size 0 and is never sampled in part (epochs of it count no words); a null source
is a source of its own, last in order; rows equal in doc_id, source and text share a key, and any of them may stand for
the others; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut_lineage, md5_bits, row_hash, small, take_rows, words_array

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
SLICES = 256
SORT_ROWS = 2_000
#: Broadcast bound of per-source tables that carry SLICES edges (2 KB a row).
SOURCE_ROWS = 10_000


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.1 and 1: one less the markup symbols per word."""
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, row_hash, source, size (words) and the sampling key of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "source", row_hash().alias("row_hash"), text.alias("text"), F.size(words_array(text)).cast("long").alias("size"))
    bits = md5_bits(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))
    u = (bits.cast("double") + 0.5) / float(1 << 60)
    return df.select("doc_id", "row_hash", "source", "size", (-F.log(u) / quality_weight(F.col("text"), F.col("size"))).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from a table (source, source_size) with one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    df = df.select("*", F.row_number().over(by_ratio).alias("rank"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("full"),
                   F.sum("weight").over(after).alias("open"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    level = (F.col("total") * total_share - F.col("full")) / F.col("open")
    df = df.withColumn("level", level).withColumn("over", F.col("level") * F.col("weight") > F.col("cap"))
    first = F.min(F.when(~F.col("over"), F.struct("rank", "level"))).over(Window.partitionBy())
    df = df.withColumn("first", first)
    stopped = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    target = F.when(stopped, F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return df.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE,
        max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, row_hash, size, source_size, target, epochs, times (epochs and a last part), taken."""
    own = cut_lineage(sized(docs, seed))
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, total_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = cut_lineage(plan)
    edge = _edges(own, plan)
    rows = own.join(small(edge, SOURCE_ROWS).withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")))
    inside = (F.col("size") > 0) & (F.col("key") > F.col("lo")) & (F.col("key") <= F.col("hi"))
    sure = rows.where(~inside).withColumn("extra", (F.col("key") <= F.col("lo")).cast("int"))
    run = Window.partitionBy("source").orderBy("key", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("below") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2
    split = rows.where(inside).withColumn("extra", ((upto <= F.col("budget")) & (F.col("size") > 0)).cast("int"))
    out = sure.unionByName(split)
    times = F.col("epochs") + F.when(F.col("size") > 0, F.col("extra")).otherwise(0)
    return out.withColumn("times", times).select("doc_id", "row_hash", "size", "source_size", "target", "epochs", "times",
                                                 (F.col("times") * F.col("size")).alias("taken"))


def _edges(own: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the slice (lo, hi] of keys that holds the edge of its budget, and the words below it.

    Documents with keys up to ``lo`` are in, those above ``hi`` are out. Each round cuts every slice at SLICES
    quantiles of its keys, until no slice has more than SORT_ROWS rows.
    """
    state = cut_lineage(plan.select("*", F.lit(-1.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below")))
    rows = own.where("size > 0").select(F.col("source").alias("r_source"), "key", "size")
    same = F.col("source").eqNullSafe(F.col("r_source"))
    last = None
    while True:
        inside = rows.join(small(state.select("source", "lo", "hi"), SOURCE_ROWS), same & (F.col("key") > F.col("lo")) & (F.col("key") <= F.col("hi")))
        cuts = F.percentile_approx("key", [k / SLICES for k in range(1, SLICES)], 10 * SLICES)
        cut = cut_lineage(inside.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(cuts).alias("cuts")))
        largest = cut.agg(F.max("n")).first()[0] or 0
        if largest <= SORT_ROWS or largest == last:
            return state
        last = largest
        sliced = inside.select("r_source", "key", "size").join(small(cut, SOURCE_ROWS), same)
        sliced = sliced.withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("key"))))
        sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.max("key").alias("top"), F.min("key").alias("bottom"))
        sums = sums.join(state.select(F.col("source").alias("r_source"), "lo", "hi", "below", "budget"), same)
        run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("below") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        order = Window.partitionBy("source").orderBy("slice")
        sums = sums.withColumn("before", F.lag("top").over(order))
        # the first slice that the budget doesn't cover holds the edge; if it covers all, the last one does
        fit = F.max(F.when(F.col("start") <= F.col("budget"), F.struct("slice", "start", F.coalesce("before", "lo").alias("lo"), "top")))
        narrowed = sums.groupBy("source").agg(fit.alias("s"))
        narrowed = narrowed.select(F.col("source").alias("r_source"), F.col("s.lo").alias("lo2"), F.col("s.top").alias("hi2"), F.col("s.start").alias("below2"))
        state = cut_lineage(state.join(narrowed, same, "left").select(
            "source", "source_size", "target", "epochs", "budget", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"),
            F.coalesce("below2", "below").alias("below")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as the mix takes it."""
    plan = mix(docs, **options).groupBy("row_hash").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.sum("times").cast("int").alias("times"))
    return take_rows(docs, cut_lineage(plan.where("times > 0")))
