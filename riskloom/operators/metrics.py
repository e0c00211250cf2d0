"""Classifier evaluation (M2, M3, M10-M15, M17, M21) as distributed aggregates.

Everything starts from the *score table*: one row per distinct score with its
positive / negative counts (a map-side partial aggregate, so the shuffle
carries distinct scores, not rows). Curves need running totals over that table
ordered by score; instead of a single-partition window, the distinct scores are
cut at their own quantiles into ``buckets`` ranges (so scores that crowd near 0
spread as well as any), bucket totals give each bucket's offset (a table of
``buckets`` rows), and running sums are taken inside each bucket only.

Average precision is the step sum of sklearn (sum of recall increments times
precision, ties grouped by score) — not the trapezoid of
``BinaryClassificationEvaluator``; ROC-AUC is the rank-sum statistic with
average ranks for ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
MIN_RECALL = 0.80


def score_table(df: DataFrame, score: str, label: str) -> DataFrame:
    y = F.col(label)
    return (df.select(F.col(score).cast("double").alias("s"), y.alias("y"))
            .groupBy("s").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"),
                              F.sum((F.col("y") != 1).cast("long")).alias("neg")))


def _with_bucket(table: DataFrame, buckets: int) -> DataFrame:
    """Adds __b, the number of quantile edges of the distinct scores below ``s`` (monotone in s)."""
    cuts = F.percentile_approx("s", [k / buckets for k in range(1, buckets)], 16 * buckets)
    edges = table.agg(F.array_distinct(cuts).alias("__edges"))   # one row of at most ``buckets`` numbers
    below = F.size(F.filter("__edges", lambda e: e < F.col("s")))
    return table.join(F.broadcast(edges), how="inner").withColumn("__b", below).drop("__edges")


def cumulative(table: DataFrame, buckets: int = 256, descending: bool = True,
               groups: list[str] | None = None) -> DataFrame:
    """Add tp / fp = positives / negatives with score >= s (descending) or <= s,
    within each group (e.g. fold) when ``groups`` is given."""
    g = list(groups or [])
    t = _with_bucket(table, buckets)
    tot = t.groupBy(*g, "__b").agg(F.sum("pos").alias("__bp"), F.sum("neg").alias("__bn"))
    order = F.desc("__b") if descending else F.asc("__b")
    w_off = (Window.partitionBy(*g).orderBy(order) if g else Window.orderBy(order)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    # tot has at most groups x buckets rows: a window over it is bounded
    off = tot.select(*g, "__b", F.coalesce(F.sum("__bp").over(w_off), F.lit(0)).alias("__op"),
                     F.coalesce(F.sum("__bn").over(w_off), F.lit(0)).alias("__on"))
    t = t.join(F.broadcast(off), [*g, "__b"])
    w = (Window.partitionBy(*g, "__b").orderBy(F.desc("s") if descending else F.asc("s"))
         .rowsBetween(Window.unboundedPreceding, 0))
    return (t.withColumn("tp", F.col("__op") + F.sum("pos").over(w))
            .withColumn("fp", F.col("__on") + F.sum("neg").over(w))
            .drop("__b", "__op", "__on"))


def totals(table: DataFrame) -> DataFrame:
    return table.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def pr_curve(df: DataFrame, score: str, label: str, buckets: int = 256) -> DataFrame:
    """Threshold, precision, recall at every distinct score (score >= threshold)."""
    c = cumulative(score_table(df, score, label), buckets)
    t = totals(score_table(df, score, label))
    c = c.join(F.broadcast(t), how="inner")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(1.0)
    return c.select(F.col("s").alias("threshold"), prec.alias("precision"), rec.alias("recall"),
                    "tp", "fp", "P", "N")


def roc_curve(df: DataFrame, score: str, label: str, buckets: int = 256) -> DataFrame:
    """Threshold, fpr, tpr at every distinct score."""
    c = pr_curve(df, score, label, buckets)
    return c.select("threshold", (F.col("fp") / F.col("N")).alias("fpr"),
                    (F.col("tp") / F.col("P")).alias("tpr"))


def binary_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                   buckets: int = 256) -> DataFrame:
    """AP, ROC-AUC, Brier, precision / recall / F1 at ``threshold`` (zero_division 0)."""
    st = score_table(df, score, label)
    cum = cumulative(st, buckets)
    t = totals(st)
    c = cum.join(F.broadcast(t), how="inner")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec_inc = F.when(F.col("P") > 0, F.col("pos") / F.col("P")).otherwise(0.0)
    # AUC: each positive at s beats the negatives strictly below s, ties count one half
    neg_below = F.col("N") - F.col("fp")
    auc_num = F.col("pos") * (neg_below + 0.5 * F.col("neg"))
    agg = c.agg(F.sum(rec_inc * prec).alias("average_precision"),
                F.sum(auc_num).alias("__auc"), F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))
    y = F.col(label).cast("double")
    p = F.col(score).cast("double")
    pred = p >= threshold
    pt = df.agg(F.avg((p - y) * (p - y)).alias("brier"),
                F.sum((pred & (y == 1)).cast("long")).alias("tp"),
                F.sum((pred & (y != 1)).cast("long")).alias("fp"),
                F.sum((~pred & (y == 1)).cast("long")).alias("fn"))
    out = agg.join(pt, how="inner")
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return (out.select("average_precision",
                       (F.col("__auc") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                       "brier", precision.alias("precision"), recall.alias("recall"), "n_pos", "n_neg")
            .withColumn("f1", f1))


def optimal_threshold(df: DataFrame, score: str, label: str, min_recall: float = MIN_RECALL,
                      buckets: int = 256) -> DataFrame:
    """Argmax F1 (eps in denominator) among thresholds with recall >= min_recall,
    else argmax F1 overall; the lowest threshold wins ties."""
    c = pr_curve(df, score, label, buckets)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS)
    c = c.withColumn("f1", f1).withColumn("valid", (F.col("recall") >= min_recall).cast("int"))
    any_valid = c.agg(F.max("valid").alias("any_valid"))
    key = F.when(F.col("any_valid") == 1, F.col("f1") * F.col("valid")).otherwise(F.col("f1"))
    ranked = c.join(F.broadcast(any_valid), how="inner").withColumn("__k", key)
    return (ranked.orderBy(F.desc("__k"), F.asc("threshold")).limit(1)
            .select("threshold", "f1", "precision", "recall"))


def confusion(df: DataFrame, score: str, label: str, threshold: Column | float) -> DataFrame:
    """Tn, fp, fn, tp at a threshold (score >= threshold is positive)."""
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= th
    y = F.col(label) == 1
    return df.agg(F.sum((~pred & ~y).cast("long")).alias("tn"), F.sum((pred & ~y).cast("long")).alias("fp"),
                  F.sum((~pred & y).cast("long")).alias("fn"), F.sum((pred & y).cast("long")).alias("tp"))


# np.linspace(0, 1, 11)[1:-1] — the inner calibration edges, as numpy computes them

def calibration_bins(df: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    """Uniform bins; bin = number of inner edges strictly below p; empty bins omitted."""
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    p = F.col(score).cast("double")
    b = sum(((F.lit(e) < p).cast("int") for e in edges), F.lit(0))
    return (df.select(b.alias("bin"), p.alias("p"), F.col(label).cast("double").alias("y"))
            .groupBy("bin").agg(F.avg("y").alias("prob_true"), F.avg("p").alias("prob_pred"),
                                F.count(F.lit(1)).alias("n")))


def linspace(start: float, stop: float, num: int) -> list[float]:
    """numpy.linspace values (step = delta / (num - 1); last point set to stop)."""
    step = (stop - start) / (num - 1)
    out = [i * step + start for i in range(num)]
    out[-1] = stop
    return out


def threshold_sweep(df: DataFrame, score: str, label: str, start: float = 0.01, stop: float = 0.99,
                    num: int = 200) -> DataFrame:
    """Precision / recall / F1 at each grid threshold (zero_division 0).

    No cross join with the grid: each row finds its grid index (number of grid
    points <= score) with a floor estimate corrected against the literal grid,
    counts are aggregated per index (num + 1 rows), and suffix sums over that
    tiny table give the counts at every threshold.
    """
    grid = linspace(start, stop, num)
    step = (stop - start) / (num - 1)
    arr = F.array(*[F.lit(g) for g in grid])
    s = F.col("s")
    est = F.least(F.greatest(F.floor((s - start) / step) + 1, F.lit(0)), F.lit(num)).cast("int")
    # correct the estimate: idx = #{g : g <= s}
    up = F.when((F.col("__e") < num) & (s >= F.try_element_at(arr, F.col("__e") + 1)), 1).otherwise(0)
    down = F.when((F.col("__e") > 0) & (s < F.try_element_at(arr, F.greatest(F.col("__e"), F.lit(1)))), 1).otherwise(0)
    rows = (df.select(F.col(score).cast("double").alias("s"), F.col(label).alias("y")).withColumn("__e", est)
            .withColumn("idx", F.col("__e") + up - down)
            .groupBy("idx").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"),
                                F.sum((F.col("y") != 1).cast("long")).alias("neg")))
    spark = df.sparkSession
    g = spark.createDataFrame([(i, v) for i, v in enumerate(grid)], "i int, threshold double")
    # rows with idx >= i + 1 have score >= grid[i]; both tables are <= num + 1 rows
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    per = g.join(rows.withColumnRenamed("idx", "i1"), F.col("i1") == F.col("i") + 1, "left") \
        .select("i", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    tot = rows.agg(F.sum("pos").alias("P"))
    c = (per.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
         .join(F.broadcast(tot), how="inner"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0)
    out = c.select("threshold", precision.alias("precision"), recall.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """M2: n_neg / max(n_pos, 1)."""
    return (df.agg(F.sum((F.col(label) == 1).cast("long")).alias("n_pos"), F.count(F.lit(1)).alias("n"))
            .select("n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"),
                    ((F.col("n") - F.col("n_pos")) / F.greatest(F.col("n_pos"), F.lit(1))).alias("scale_pos_weight")))


def fold_metrics(df: DataFrame, score: str, label: str, fold: str, min_recall: float = MIN_RECALL) -> DataFrame:
    """Per-fold AP / ROC-AUC / Brier and, at the fold's own M12 threshold, precision / recall / F1 (OOF evaluation).
    The score table is grouped by (fold, score); running sums per fold use the
    bucketed offsets, so no window holds a whole fold."""
    st = (df.select(F.col(fold).alias("fold"), F.col(score).cast("double").alias("s"), F.col(label).alias("y"))
          .groupBy("fold", "s").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"),
                                    F.sum((F.col("y") != 1).cast("long")).alias("neg")))
    tot = st.groupBy("fold").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = cumulative(st, groups=["fold"]).join(F.broadcast(tot), "fold")   # tot: one row per fold
    c = c.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    c = c.withColumn("recall", F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(1.0))
    ranking = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS)
    order = F.struct((F.col("recall") < min_recall).cast("int"), -ranking, F.col("s"))
    per = c.groupBy("fold").agg(
        F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P")).otherwise(0.0) * F.col("precision")).alias("pr_auc"),
        (F.sum(F.col("pos") * (F.col("N") - F.col("fp") + 0.5 * F.col("neg"))) / (F.first("P") * F.first("N"))).alias("roc_auc"),
        F.min_by(F.struct(F.col("s").alias("threshold"), "precision", "recall"), order).alias("best"))
    y = F.col(label).cast("double")
    p = F.col(score).cast("double")
    brier = df.groupBy(F.col(fold).alias("fold")).agg(F.avg((p - y) * (p - y)).alias("brier"))
    out = per.join(brier, "fold").select("fold", "pr_auc", "roc_auc", "brier", "best.threshold", "best.precision", "best.recall")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def cv_summary(per_fold: DataFrame, metrics=("f1", "recall", "precision", "roc_auc", "pr_auc")) -> DataFrame:
    """Mean and std (ddof 0) of each metric over folds, one row per metric."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}__mean"), F.stddev_pop(m).alias(f"{m}__std")]
    wide = per_fold.agg(*aggs)
    parts = ", ".join(f"'{m}', {m}__mean, {m}__std" for m in metrics)
    return wide.selectExpr(f"stack({len(metrics)}, {parts}) AS (metric, mean, std)")
