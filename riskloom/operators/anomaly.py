"""Anomaly layer (A1-A12): normalisation, detector ensemble, fusion, evaluation.

Fitted state (percentile bounds, medians, IQRs) is a few numbers per column;
``fit`` computes them in one aggregate over the training rows and ``transform``
is a pure projection with literals — no join, no shuffle at scoring time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.exprs import EPS, clip, q
from riskloom.functions.stats import fit_group_quantiles, fit_quantiles

# ---- fixed values (must equal the reference) -------------------------------
W_ISO = 0.30
W_LOF = 0.25
W_AE = 0.45
FUSION_ALPHA = 0.65
DETECTION_THRESHOLDS = [40, 50, 60, 70, 80]


def percentile_normalise(x: Column, p_low: float, p_high: float, invert: bool = False) -> Column:
    """A2: clip((x - lo) / (hi - lo + eps), 0, 1) * 100; invert negates and swaps bounds."""
    if invert:
        x = -x
        p_low, p_high = -p_high, -p_low
    return clip((x - F.lit(p_low)) / F.lit(p_high - p_low + EPS), 0.0, 1.0) * 100.0


@dataclass
class PercentileNormaliserModel:
    bounds: dict[str, tuple[float, float]]
    invert: bool = False
    suffix: str = "_norm"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[
            percentile_normalise(F.col(q(c)), lo, hi, self.invert).alias(c + self.suffix)
            for c, (lo, hi) in self.bounds.items()])


@dataclass
class PercentileNormaliser:
    """A2 estimator: bounds are percentiles ``lo``/``hi`` of the training rows."""
    cols: list[str]
    lo: float = 0.01
    hi: float = 0.99
    invert: bool = False

    def fit(self, train: DataFrame) -> PercentileNormaliserModel:
        qs = fit_quantiles(train, self.cols, [self.lo, self.hi])
        return PercentileNormaliserModel({c: (v[0], v[1]) for c, v in qs.items()}, self.invert)


@dataclass
class RobustScalerModel:
    """A4: (x - median) / IQR per feature (IQR 0 -> 1, as scikit-learn does)."""
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        exprs = {c: ((F.col(q(c)) - F.lit(med)) / F.lit(iqr)) for c, (med, iqr) in self.stats.items()}
        if suffix:
            return df.select("*", *[e.alias(c + suffix) for c, e in exprs.items()])
        return df.withColumns(exprs)


def fit_robust_scaler(train: DataFrame, cols: list[str]) -> RobustScalerModel:
    qs = fit_quantiles(train, cols, [0.25, 0.5, 0.75])
    stats = {}
    for c, (q1, med, q3) in qs.items():
        iqr = (q3 - q1) if q1 is not None else 1.0
        stats[c] = (med if med is not None else 0.0, iqr if iqr != 0 else 1.0)
    return RobustScalerModel(stats)


def fit_impute_medians(train: DataFrame, cols: list[str]) -> dict[str, float]:
    """A1 / M1: median per column over non-null values; all-null column -> 0.0."""
    qs = fit_quantiles(train, cols, [0.5])
    return {c: (v[0] if v[0] is not None else 0.0) for c, v in qs.items()}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(q(c)).cast("double"), F.lit(m))
                           for c, m in medians.items()})


def risk_tier(score: Column) -> Column:
    """A8 fusion tier: >=80 CRITICAL, >=60 HIGH, >=40 MEDIUM, else LOW."""
    return (F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH")
            .when(score >= 40, "MEDIUM").otherwise("LOW"))


def ensemble(df: DataFrame, iso: str = "iso_score", lof: str = "lof_score", ae: str = "ae_score",
             w_iso: float = W_ISO, w_lof: float = W_LOF, w_ae: float = W_AE) -> DataFrame:
    """A7 + A8: weighted detector ensemble clipped to [0,100], label (>=50) and tier."""
    ens = F.lit(w_iso) * F.col(iso) + F.lit(w_lof) * F.col(lof) + F.lit(w_ae) * F.col(ae)
    return (df.withColumn("anomaly_score", clip(ens, 0.0, 100.0))
            .withColumn("anomaly_label", (F.col("anomaly_score") >= 50).cast("int"))
            .withColumn("anomaly_tier", risk_tier(F.col("anomaly_score"))))


def fuse(df: DataFrame, prob: str = "ml_prob", anomaly: str = "anomaly_score",
         alpha: float = FUSION_ALPHA) -> DataFrame:
    """Alpha * clip(100 p) + (1 - alpha) * anomaly; tier / flag use the unclipped value."""
    classif = clip(F.col(prob) * 100, 0.0, 100.0)
    raw = F.lit(alpha) * F.col("classif_score") + F.lit(1 - alpha) * F.col(anomaly)
    return (df.withColumn("classif_score", classif)
            .withColumn("_fusion_raw", raw)
            .withColumn("fusion_score", clip(F.col("_fusion_raw"), 0.0, 100.0))
            .withColumn("risk_tier", risk_tier(F.col("_fusion_raw")))
            .withColumn("is_anomaly", (F.col(anomaly) >= 50).cast("int"))
            .withColumn("is_flagged", (F.col("_fusion_raw") >= 60).cast("int"))
            .drop("_fusion_raw"))


def detection_table(df: DataFrame, score: str = "anomaly_score", label: str = "label",
                    thresholds: list[int] = DETECTION_THRESHOLDS) -> DataFrame:
    """A10: tp / fn / fp / recall / fpr at each threshold.

    One pass: every threshold's counts are conditional sums in a single global
    aggregate (partial per partition, one tiny shuffle), then ``stack`` turns the
    1-row result into one row per threshold — no cross join with the data.
    """
    s, y = F.col(score), F.col(label)
    aggs = [F.sum((y == 0).cast("long")).alias("n_legit")]
    for t in thresholds:
        pred = s >= t
        aggs += [F.sum((pred & (y == 1)).cast("long")).alias(f"tp_{t}"),
                 F.sum((~pred & (y == 1)).cast("long")).alias(f"fn_{t}"),
                 F.sum((pred & (y == 0)).cast("long")).alias(f"fp_{t}")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"{t}, tp_{t}, fn_{t}, fp_{t}" for t in thresholds)
    long = wide.selectExpr("n_legit", f"stack({len(thresholds)}, {parts}) AS (threshold, tp, fn, fp)")
    return long.select(
        F.col("threshold").cast("int").alias("threshold"),
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fn", F.lit(0)).alias("fn"),
        F.coalesce("fp", F.lit(0)).alias("fp"),
        (F.coalesce("tp", F.lit(0)) / (F.coalesce("tp", F.lit(0)) + F.coalesce("fn", F.lit(0)) + EPS))
        .alias("recall"),
        (F.coalesce("fp", F.lit(0)) / (F.coalesce("n_legit", F.lit(0)) + EPS)).alias("fpr"))


def score_histogram(df: DataFrame, score: str, label: str = "label", bins: int = 50,
                    lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Histogram of a [lo,hi] score by class (equal width, last bin right-closed)."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(score) - lo) / width), F.lit(bins - 1)).cast("int")
    return (df.select(F.col(label).alias("label"), b.alias("bin"))
            .groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n")))


def score_summary(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Mean / p50 / p90 / p99 of a score by class."""
    found = fit_group_quantiles(df, label, [score], [0.5, 0.9, 0.99])
    rows = [(g, *own[score]) for g, own in found.items()]   # a row a class
    table = df.sparkSession.createDataFrame(rows, f"l {dict(df.dtypes)[label]}, p50 double, p90 double, p99 double")
    means = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
    return means.join(F.broadcast(table), F.col("label").eqNullSafe(F.col("l"))).drop("l")
