"""Feature engineering stages F1-F9 (+ F11 orchestration) as fit/transform pairs.

Every ``transform`` is a single projection over the input rows (row-wise
statistics use array higher-order functions: ``filter`` / ``aggregate`` /
``array_sort``), so it runs inside whole-stage codegen with no shuffle.
Lookups with unbounded cardinality (frequency and target encodings, date
cohort counts) are small *lookup DataFrames* joined back by key; they are
broadcast only when their row count is checked to be under
``BROADCAST_ROWS``, otherwise Spark shuffles them like any other join.
Fitted scalars (quantiles, means, thresholds) are inlined as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.exprs import EPS, col_sum, greatest, least, q
from riskloom.functions.stats import fit_quantiles
from riskloom.functions.topk import global_rank
from riskloom.session import cut_lineage

BROADCAST_ROWS = 1_000_000
REFERENCE_DATE = "2026-01-01"
DATE_FORMAT = "M-d-yyyy"

# ---- fixed values (must equal the reference) -------------------------------
ACCT_TYPE_RISK = {"Savings": 0.3, "Current": 0.5, "Basic Current": 0.8, "Student": 0.7,
                  "Joint": 0.4, "Business": 0.6, "Premium": 0.2}
EMPLOYMENT_RISK = {"selfemployed": 0.5, "student": 0.7, "unemployed": 0.8, "employed": 0.2,
                   "retired": 0.3, "parttime": 0.5, "other": 0.6}
CHANNEL_RISK = {"RETAIL": 0.3, "DIGITAL": 0.5, "MOBILE": 0.6, "THIRD_PARTY": 0.9, "ATM": 0.4}
RISK_PROFILE_WEIGHTS = {"te_mean_risk": 0.25, "out_outlier_rate": 0.20,
                        "beh_flow_imbalance": 0.20, "freq_rarity_score": 0.20,
                        "mv_missing_block_score": 0.15}
RISK_FLAGS = ["risk_new_acct_flag", "risk_batch_open_flag", "risk_synthetic_id_flag",
              "risk_flow_thru_flag", "risk_outlier_heavy_flag"]


def category_table(df: DataFrame, cols: list[str], aggs: list[Column], extra: list[str] | None = None) -> DataFrame:
    """One row per (column name, value) — and per value of the ``extra`` columns — with aggregates of its rows: the categories of
    all columns in one scan, combined before the shuffle, and checkpointed, for several joins read it."""
    extra = extra or []
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(q(c)).cast("string").alias("value")) for c in cols]))
    kept = [F.col(q(f.name)) for f in df.schema.fields if f.name in extra or f.name == "y"]
    return cut_lineage(df.select(*kept, cells.alias("c")).select("*", "c.*").drop("c").filter(F.col("value").isNotNull())
                       .groupBy("col", "value", *extra).agg(*aggs))


def column_sizes(table: DataFrame) -> dict[str, int]:
    """Rows per column name of a category table (one number a column)."""
    return {r["col"]: r["count"] for r in table.groupBy("col").count().collect()}


def lookup_join(df: DataFrame, lookup: DataFrame, on, n_rows: int | None = None,
                how: str = "left") -> DataFrame:
    """Join a fitted lookup table; broadcast only if its checked row count is small."""
    n = lookup.count() if n_rows is None else n_rows
    side = F.broadcast(lookup) if n <= BROADCAST_ROWS else lookup
    return df.join(side, on, how)


_VARIANCE_MEMO: WeakKeyDictionary[DataFrame, dict[tuple[str, ...], list[str]]] = WeakKeyDictionary()


def top_variance(df: DataFrame, cols: list[str], n: int) -> list[str]:
    """Top-n columns by sample variance (desc; NULL variance last; ties by name).
    Several stages rank the same candidates of the same input: the ranking is
    computed once per (input, candidate list) and reused."""
    if not cols:
        return []
    memo, key = _VARIANCE_MEMO.setdefault(df, {}), tuple(cols)
    if key not in memo:
        row = df.agg(*[F.var_samp(F.col(q(c)).cast("double")).alias(c) for c in cols]).first()
        order = [(0 if row[c] is not None else 1, -(row[c] or 0.0), c) for c in cols]
        memo[key] = [c for _, _, c in sorted(order)]
    return memo[key][:n]


def _equals(i: int):
    """Single-argument predicate (a two-argument lambda would receive the index)."""
    return lambda x: x == i


def row_array(cols: list[str]) -> Column:
    return F.array(*[F.col(q(c)).cast("double") for c in cols])


def nn(arr: Column) -> Column:
    """Finite (non-NULL) elements — NaN is normalised to NULL at ingest."""
    return F.filter(arr, lambda x: x.isNotNull())


def arr_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def arr_mean(vals: Column) -> Column:
    return F.when(F.size(vals) > 0, arr_sum(vals) / F.size(vals))


def arr_central(vals: Column, mean: Column, k: int) -> Column:
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0),
                                                  lambda a, x: a + F.pow(x - mean, k)) / F.size(vals))


def arr_median(vals: Column) -> Column:
    s = F.array_sort(vals)
    n = F.size(s)
    odd = F.element_at(s, ((n + 1) / 2).cast("int"))
    even = (F.element_at(s, (n / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, odd).otherwise(even)


# ---- F1 missing-value features -----------------------------------------------

@dataclass
class MissingModel:
    cols: list[str]
    indicator_cols: list[str]
    weights: dict[str, float]
    edges: list[float]

    def transform(self, df: DataFrame, with_indicators: bool = True) -> DataFrame:
        miss = [F.col(q(c)).isNull().cast("int") for c in self.cols]
        cnt = col_sum(miss)
        rate = cnt / float(len(self.cols))
        wsum = sum(self.weights.values())
        if wsum > 0:
            block = col_sum([F.col(q(c)).isNull().cast("double") * F.lit(self.weights[c])
                             for c in self.indicator_cols]) / F.lit(wsum + EPS)
        else:
            block = F.lit(0.0)
        edges = sorted(set(self.edges))
        if len(edges) >= 2:
            below = col_sum([(F.lit(e) < F.col("mv_row_missing_rate")).cast("int") for e in edges])
            cluster = F.greatest(below - 1, F.lit(0))
        else:
            cluster = F.lit(0)
        indicators = {f"{c}_is_missing": F.col(q(c)).isNull().cast("int") for c in self.indicator_cols} if with_indicators else {}
        out = df.withColumns({"mv_row_missing_count": cnt, "mv_row_missing_rate": rate, "mv_has_any_missing": (cnt > 0).cast("int"),
                              "mv_missing_block_score": block, **indicators})
        return out.withColumn("mv_col_miss_cluster", cluster.cast("int"))


@dataclass
class MissingFeatures:
    """F1: row missing count/rate, weighted block score, indicators, rate quintile."""
    cols: list[str]
    target_col: str | None = "label"
    low: float = 0.01
    high: float = 0.95

    def fit(self, df: DataFrame) -> MissingModel:
        aggs = [F.avg(F.col(q(c)).isNull().cast("double")).alias(f"r__{c}") for c in self.cols]
        if self.target_col:
            pos = F.col(self.target_col) == 1
            aggs += [F.avg(F.when(pos, F.col(q(c)).isNull().cast("double"))).alias(f"m__{c}")
                     for c in self.cols]
        row = df.agg(*aggs).first()
        ind = [c for c in self.cols if self.low <= row[f"r__{c}"] <= self.high]
        if self.target_col:
            w = {c: (row[f"m__{c}"] if row[f"m__{c}"] is not None else 0.0) for c in ind}
        else:
            w = {c: 1.0 for c in ind}
        # quintile edges of the row missing rate over this batch (exact, few distinct values)
        rate = col_sum([F.col(q(c)).isNull().cast("int") for c in self.cols]) / float(len(self.cols))
        edges = fit_quantiles(df.select(rate.alias("r")), ["r"], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])["r"]
        return MissingModel(self.cols, ind, w, [e for e in edges if e is not None])


# ---- F2 frequency encoding ---------------------------------------------------

def frequency_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """col, value, freq (share among the column's non-null rows), rank (count desc, value asc) for all columns at once.

    One global rank over (column, count, value), range-partitioned, less the number of values of the columns before: no task
    ranks a whole column, however many values it has."""
    counts = category_table(df, cols, [F.count(F.lit(1)).alias("cnt")])
    totals = sorted(counts.groupBy("col").agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("values")).collect(), key=lambda r: r["col"].encode())
    before, at = [], 0
    for r in totals:   # a row a column
        before.append((r["col"], r["rows"], at))
        at += r["values"]
    offsets = df.sparkSession.createDataFrame(before, "c string, rows long, before int")
    ranked = global_rank(counts, [F.col("col"), F.desc("cnt"), F.col("value")])
    return cut_lineage(ranked.join(F.broadcast(offsets), F.col("col") == F.col("c")).select(
        "col", "value", (F.col("cnt") / F.col("rows")).alias("freq"), (F.col("rank") - F.col("before")).alias("rank")))


def category_join(df: DataFrame, table: DataFrame, c: str, fields: dict[str, str], size: int | None) -> DataFrame:
    """``df`` with the fields (name in the table -> name given) of the value that column ``c`` has in the row."""
    own = table.filter(F.col("col") == c).select(F.col("value").alias("__value"), *[F.col(k).alias(v) for k, v in fields.items()])
    return lookup_join(df, own, F.col(q(c)).cast("string") == F.col("__value"), size or 0).drop("__value")


@dataclass
class FrequencyModel:
    cols: list[str]
    table: DataFrame
    sizes: dict[str, int]
    rare_threshold: float = 0.01

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.cols:
            out = category_join(out, self.table, c, {"freq": "__freq", "rank": "__rank"}, self.sizes.get(c))
            freq = F.coalesce("__freq", F.lit(0.0))
            out = out.withColumns({f"{c}_freq": freq, f"{c}_freq_rank": F.coalesce("__rank", F.lit(9999)),
                                   f"{c}_is_rare": (freq < self.rare_threshold).cast("int")}).drop("__freq", "__rank")
        if self.cols:
            out = out.withColumns({"freq_composite": col_sum([F.col(q(f"{c}_freq")) for c in self.cols]) / len(self.cols),
                                   "freq_rarity_score": col_sum([F.col(q(f"{c}_is_rare")) for c in self.cols])})
        return out


@dataclass
class FrequencyEncoder:
    """F2: ``{c}_freq``, ``_freq_rank``, ``_is_rare``; unseen/NULL -> 0.0 / 9999."""
    cat_cols: list[str]
    rare_threshold: float = 0.01

    def fit(self, df: DataFrame) -> FrequencyModel:
        table = frequency_table(df, self.cat_cols)
        return FrequencyModel(self.cat_cols, table, column_sizes(table), self.rare_threshold)


# ---- F3 target encoding ------------------------------------------------------

@dataclass
class TargetModel:
    cols: list[str]
    table: DataFrame
    sizes: dict[str, int]
    global_mean: float

    def transform(self, df: DataFrame) -> DataFrame:
        g = self.global_mean
        out = df
        for c in self.cols:
            out = category_join(out, self.table, c, {"te": "__te"}, self.sizes.get(c))
            te = F.coalesce("__te", F.lit(g))
            out = out.withColumns({f"{c}_te": te, f"{c}_te_deviation": te - F.lit(g), f"{c}_te_high_risk": (te > 2 * g).cast("int")}).drop("__te")
        return add_te_composites(out, [f"{c}_te" for c in self.cols])


def add_te_composites(df: DataFrame, te_cols: list[str]) -> DataFrame:
    if not te_cols:
        return df
    te = [F.col(c) for c in te_cols]
    return df.withColumns({"te_mean_risk": col_sum(te) / len(te), "te_max_risk": greatest(te), "te_risk_spread": greatest(te) - least(te)})


@dataclass
class TargetEncoder:
    """smoothed mean ``(n*mean + k*g) / (n + k)``; unseen/NULL -> g."""
    cat_cols: list[str]
    target_col: str = "label"
    smoothing: float = 20.0

    def fit(self, df: DataFrame) -> TargetModel:
        y = df.withColumn("y", F.col(q(self.target_col)).cast("double"))
        g, k = y.agg(F.avg("y")).first()[0], self.smoothing
        stats = category_table(y, self.cat_cols, [F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")])
        table = stats.select("col", "value", ((F.col("n") * F.col("m") + F.lit(k * g)) / (F.col("n") + k)).alias("te"))
        return TargetModel(self.cat_cols, table, column_sizes(stats), g)


def oof_target_encode(df: DataFrame, cat_cols: list[str], fold_col: str, target_col: str = "label",
                      smoothing: float = 20.0) -> DataFrame:
    """F3d: out-of-fold target encoding without a per-fold loop.

    Stats of "all other folds" = total stats - this fold's stats, from one
    ``groupBy(value, fold)`` aggregate; one keyed join per column brings them back.
    The prior g_f is the target mean outside fold f.
    """
    y = F.col(target_col).cast("double")
    fold_stats = df.groupBy(fold_col).agg(F.count(F.lit(1)).alias("fn"), F.sum(y).alias("fs"))
    tot = df.agg(F.count(F.lit(1)).alias("tn"), F.sum(y).alias("ts"))
    prior = (fold_stats.join(F.broadcast(tot), how="inner")
             .select(fold_col, ((F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn"))).alias("__g")))
    out = df.join(F.broadcast(prior), fold_col, "left")
    # (column, value, fold) statistics of all columns: one scan, one checkpoint
    per = category_table(df.withColumn("y", y), cat_cols, [F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")], [fold_col])
    w, sizes = Window.partitionBy("col", "value"), column_sizes(per)
    other = per.select("col", "value", F.col(fold_col).alias("__fold"), (F.sum("n").over(w) - F.col("n")).alias("__n"), (F.sum("s").over(w) - F.col("s")).alias("__s"))
    for c in cat_cols:
        own = other.filter(F.col("col") == c).select(F.col("value").alias("__value"), "__fold", "__n", "__s")
        out = lookup_join(out, own, (F.col(q(c)).cast("string") == F.col("__value")) & (F.col(fold_col) == F.col("__fold")), sizes.get(c, 0))
        te = F.when(F.col("__n") > 0, (F.col("__s") + F.lit(smoothing) * F.col("__g")) / (F.col("__n") + smoothing)).otherwise(F.col("__g"))
        out = out.withColumn(f"{c}_te_oof", te).drop("__value", "__fold", "__n", "__s")
    return out.drop("__g")


# ---- F4 date features ----------------------------------------------------------

@dataclass
class DateModel:
    date_col: str
    date_counts: DataFrame
    month_counts: DataFrame
    n_dates: int
    n_months: int
    mean: float
    std: float
    reference_date: str = REFERENCE_DATE

    def transform(self, df: DataFrame) -> DataFrame:
        d = F.try_to_date(F.col(q(self.date_col)), DATE_FORMAT)
        dow = F.weekday(d)
        days = F.datediff(F.to_date(F.lit(self.reference_date)), d)
        bucket = (F.when(days.isNull(), -1).when((days > -1) & (days <= 90), 0)
                  .when((days > 90) & (days <= 365), 1).when((days > 365) & (days <= 1095), 2)
                  .when((days > 1095) & (days <= 3650), 3).when(days > 3650, 4).otherwise(-1))
        out = df.select(
            "*", d.alias("__d"),
            F.coalesce(F.year(d), F.lit(-1)).alias("date_open_year"),
            F.coalesce(F.month(d), F.lit(-1)).alias("date_open_month"),
            F.coalesce(F.dayofmonth(d), F.lit(-1)).alias("date_open_day"),
            F.coalesce(dow, F.lit(-1)).alias("date_open_dayofweek"),
            F.coalesce(F.quarter(d), F.lit(-1)).alias("date_open_quarter"),
            F.coalesce(dow >= 5, F.lit(False)).cast("int").alias("date_open_is_weekend"),
            F.coalesce(F.dayofmonth(d) >= 28, F.lit(False)).cast("int").alias("date_open_is_month_end"),
            F.coalesce(F.dayofmonth(d) <= 3, F.lit(False)).cast("int").alias("date_open_is_month_start"),
            F.coalesce(days, F.lit(-1)).alias("account_age_days"),
            F.coalesce(days / 365.25, F.lit(-1.0)).alias("account_age_years"),
            bucket.alias("account_age_bucket"))
        dc = self.date_counts.select(F.col("d").alias("__dk"), F.col("cnt").alias("__dc"))
        mc = self.month_counts.select(F.col("m").alias("__mk"), F.col("cnt").alias("__mc"))
        out = lookup_join(out, dc, F.col("__d") == F.col("__dk"), self.n_dates)
        out = lookup_join(out, mc, F.date_trunc("month", F.col("__d")).cast("date") == F.col("__mk"), self.n_months)
        denom = self.std if self.std and self.std > 0 else 1.0
        same_date = F.coalesce(F.col("__dc"), F.lit(1))
        return (out.withColumns({"date_open_same_date_count": same_date, "date_open_same_month_count": F.coalesce(F.col("__mc"), F.lit(1)),
                                 "date_open_cohort_risk": (same_date - F.lit(self.mean)) / F.lit(denom)})
                .drop("__d", "__dk", "__dc", "__mk", "__mc"))


@dataclass
class DateFeatures:
    """calendar parts, age, age bucket, same-date / same-month cohort counts."""
    date_col: str = "open_date"
    reference_date: str = REFERENCE_DATE

    def fit(self, df: DataFrame) -> DateModel:
        d = df.select(F.try_to_date(F.col(q(self.date_col)), DATE_FORMAT).alias("d")).filter(F.col("d").isNotNull())
        dc = cut_lineage(d.groupBy("d").agg(F.count(F.lit(1)).alias("cnt")))
        mc = cut_lineage(dc.groupBy(F.date_trunc("month", "d").cast("date").alias("m")).agg(F.sum("cnt").alias("cnt")))
        st = dc.agg(F.avg("cnt").alias("m"), F.stddev_pop("cnt").alias("s"), F.count(F.lit(1)).alias("n")).first()
        mean = st["m"] if st["m"] is not None else 1.0
        std = st["s"] if st["s"] is not None else 1.0
        return DateModel(self.date_col, dc, mc, st["n"], mc.count(), mean, std, self.reference_date)


# ---- F5 ratio features -------------------------------------------------------

@dataclass
class RatioModel:
    cols: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        arr = row_array(self.cols)
        vals = nn(arr)
        n = float(len(self.cols))
        # the mean is a column of its own: inside the lambda it would be taken anew for each element
        out = df.select("*", vals.alias("__v"))
        v = F.col("__v")
        out = out.select("*", arr_mean(v).alias("__m"))
        mean = F.col("__m")
        std0 = F.sqrt(arr_central(v, mean, 2))
        mx, mn = F.array_max(v), F.array_min(v)
        med = arr_median(v)
        nonzero = F.size(F.filter(arr, lambda x: x.isNull() | (x != 0)))
        pos = F.size(F.filter(v, lambda x: x > 0))
        neg = F.size(F.filter(v, lambda x: x < 0))
        return out.withColumns({"ratio_numeric_cv": std0 / (F.abs(mean) + EPS), "ratio_top_to_median": mx / (F.abs(med) + EPS),
                                "ratio_nonzero_fraction": nonzero / (n + EPS), "ratio_pos_to_neg": pos / (neg + EPS),
                                "ratio_extreme_range": (mx - mn) / (F.abs(mean) + EPS)}).drop("__v", "__m")


@dataclass
class RatioFeatures:
    """row statistics over the top-N variance columns."""
    candidates: list[str]
    top_n: int = 200

    def fit(self, df: DataFrame) -> RatioModel:
        return RatioModel(top_variance(df, self.candidates, self.top_n))


# ---- F6 interactions -----------------------------------------------------------

@dataclass
class InteractionModel:
    cols: list[str]
    te_cols: list[str]
    sum_order: list[str] = field(default_factory=list)

    def pairs(self) -> list[tuple[str, str]]:
        """Names and SQL expressions (hundreds: as text they cost one call each)."""
        def value(c: str) -> str:
            return f"CAST({q(c)} AS DOUBLE)"

        out = []
        for i, a in enumerate(self.cols):
            for b in self.cols[i + 1:]:
                out.append((f"interact_{a}_x_{b}", f"{value(a)} * {value(b)}"))
                out.append((f"interact_{a}_diff_{b}", f"{value(a)} - {value(b)}"))
        for i, a in enumerate(self.te_cols):
            for b in self.te_cols[i + 1:]:
                out.append((f"te_interact_{a}_x_{b}", f"{value(a)} * {value(b)}"))
        if self.cols:
            known = f"filter(array({', '.join(value(c) for c in self.sum_order or self.cols)}), x -> x IS NOT NULL)"
            out.append(("interact_sum_top", f"aggregate({known}, 0.0D, (a, x) -> a + x)"))
            out.append(("interact_sum_sq_top", f"aggregate({known}, 0.0D, (a, x) -> a + x * x)"))
        return out

    def feature_names(self) -> list[str]:
        return [n for n, _ in self.pairs()]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.selectExpr("*", *[f"{e} AS {q(n)}" for n, e in self.pairs()])


@dataclass
class InteractionFeatures:
    """pairwise products / differences of the top-k variance columns, TE products."""
    candidates: list[str]
    te_cols: list[str] = field(default_factory=list)
    top_k: int = 15

    def fit(self, df: DataFrame) -> InteractionModel:
        cand = [c for c in self.candidates if not c.startswith(("mv_", "ratio_")) and "_is_missing" not in c]
        top = top_variance(df, cand, self.top_k)
        return InteractionModel(top, self.te_cols, [c for c in cand if c in top])


# ---- F7 outliers -----------------------------------------------------------------

@dataclass
class OutlierModel:
    stats: dict[str, tuple[float, float, float, float]]   # q1, q3, mean, std
    z: float = 3.0

    def transform(self, df: DataFrame, with_flags: bool = True) -> DataFrame:
        iqr_f, z_f, zabs = {}, {}, []
        for c, (q1, q3, mean, std) in self.stats.items():
            x = F.col(q(c)).cast("double")
            iqr = q3 - q1
            lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
            iqr_f[f"{c}_iqr_outlier"] = F.coalesce((x < lo) | (x > hi), F.lit(False)).cast("int")
            zc = (x - F.lit(mean)) / F.lit(std)
            z_f[f"{c}_zscore_outlier"] = F.coalesce(F.abs(zc) > self.z, F.lit(False)).cast("int")
            zabs.append(F.abs(zc))
        n = len(self.stats)
        out = df.withColumns({**iqr_f, **z_f}) if with_flags else df.select("*", *[e.alias(k) for k, e in {**iqr_f, **z_f}.items()])
        out = out.withColumns({"out_iqr_count": col_sum([F.col(q(k)) for k in iqr_f]), "out_zscore_count": col_sum([F.col(q(k)) for k in z_f]),
                               "out_max_zscore": greatest(zabs)})
        total = F.col("out_iqr_count") + F.col("out_zscore_count")
        out = out.withColumns({"out_total_flag_count": total, "out_outlier_rate": total / (2 * n + EPS), "out_composite_score": total / (2 * n + EPS)})
        if not with_flags:
            out = out.drop(*iqr_f, *z_f)
        return out


@dataclass
class OutlierFeatures:
    """IQR (1.5) and z-score (3) flags on the top-N variance columns; counts, rate."""
    candidates: list[str]
    top_n: int = 100
    z: float = 3.0

    def fit(self, df: DataFrame) -> OutlierModel:
        cols = top_variance(df, self.candidates, self.top_n)
        qs = fit_quantiles(df, cols, [0.25, 0.75])
        row = df.agg(*[F.avg(F.col(q(c))).alias(f"m__{c}") for c in cols],
                     *[F.stddev_samp(F.col(q(c))).alias(f"s__{c}") for c in cols]).first()
        stats = {}
        for c in cols:
            s = row[f"s__{c}"]
            s = EPS if (s is None or s == 0) else s
            stats[c] = (qs[c][0], qs[c][1], row[f"m__{c}"], s)
        return OutlierModel({c: v for c, v in stats.items() if v[0] is not None}, self.z)


# ---- F8 behaviour ------------------------------------------------------------------

@dataclass
class BehaviourModel:
    cols: list[str]
    pop_mean: float
    pop_std: float
    acct_col: str | None = None
    employment_col: str | None = None
    channel_col: str | None = None
    bins: int = 10

    def transform(self, df: DataFrame) -> DataFrame:
        arr = row_array(self.cols)
        n = float(len(self.cols))
        out = df.select("*", nn(arr).alias("__v"))
        v = F.col("__v")
        k = F.size(v)
        mean = F.col("beh_row_mean")
        m2 = arr_central(v, mean, 2)
        m3 = arr_central(v, mean, 3)
        m4 = arr_central(v, mean, 4)
        pos = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x > 0, x).otherwise(0.0))
        neg = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x < 0, x).otherwise(0.0))
        # the ends are columns of their own: inside the lambda they would be taken anew for each element
        out = out.select("*", F.array_min(v).alias("__lo"), F.array_max(v).alias("__hi"))
        lo, hi = F.col("__lo"), F.col("__hi")
        b = F.transform(v, lambda x: F.when(hi == lo, F.lit(self.bins // 2)).otherwise(
            F.least(F.floor((x - lo) * self.bins / (hi - lo)), F.lit(self.bins - 1))))
        ent_terms = []
        for i in range(self.bins):
            cnt = F.size(F.filter(F.col("__b"), _equals(i)))
            p = cnt / (k + EPS)
            ent_terms.append(F.when(cnt > 0, -p * F.log2(p + 1e-12)).otherwise(0.0))
        out = out.withColumns({"beh_row_mean": arr_mean(v), "beh_positive_sum": pos, "beh_negative_sum": neg, "__b": b,
                               "beh_zero_fraction": F.size(F.filter(v, lambda x: x == 0)) / (n + EPS), "beh_distinct_values": F.size(F.array_distinct(v))})
        inflow, outflow = F.abs("beh_positive_sum"), F.abs("beh_negative_sum")
        new = {"beh_row_std": F.sqrt(m2), "beh_row_skew": F.when(k > 2, F.try_divide(m3, F.pow(m2, 1.5))).otherwise(0.0),
               "beh_row_kurtosis": F.when(k > 3, F.try_divide(m4, m2 * m2) - 3.0).otherwise(0.0),
               "beh_net_flow": F.col("beh_positive_sum") + F.col("beh_negative_sum"),
               "beh_flow_imbalance": F.abs(inflow - outflow) / (inflow + outflow + EPS),
               "beh_high_activity": F.coalesce(F.col("beh_row_mean") > F.lit(self.pop_mean + 2 * self.pop_std), F.lit(False)).cast("int"),
               "beh_entropy": F.when(k == 0, F.lit(0.0)).otherwise(col_sum(ent_terms))}
        for src, mapping, name in ((self.acct_col, ACCT_TYPE_RISK, "beh_acct_type_risk"),
                                   (self.employment_col, EMPLOYMENT_RISK, "beh_employment_risk"),
                                   (self.channel_col, CHANNEL_RISK, "beh_channel_risk")):
            m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
            new[name] = F.coalesce(m[F.col(q(src))], F.lit(0.5)) if src and src in df.columns else F.lit(0.5)
        out = out.withColumns(new).drop("__v", "__b", "__lo", "__hi")
        return out


@dataclass
class BehaviourFeatures:
    """F8: population moments, flows, activity flag, entropy and fixed risk maps."""
    candidates: list[str]
    top_n: int = 300
    acct_col: str | None = None
    employment_col: str | None = None
    channel_col: str | None = None

    def fit(self, df: DataFrame) -> BehaviourModel:
        cols = top_variance(df, self.candidates, self.top_n)
        means = df.select(arr_mean(nn(row_array(cols))).alias("m"))
        st = means.agg(F.avg("m").alias("a"), F.stddev_samp("m").alias("s")).first()
        pop_std = st["s"] if st["s"] not in (None, 0.0) else (1.0 if st["s"] == 0.0 else float("nan"))
        return BehaviourModel(cols, st["a"] if st["a"] is not None else float("nan"), pop_std,
                              self.acct_col, self.employment_col, self.channel_col)


# ---- F9 risk profile -----------------------------------------------------------------

@dataclass
class RiskProfileModel:
    out_flag_p90: float

    def transform(self, df: DataFrame) -> DataFrame:
        cols = set(df.columns)

        def safe(c: str, default: float) -> Column:
            return F.col(c) if c in cols else F.lit(default)

        comp = {"te_mean_risk": safe("te_mean_risk", 0.0), "out_outlier_rate": safe("out_outlier_rate", 0.0),
                "beh_flow_imbalance": safe("beh_flow_imbalance", 0.0),
                "freq_rarity_score": safe("freq_rarity_score", 0.0) / 8.0,
                "mv_missing_block_score": safe("mv_missing_block_score", 0.0)}
        profile = col_sum([comp[k] * RISK_PROFILE_WEIGHTS[k] for k in comp])
        flags = {
            "risk_new_acct_flag": (safe("account_age_days", 9999) < 90) & (safe("beh_high_activity", 0) == 1),
            "risk_batch_open_flag": safe("date_open_cohort_risk", 0) > 2.0,
            "risk_synthetic_id_flag": safe("freq_rarity_score", 0) >= 2,
            "risk_flow_thru_flag": safe("beh_flow_imbalance", 1.0) < 0.15,
            "risk_outlier_heavy_flag": safe("out_total_flag_count", 0) > self.out_flag_p90,
        }
        out = df.withColumns({"risk_profile_score": profile, **{k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()}})
        comp_score = (F.lit(0.5) * (col_sum([F.col(f) for f in RISK_FLAGS]) / len(RISK_FLAGS))
                      + F.lit(0.5) * F.least(F.greatest(F.col("risk_profile_score"), F.lit(0.0)), F.lit(1.0)))
        out = out.withColumns({"risk_emp_channel_combo": safe("beh_employment_risk", 0.5) * safe("beh_channel_risk", 0.5),
                               "risk_flag_count": col_sum([F.col(f) for f in RISK_FLAGS]), "risk_composite_score": comp_score})
        s = F.col("risk_composite_score")
        tier = (F.when((s > -0.001) & (s <= 0.25), 0).when((s > 0.25) & (s <= 0.5), 1)
                .when((s > 0.5) & (s <= 0.75), 2).when((s > 0.75) & (s <= 1.001), 3).otherwise(0))
        return out.withColumn("risk_tier", tier)

    @staticmethod
    def anomaly_score(df: DataFrame, exclude: list[str]) -> DataFrame:
        """F9e: std(ddof0) / (mean |x| + eps) over all numeric engineered columns, NULL -> 0."""
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
                and f.name not in exclude and f.name not in RISK_FLAGS]
        arr = F.expr(f"array({', '.join(f'coalesce(CAST({q(c)} AS DOUBLE), 0.0D)' for c in cols)})")
        a, n = F.col("__a"), float(len(cols))
        # the mean is a column of its own: inside the lambda it would be taken anew for each element
        out = df.select("*", arr.alias("__a")).withColumn("__mean", F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n)
        mean = F.col("__mean")
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
        mabs = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)) / n
        return out.withColumn("risk_anomaly_score", F.sqrt(var) / (mabs + EPS)).drop("__a", "__mean")


@dataclass
class RiskProfileFeatures:
    """profile score, five flags (p90 outlier threshold fitted), composite, tier."""

    def fit(self, df: DataFrame) -> RiskProfileModel:
        if "out_total_flag_count" in df.columns:
            p = fit_quantiles(df, ["out_total_flag_count"], [0.9])["out_total_flag_count"][0]
            return RiskProfileModel(p if p is not None else 5.0)
        return RiskProfileModel(5.0)
