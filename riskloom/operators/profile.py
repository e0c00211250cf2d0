"""Per-column profiling (P1-P14) of a wide table.

Design: every per-column statistic is one expression inside a *single*
aggregate over the table (one scan, partial aggregation per partition, one
tiny shuffle of a 1-row partial per task), then ``stack`` turns the 1-row
result into one row per column. Distinct counts and value frequencies use the
long form ``(column_name, value)`` so that the shuffle carries distinct
(column, value) pairs after map-side de-duplication, never raw rows.
Correlations add up shares of a Gram matrix on the executors and apply their threshold there.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.exprs import q
from riskloom.functions.stats import fit_quantiles
from riskloom.functions.topk import top_k

DUP_FILL = -99999.0

#: Columns of one aggregate.
BATCH_COLS = 200


def dtype_class(dt: T.DataType) -> str:
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    return "other"


def _stack(row_df: DataFrame, cols: list[str], fields: list[tuple[str, str]]) -> DataFrame:
    """1-row frame with ``{i}__{field}`` columns -> one row per column (in order)."""
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"'{c}', {i}")
        parts += [f"CAST({q(f'{i}__{f}')} AS {t})" for f, t in fields]
    names = ", ".join(["column_name", "position"] + [f for f, _ in fields])
    return row_df.selectExpr(f"stack({len(cols)}, {', '.join(parts)}) AS ({names})")


def _null_counts_n(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [(F.count(F.lit(1)) - F.count(F.col(q(c)))).alias(f"{i}__null_count")
             for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    row = row.select("*", *[(F.col(f"{i}__null_count") * 100.0 / F.col("__n")).alias(f"{i}__null_pct")
                            for i in range(len(cols))],
                     *[F.col("__n").alias(f"{i}__n_rows") for i in range(len(cols))])
    return _stack(row, cols, [("null_count", "BIGINT"), ("null_pct", "DOUBLE"),
                              ("n_rows", "BIGINT")])


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column_name, position, null_count, null_pct (one aggregate)."""
    return _null_counts_n(df, cols or df.columns).drop("n_rows")


def _long_strings(df: DataFrame, cols: list[str], id_col: str | None = None) -> DataFrame:
    keep = [F.col(q(id_col))] if id_col else []
    return (df.select(*keep, *[F.col(q(c)).cast("string").alias(c) for c in cols])
            .unpivot([id_col] if id_col else [], cols, "column_name", "value"))


def distinct_counts(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """column_name, nunique (non-null). Exact via long-form distinct pairs, else HLL++."""
    if not exact:
        row = df.agg(*[F.approx_count_distinct(F.col(q(c))).alias(f"{i}__nunique")
                       for i, c in enumerate(cols)])
        return _stack(row, cols, [("nunique", "BIGINT")]).drop("position")
    long = _long_strings(df, cols).filter(F.col("value").isNotNull()).distinct()
    counts = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("nunique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(counts, "column_name", "left").select(
        "column_name", F.coalesce("nunique", F.lit(0)).alias("nunique"))


def column_profile(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column_name, position, dtype_class, null_count, null_pct, nunique."""
    cols = cols or df.columns
    types = {f.name: dtype_class(f.dataType) for f in df.schema.fields}
    nulls = null_counts(df, cols)
    cls = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return (nulls.join(distinct_counts(df, cols, exact), "column_name")
            .select("column_name", "position", cls[F.col("column_name")].alias("dtype_class"),
                    "null_count", "null_pct", "nunique"))


def non_numeric_report(df: DataFrame, id_col: str, cols: list[str] | None = None,
                       n_samples: int = 5) -> DataFrame:
    """column_name, dtype, nunique, sample_values (first 5 non-null by id order)."""
    cols = cols or [f.name for f in df.schema.fields
                    if not isinstance(f.dataType, T.NumericType) and f.name != id_col]
    long = _long_strings(df, cols, id_col).filter(F.col("value").isNotNull())
    first = top_k(long, ["column_name"], [F.col(id_col)], n_samples, salt_cols=[id_col])
    samples = first.groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(id_col, "value"))),
                                 lambda s: s["value"]), ", ").alias("sample_values"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dt = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return (distinct_counts(df, cols).join(samples, "column_name", "left")
            .select("column_name", dt[F.col("column_name")].alias("dtype"), "nunique",
                    "sample_values"))


def missing_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Total / % missing cells, #columns with any, > 50 %, 100 % missing."""
    cols = cols or df.columns
    nc = _null_counts_n(df, cols)
    return nc.agg(
        F.sum("null_count").alias("total_missing_cells"),
        (F.sum("null_count") * 100.0 / (F.max("n_rows") * len(cols))).alias("percent_missing_cells"),
        F.sum((F.col("null_count") > 0).cast("long")).alias("columns_with_any_missing"),
        F.sum((F.col("null_pct") > 50).cast("long")).alias("columns_over_50_pct_missing"),
        F.sum((F.col("null_pct") == 100).cast("long")).alias("columns_100_pct_missing"))


def top_missing(df: DataFrame, cols: list[str] | None = None, k: int = 30) -> DataFrame:
    """The k columns with the highest null share (ties by name)."""
    return (null_counts(df, cols).orderBy(F.desc("null_pct"), "column_name").limit(k)
            .select("column_name", F.col("null_pct").alias("percent")))


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P5: columns with <= 1 distinct non-null value: ``min <=> max`` (all-NULL counts)."""
    cols = cols or df.columns
    row = df.agg(*[F.min(F.col(q(c))).eqNullSafe(F.max(F.col(q(c)))).alias(f"{i}__is_const")
                   for i, c in enumerate(cols)])
    return (_stack(row, cols, [("is_const", "BOOLEAN")]).filter("is_const")
            .select("column_name", "position"))


def dup_fill(x, dtype: T.DataType):
    """The duplicate-test value of a cell: numeric as double, NULL -> -99999."""
    if isinstance(dtype, T.NumericType):
        return F.coalesce(x.cast("double"), F.lit(DUP_FILL))
    return F.coalesce(x.cast("string"), F.lit(str(DUP_FILL)))


def confirm_duplicates(df: DataFrame, cols: list[str], fingerprints: dict, types: dict) -> DataFrame:
    """Columns sharing a fingerprint are confirmed exactly by one aggregate over the
    candidate pairs only. Output: column_name, duplicate_of (first of its group)."""
    groups: dict[int, list[int]] = {}
    for i, c in enumerate(cols):
        groups.setdefault(fingerprints[c], []).append(i)
    cand = [(g[0], j) for g in groups.values() if len(g) > 1 for j in g[1:]]
    spark = df.sparkSession
    schema = "column_name string, duplicate_of string"
    if not cand:
        return spark.createDataFrame([], schema)

    def filled(c):
        return dup_fill(F.col(q(c)), types[c])

    checks = df.agg(*[F.sum((~filled(cols[i]).eqNullSafe(filled(cols[j]))).cast("long"))
                      .alias(f"d{i}_{j}") for i, j in cand]).first()
    rows = [(cols[j], cols[i]) for i, j in cand if checks[f"d{i}_{j}"] == 0]
    return spark.createDataFrame(rows, schema)


def duplicate_columns(df: DataFrame, id_col: str, cols: list[str] | None = None) -> DataFrame:
    """Columns whose values (NULL filled with -99999) equal an earlier column's.

    Fingerprint per column = bit_xor of xxhash64(id, value) over rows, computed in
    one aggregate; columns sharing a fingerprint are then *confirmed* exactly by a
    second aggregate over the candidate pairs only. Output: column_name,
    duplicate_of (first column of its group, by position).
    """
    cols = cols or [c for c in df.columns if c != id_col]
    typ = {f.name: f.dataType for f in df.schema.fields}
    fps = df.agg(*[F.bit_xor(F.xxhash64(F.col(q(id_col)), dup_fill(F.col(q(c)), typ[c]))).alias(f"{i}__fp")
                   for i, c in enumerate(cols)]).first()
    return confirm_duplicates(df, cols, {c: fps[f"{i}__fp"] for i, c in enumerate(cols)}, typ)


#: Cells of the matrix that a task adds up at a time (doubles: 64 MB).
GRAM_CELLS = 8_000_000


def pairwise_corr(df: DataFrame, cols: list[str], above: float | None = None) -> DataFrame:
    """feature1, feature2 (i < j by position), correlation (Pearson, NULL if constant) of columns without NULL; with ``above``
    only the pairs whose |correlation| is greater.

    One path for any number of columns. The columns' means and deviations come from aggregates; each task standardises its
    rows and adds up its share of the Gram matrix, a panel of rows of the matrix at a time, so that it holds GRAM_CELLS cells at most.
    The shares of one matrix row meet in one group (a vector from each task), where the threshold applies: neither the
    driver nor a task ever holds the matrix, and only the pairs asked for leave the last stage."""
    schema = "feature1 string, feature2 string, correlation double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    mean, std, n = np.zeros(len(cols)), np.zeros(len(cols)), 0
    for at in range(0, len(cols), BATCH_COLS):
        batch = cols[at:at + BATCH_COLS]
        r = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(batch) for e in (F.avg(F.col(q(c)).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(q(c)).cast("double")).alias(f"s{i}"))]).first()
        n = r["n"]
        for i in range(len(batch)):
            mean[at + i], std[at + i] = r[f"m{i}"] or 0.0, r[f"s{i}"] or 0.0
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    panel = max(1, GRAM_CELLS // len(cols))
    rows = df.select(F.array(*[F.col(q(c)).cast("double") for c in cols]).alias("v"))

    def shares(first: int):
        def run(batches):
            total = np.zeros((min(panel, len(cols) - first), len(cols) - first))
            for b in batches:
                if len(b):
                    z = (np.array(b["v"].tolist(), float)[:, first:] - mean[first:]) * scale[first:]
                    total += z[:, :len(total)].T @ z
            yield pd.DataFrame({"i": np.arange(first, first + len(total)), "sums": [total[k, k + 1:].tobytes() for k in range(len(total))]})
        return run

    def correlated(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        r = np.sum([np.frombuffer(s) for s in parts["sums"]], axis=0) / max(n, 1)
        r = np.where((scale[i] > 0) & (scale[i + 1:] > 0), np.clip(r, -1.0, 1.0), np.nan)
        j = np.flatnonzero(np.abs(r) > above) if above is not None else np.arange(len(r))
        return pd.DataFrame({"feature1": np.full(len(j), cols[i], object), "feature2": np.array([cols[i + 1 + k] for k in j], object), "correlation": r[j]})

    sums = reduce(DataFrame.unionByName, [rows.mapInPandas(shares(first), "i int, sums binary") for first in range(0, len(cols), panel)])
    out = sums.where(F.col("i") < len(cols) - 1).groupBy("i").applyInPandas(correlated, schema)
    return out.withColumn("correlation", F.nanvl("correlation", F.lit(None).cast("double")))


def corr_candidates(df: DataFrame, id_col: str, label_col: str | None = None) -> tuple[list[str], DataFrame]:
    """Columns kept for correlation (P7 rule) and the median-imputed frame.

    numeric, not constant, not > 50 % NULL, not a duplicate; NULL -> median;
    a column that stays NULL (all NULL) is dropped.
    """
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, T.NumericType) and f.name != id_col]
    const = {r.column_name for r in constant_columns(df, num).collect()}
    nulls = {r.column_name: r.null_pct for r in null_counts(df, num).collect()}
    dups = {r.column_name for r in duplicate_columns(df, id_col, num).collect()}
    keep = [c for c in num if c not in const and nulls[c] <= 50 and c not in dups]
    meds = fit_quantiles(df, keep, [0.5])
    keep = [c for c in keep if meds[c][0] is not None]
    filled = df.select(*[F.coalesce(F.col(q(c)).cast("double"), F.lit(meds[c][0])).alias(c)
                         for c in keep])
    return keep, filled


def correlated_pairs(df: DataFrame, id_col: str, threshold: float = 0.95, k: int = 50) -> DataFrame:
    """|r| > threshold in the upper triangle, top k by |r| (ties by names)."""
    keep, filled = corr_candidates(df, id_col)
    pc = pairwise_corr(filled, keep, threshold).select("feature1", "feature2", F.abs("correlation").alias("correlation"))
    return (pc.orderBy(F.desc("correlation"), "feature1", "feature2").limit(k))


def leakage_candidates(df: DataFrame, id_col: str, label_col: str,
                       threshold: float = 0.8) -> DataFrame:
    """|corr(feature, target)| > threshold on the median-imputed candidates."""
    keep, filled = corr_candidates(df, id_col)
    if label_col not in keep:
        return df.sparkSession.createDataFrame([], "column_name string, correlation double")
    y = F.col(label_col)
    feats = [c for c in keep if c != label_col]
    row = filled.agg(*[F.abs(F.try_divide(F.covar_pop(F.col(c), y),
                                          F.stddev_pop(F.col(c)) * F.stddev_pop(y))).alias(c)
                       for c in feats])
    parts = ", ".join(f"'{c}', {q(c)}" for c in feats)
    long = row.selectExpr(f"stack({len(feats)}, {parts}) AS (column_name, correlation)")
    return long.filter(F.col("correlation") > threshold)


def target_corr_matrix(df: DataFrame, id_col: str, label_col: str, k: int = 16) -> DataFrame:
    """The k columns most correlated with the target (target included) and
    their pairwise correlations (long form, i < j in rank order)."""
    keep, filled = corr_candidates(df, id_col)
    y = F.col(label_col)
    row = filled.agg(*[F.abs(F.try_divide(F.covar_pop(F.col(c), y),
                                          F.stddev_pop(F.col(c)) * F.stddev_pop(y))).alias(c)
                       for c in keep]).first()
    ranked = sorted(keep, key=lambda c: (-(row[c] if row[c] is not None else -1.0), c))[:k]
    return pairwise_corr(filled, ranked)


def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """value_counts(dropna=False) with percentage of all rows."""
    from pyspark.sql import Window
    c = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def null_rate_histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 50) -> DataFrame:
    """50 equal-width bins between the min and max column null share
    (last bin right-closed); only non-empty bins."""
    from pyspark.sql import Window
    nc = null_counts(df, cols)  # one row per column: tiny, a global window is fine
    w = Window.partitionBy()
    x = nc.select("null_pct", F.min("null_pct").over(w).alias("lo"),
                  F.max("null_pct").over(w).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("null_pct") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return (x.withColumn("bin", idx).groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins)
                    .alias("bin_lo"), "n"))


def _hash52(x):
    """52 bits of a value's hash: the sketch of a median holds doubles."""
    return F.shiftrightunsigned(F.xxhash64(x), 12)


def useless_columns(df: DataFrame, label_col: str, cols: list[str] | None = None,
                    near_share: float = 0.999) -> DataFrame:
    """all_zero (NULL->0 all equal 0) -> constant (<=1 distinct non-null) ->
    near_constant (top value share incl. NULL > 0.999). Target is never listed.

    No cell is unpivoted and no value counted but one: a value that more than 98 % of the rows have is the median whatever
    the order of the values, so the (sketched, mergeable) median of the values' hashes is the only candidate, and a second
    aggregate counts it. Two scans in batches of columns; what is shuffled is a row a task."""
    if near_share < 0.98:
        raise ValueError("near_share below 0.98 needs more than one candidate a column")
    cols = [c for c in (cols or df.columns) if c != label_col]
    typ, found = {f.name: f.dataType for f in df.schema.fields}, []
    for at in range(0, len(cols), BATCH_COLS):
        batch = cols[at:at + BATCH_COLS]
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(batch):
            x = F.col(q(c))
            zero = F.bool_and(F.coalesce(x, F.lit(0)) == 0) if isinstance(typ[c], T.NumericType) else F.lit(False)
            aggs += [zero.alias(f"z{i}"), F.min(x).eqNullSafe(F.max(x)).alias(f"c{i}"), F.percentile_approx(_hash52(x), 0.5, 100).alias(f"h{i}")]
        row = df.agg(*aggs).first()   # three numbers a column
        unclear = [(i, c) for i, c in enumerate(batch) if row["n"] and not row[f"z{i}"] and not row[f"c{i}"]]
        top = df.agg(*[F.count_if(_hash52(F.col(q(c))) == row[f"h{i}"]).alias(f"t{i}") for i, c in unclear]).first() if unclear else {}
        for i, c in enumerate(batch):
            reason = "all_zero" if row[f"z{i}"] else "constant" if row[f"c{i}"] else "near_constant" if (i, c) in unclear and top[f"t{i}"] / row["n"] > near_share else None
            if reason:
                found.append((c, at + i, reason))
    return df.sparkSession.createDataFrame(found, "column_name string, position int, reason string")


def column_inspector(df: DataFrame, cols: list[str]) -> DataFrame:
    """all_zero, nunique (NULL counted as a value), null %, min, max."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        x = F.col(q(c))
        aggs += [F.bool_and(F.coalesce(x, F.lit(0)) == 0).alias(f"{i}__all_zero"),
                 (F.count(F.lit(1)) - F.count(x)).alias(f"{i}__nulls"),
                 F.min(x).cast("double").alias(f"{i}__min"),
                 F.max(x).cast("double").alias(f"{i}__max")]
    wide = df.agg(*aggs)
    wide = wide.select("*", *[(F.col(f"{i}__nulls") * 100.0 / F.col("__n")).alias(f"{i}__null_pct")
                              for i in range(len(cols))])
    flags = _stack(wide, cols, [("all_zero", "BOOLEAN"), ("nulls", "BIGINT"),
                                ("null_pct", "DOUBLE"), ("min", "DOUBLE"), ("max", "DOUBLE")])
    nun = distinct_counts(df, cols)
    return (flags.join(nun, "column_name")
            .select("column_name", "all_zero",
                    (F.col("nunique") + (F.col("nulls") > 0).cast("long")).alias("nunique"),
                    "null_pct", "min", "max"))
