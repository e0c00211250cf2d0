"""Exact quantiles of many columns and groups at once, as fitted numbers.

Fitting returns *small* results (a handful of numbers per column and group) that are brought to the driver and inlined as
literals in the transform projection — the MLlib model pattern. Nothing row-sized reaches the driver.

The value is the linearly interpolated quantile of numpy / pandas / DuckDB ``quantile_cont``. There is one algorithm, whatever the
number of rows; no task or driver ever holds a column:

1. *Sketch*: one aggregate takes, for each column, the count and a mergeable sketch's values just below and above each wanted rank.
2. *Counts*: one aggregate counts the values below and at each of these points. A rank that falls on a point is found; any other
   lies strictly between two neighbouring points, with at most a few in ACCURACY of the column's values (or, should the sketch
   have missed it, before the first or after the last point).
3. *Finish*: one more scan keeps just the values strictly between such points, counts each distinct one, and a running count in
   order of value finds the rank. Where a bracket holds more than FINISH_ROWS distinct values (billions of rows), they are
   first narrowed: a sketch of the distinct values cuts the bracket into NARROW parts, whose counts tell which one holds the
   rank; again until it fits. Many equal values can't stall this: they are points, or one distinct value.

Columns go in batches of BATCH_COLS, so that plans stay bounded for thousands of columns; each batch reads its columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import q
from riskloom.session import cut_lineage

#: Relative rank error of the sketch is at most one in this many.
ACCURACY = 10_000
#: Distinct values of one bracket that one task puts in order; parts that a larger bracket is cut into at a time.
FINISH_ROWS = 1_000_000
NARROW = 256
BATCH_COLS = 64


@dataclass
class Rank:
    """One wanted order statistic: 0-based rank among the non-null values of a column in a group."""
    group: object
    col: int
    k: int
    value: float | None = None
    bracket: int = -1    # strictly between points[bracket] (-1: no bound) and points[bracket + 1] (past the last: no bound) ...
    offset: int = -1     # ... at this rank among the values there


def fit_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """{col: [quantile for each of probs]} over non-null values; None where a column has none."""
    found = fit_group_quantiles(df, None, cols, probs).get(None, {})
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def fit_group_quantiles(df: DataFrame, group: str | None, cols: list[str], probs: list[float]) -> dict[object, dict[str, list[float | None]]]:
    """{group value: {col: quantiles}} in one go for all groups (a few: their numbers are returned to the driver)."""
    out: dict[object, dict[str, list[float | None]]] = {}
    for at in range(0, len(cols), BATCH_COLS):
        batch = cols[at:at + BATCH_COLS]
        for value, own in _batch(df, group, batch, probs).items():
            out.setdefault(value, {}).update(own)
    return out


def _batch(df: DataFrame, group: str | None, cols: list[str], probs: list[float]) -> dict[object, dict[str, list[float | None]]]:
    x = df.select(F.lit(None).alias("g") if group is None else F.col(q(group)).alias("g"), *[F.col(q(c)).cast("double").alias(f"v{j}") for j, c in enumerate(cols)])

    def collected(frame: DataFrame, exprs: list[Column]) -> dict:
        return {r["g"]: r for r in (frame.agg(*exprs).withColumn("g", F.lit(None)) if group is None else frame.groupBy("g").agg(*exprs)).collect()}   # a row a group

    # 1. sketch
    asked = sorted({min(1.0, max(0.0, p + s * 2 / ACCURACY)) for p in probs for s in (-1, 1)})
    stats = collected(x, [e for j in range(len(cols)) for e in (F.count(f"v{j}").alias(f"n{j}"), F.percentile_approx(f"v{j}", asked, ACCURACY).alias(f"s{j}"))])
    points = {(g, j): sorted(set(r[f"s{j}"] or [])) for g, r in stats.items() for j in range(len(cols))}
    wanted: dict[tuple, Rank] = {}
    for g, r in stats.items():
        for j in range(len(cols)):
            for p in probs:
                pos = (r[f"n{j}"] - 1) * p
                for k in {floor(pos), ceil(pos)} if r[f"n{j}"] else ():
                    wanted[g, j, k] = Rank(g, j, k)
    # 2. counts below and at the points; each group's points come to its rows as arrays
    most = [max((len(points[g, j]) for g in stats), default=0) for j in range(len(cols))]
    y, point = _with_arrays(x, group, {g: [points[g, j] for j in range(len(cols))] for g in stats})
    counts = collected(y, [e for j in range(len(cols)) for i in range(most[j]) for e in (
        F.count_if(F.col(f"v{j}") < point(j, i)).alias(f"l{j}_{i}"), F.count_if(F.col(f"v{j}") <= point(j, i)).alias(f"e{j}_{i}"))]) if any(most) else {}
    brackets: dict[object, set[tuple[int, int]]] = {}
    largest = 0   # rows of a bracket
    for w in wanted.values():
        own, r = points[w.group, w.col], counts[w.group]
        at = max((i for i in range(len(own)) if r[f"l{w.col}_{i}"] <= w.k), default=-1)
        upto = r[f"e{w.col}_{at}"] if at >= 0 else 0
        if w.k < upto:
            w.value = own[at]
        else:
            w.bracket, w.offset = at, w.k - upto
            brackets.setdefault(w.group, set()).add((w.col, at))
            largest = max(largest, (r[f"l{w.col}_{at + 1}"] if at + 1 < len(own) else stats[w.group][f"n{w.col}"]) - upto)
    # 3. finish
    if brackets:
        _finish(x, group, points, brackets, [w for w in wanted.values() if w.value is None], largest)
    out: dict[object, dict[str, list[float | None]]] = {}
    for g, r in stats.items():
        for j, c in enumerate(cols):
            own = []
            for p in probs:
                pos = (r[f"n{j}"] - 1) * p
                if not r[f"n{j}"]:
                    own.append(None)
                    continue
                low, high = wanted[g, j, floor(pos)].value, wanted[g, j, ceil(pos)].value
                own.append(float(low) if floor(pos) == ceil(pos) else float((ceil(pos) - pos) * low + (pos - floor(pos)) * high))
            out.setdefault(g, {})[c] = own
    return out


def _with_arrays(x: DataFrame, group: str | None, arrays: dict[object, list[list[float]]]):
    """``x`` and a function (j, i) -> the i-th number of the j-th array of the row's group."""
    if group is None:
        only = arrays.get(None, [])
        return x, lambda j, i: F.lit(float(only[j][i]))
    kind = dict(x.dtypes)["g"]
    table = x.sparkSession.createDataFrame([(g, a) for g, a in arrays.items()], f"h {kind}, a array<array<double>>")   # a row a group
    return x.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("h"))).drop("h"), lambda j, i: F.get(F.get("a", F.lit(j)), F.lit(i))


def _finish(x: DataFrame, group: str | None, points: dict, brackets: dict[object, set[tuple[int, int]]], wanted: list[Rank], largest: int) -> None:
    """Find the wanted ranks that lie strictly between two points, at most ``largest`` values between any two."""
    def ends(g, j: int, i: int) -> tuple[float | None, float | None]:
        own = points[g, j]
        return own[i] if i >= 0 else None, own[i + 1] if i + 1 < len(own) else None

    def between(v: Column, low: float | None, high: float | None) -> Column:
        inside = v.isNotNull()
        inside = inside if low is None else inside & (v > low)
        return inside if high is None else inside & (v < high)
    spark = x.sparkSession
    names = {key: b for b, key in enumerate(sorted({(g, j, i) for g, own in brackets.items() for j, i in own}, key=str))}
    # of each row: the values that lie in a bracket of its group, with the bracket's name
    if group is None:
        own = [F.struct(F.lit(b).alias("b"), F.when(between(F.col(f"v{j}"), *ends(g, j, i)), F.col(f"v{j}")).alias("v"))
               for (g, j, i), b in names.items()]
        cells = x.select(F.explode(F.filter(F.array(*own), lambda s: s["v"].isNotNull())).alias("c")).select("c.*")
    else:
        kind = dict(x.dtypes)["g"]
        table = spark.createDataFrame([(g, [(names[g, j, i], j, *ends(g, j, i)) for j, i in sorted(own)]) for g, own in brackets.items()],
                                      f"h {kind}, k array<struct<b:int,j:int,low:double,high:double>>")
        values = F.array(*[F.col(c) for c in x.columns if c != "g"])
        inside = F.filter("k", lambda s: F.get("values", s["j"]).isNotNull() & (s["low"].isNull() | (F.get("values", s["j"]) > s["low"]))
                          & (s["high"].isNull() | (F.get("values", s["j"]) < s["high"])))
        cells = (x.select("g", values.alias("values")).join(F.broadcast(table), F.col("g").eqNullSafe(F.col("h")))
                 .select("values", F.explode(inside).alias("s")).select("s.b", F.get("values", F.col("s.j")).alias("v")))
    values = cells.groupBy("b", "v").agg(F.count("*").alias("n"))
    needs: dict[int, dict[int, list[Rank]]] = {}
    for w in wanted:
        needs.setdefault(names[w.group, w.col, w.bracket], {}).setdefault(w.offset, []).append(w)
    if largest > FINISH_ROWS:
        values = cut_lineage(values)
        while values.groupBy("b").count().agg(F.max("count")).first()[0] > FINISH_ROWS:
            values, needs = _narrowed(values, needs)
    upto = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = spark.createDataFrame([(b, k) for b, own in needs.items() for k in own], "b2 int, k long")
    ends = values.withColumn("upto", F.sum("n").over(upto))
    for r in ends.join(F.broadcast(table), (F.col("b") == F.col("b2")) & (F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n"))).collect():
        for w in needs[r.b][r.k]:
            w.value = r.v


def _narrowed(values: DataFrame, needs: dict[int, dict[int, list[Rank]]]) -> tuple[DataFrame, dict[int, dict[int, list[Rank]]]]:
    """One part in about NARROW of each bracket, for each of its wanted ranks: brackets get new names, ranks new offsets."""
    grid = [i / NARROW for i in range(1, NARROW)]
    cuts = cut_lineage(values.groupBy("b").agg(F.percentile_approx("v", grid, 10 * NARROW).alias("cuts")))
    part = F.size(F.filter("cuts", lambda c: c <= F.col("v")))
    cut = values.join(F.broadcast(cuts), "b").select("b", "v", "n", part.alias("part"))   # a row a bracket
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in cut.groupBy("b", "part").agg(F.sum("n").alias("n")).orderBy("b", "part").collect():   # at most NARROW rows a bracket
        sizes.setdefault(r.b, []).append((r.part, r.n))
    names: dict[tuple[int, int], int] = {}
    out: dict[int, dict[int, list[Rank]]] = {}
    for b, own in needs.items():
        for k, ranks in own.items():
            below = 0
            for part_, n in sizes[b]:
                if k < below + n:
                    name = names.setdefault((b, part_), len(names))
                    out.setdefault(name, {})[k - below] = ranks
                    break
                below += n
    table = values.sparkSession.createDataFrame([(b, p, name) for (b, p), name in names.items()], "b int, part int, name int")
    return cut_lineage(cut.join(F.broadcast(table), ["b", "part"]).select(F.col("name").alias("b"), "v", "n")), out
