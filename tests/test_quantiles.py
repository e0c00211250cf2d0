"""Exact quantiles: one algorithm for any number of rows, columns and groups, against numpy."""

import numpy as np
import pytest

from riskloom.functions import stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    return {"heavy": np.concatenate([rng.lognormal(size=30_000), np.zeros(9_000), np.full(12_000, 7.5)]), "wide": rng.normal(size=51_000) * 10.0 ** rng.integers(-200, 200, 51_000),
            "few": rng.integers(0, 5, 51_000).astype(float), "one": np.full(51_000, -3.25), "some": np.where(rng.random(51_000) < 0.9, np.nan, rng.normal(size=51_000))}


@pytest.fixture(scope="module")
def table(spark, values):
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({**values, "g": np.arange(51_000) % 3}))
    from riskloom.functions.exprs import normalise_nan
    from pyspark.sql import functions as F
    return normalise_nan(df).withColumn("g", F.when(F.col("g") > 0, F.col("g"))).withColumn("none", F.lit(None).cast("double"))


def want(x):
    x = x[~np.isnan(x)]
    return [np.quantile(x, p) for p in PROBS]


def test_columns_at_once(table, values):
    got = stats.fit_quantiles(table, [*values, "none"], PROBS)
    for c, x in values.items():
        assert got[c] == pytest.approx(want(x), rel=1e-12, abs=0)
    assert got["none"] == [None] * len(PROBS)


def test_groups_at_once(table, values):
    got = stats.fit_group_quantiles(table, "g", [*values, "none"], PROBS)
    assert set(got) == {None, 1, 2}
    for g in got:
        for c, x in values.items():
            assert got[g][c] == pytest.approx(want(x[np.arange(51_000) % 3 == (g or 0)]), rel=1e-12, abs=0)


def test_coarse_sketches_are_narrowed(table, values, monkeypatch):
    """With a sketch of 20 points and 50 rows a task the brackets hold thousands of values: they are cut until they fit."""
    monkeypatch.setattr(stats, "ACCURACY", 20)
    monkeypatch.setattr(stats, "FINISH_ROWS", 50)
    monkeypatch.setattr(stats, "NARROW", 8)
    passes = []
    narrowed = stats._narrowed
    monkeypatch.setattr(stats, "_narrowed", lambda *a: passes.append(1) or narrowed(*a))
    got = stats.fit_quantiles(table, ["heavy", "wide", "few"], [0.25, 0.5, 0.99])
    for c in got:
        assert got[c] == pytest.approx([np.quantile(values[c], p) for p in (0.25, 0.5, 0.99)], rel=1e-12, abs=0)
    assert 2 <= len(passes) <= 8


def test_passes_do_not_grow_with_columns(table, values, monkeypatch):
    """As many jobs for five columns as for one (sketch, counts, finish); none narrows."""
    spark = table.sparkSession
    monkeypatch.setattr(stats, "_narrowed", None)
    for group in (None, "g"):
        jobs = []
        for cols in (["wide"], list(values)):
            name = f"quantiles-{group}-{len(cols)}"
            spark.sparkContext.setJobGroup(name, "")
            stats.fit_group_quantiles(table, group, cols, PROBS)
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
        assert jobs[1] <= jobs[0] + 1 and jobs[0] < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_columns_go_in_batches(spark, monkeypatch):
    monkeypatch.setattr(stats, "BATCH_COLS", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 25))
    df = spark.createDataFrame([[float(v) for v in r] for r in x], [f"c.{k}" for k in range(25)])
    got = stats.fit_quantiles(df, df.columns, [0.5])
    assert [got[c][0] for c in df.columns] == pytest.approx(np.median(x, axis=0).tolist())
    assert stats.fit_quantiles(df.limit(0), ["c.1"], [0.5]) == {"c.1": [None]}


def test_a_sketch_that_misses(table, values, monkeypatch):
    """Points that lie nowhere near the wanted ranks: these lie before the first or after the last point, and are found."""
    from pyspark.sql import functions as F
    sketch = F.percentile_approx
    monkeypatch.setattr(stats.F, "percentile_approx", lambda c, p, a: F.array(sketch(c, 0.6, a)))
    got = stats.fit_quantiles(table, ["heavy", "some"], [0.01, 0.5, 0.99])
    by_group = stats.fit_group_quantiles(table, "g", ["heavy"], [0.01, 0.99])
    for c in got:
        x = values[c][~np.isnan(values[c])]
        assert got[c] == pytest.approx([np.quantile(x, p) for p in (0.01, 0.5, 0.99)], rel=1e-12, abs=0)
    for g in by_group:
        assert by_group[g]["heavy"] == pytest.approx([np.quantile(values["heavy"][np.arange(51_000) % 3 == (g or 0)], p) for p in (0.01, 0.99)], rel=1e-12, abs=0)
