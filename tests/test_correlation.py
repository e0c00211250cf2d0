"""Correlations by shares of a Gram matrix: many columns, panels, constants, the threshold where the shares meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import profile as P


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 500)) * 10.0 ** rng.integers(-3, 6, 500) + 1e6
    x[:, 7], x[:, 300] = 2 * x[:, 3] + 1, -x[:, 450]
    x[:, 20] = 4.0
    names = [f"c.{k}" for k in range(500)]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(5)
    return x, names, df.select(*[F.get("v", F.lit(k)).alias(n) for k, n in enumerate(names)])


def test_five_hundred_columns(wide, monkeypatch):
    x, names, df = wide
    monkeypatch.setattr(P, "GRAM_CELLS", 200 * 500)   # three panels
    found = {(r.feature1, r.feature2): r.correlation for r in P.pairwise_corr(df, names, 0.3).collect()}
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x.T)
    i, j = np.nonzero(np.triu(np.abs(np.nan_to_num(want)) > 0.3, 1))
    assert found == {(names[a], names[b]): pytest.approx(want[a, b], abs=1e-6) for a, b in zip(i, j)}
    assert found["c.3", "c.7"] == pytest.approx(1.0) and found["c.300", "c.450"] == pytest.approx(-1.0)


def test_all_pairs_and_constants(wide):
    x, names, df = wide
    own = names[15:25]
    got = {(r.feature1, r.feature2): r.correlation for r in P.pairwise_corr(df.select(*[F.col(f"`{c}`") for c in own]), own).collect()}
    assert len(got) == 45 and all((v is None) == ("c.20" in k) for k, v in got.items())
    assert P.pairwise_corr(df, own[:1]).count() == 0
    assert {r.correlation for r in P.pairwise_corr(df.limit(0), own).collect()} <= {None}
