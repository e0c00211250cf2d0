"""The fitted feature pipeline, saved and loaded again, on unseen rows."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.operators import models as ML
from riskloom.operators.feature_pipeline import FeaturePipeline, FeaturePipelineModel
from riskloom.plans import q_features as QF
from riskloom.session import checkpoint_dir

SMALL = {"numericCols": ["acctbal", "inflow", "outflow", "ev_count"], "categoricalCols": ["acct_type", "region"], "missingCols": ["ev_count", "open_date", "acctbal"]}


@pytest.fixture(scope="module")
def split(spark):
    df = QF.feature_input(spark, SF_SMALL).withColumns({"settled_case": F.col("label") * 2, "almost_label": F.col("label") * 100 + F.pmod("account_id", F.lit(3)), "k": F.lit(4)})
    df = df.checkpoint()
    odd = F.pmod("account_id", F.lit(5)) == 0
    unseen = df.where(odd).drop("label").withColumn("region", F.when(F.col("account_id") % 2 == 0, "ATLANTIS").otherwise(F.col("region")))
    return df.where(~odd), unseen


@pytest.fixture(scope="module")
def estimator():
    return QF.pipeline(**SMALL, topN=12, maxIter=3, leakageCols=["settled_case", "absent"])


@pytest.fixture(scope="module")
def model(split, estimator):
    return estimator.fit(split[0])


def test_leaks_useless_and_unselected_columns_go(split, model):
    out = model.transform(split[0])
    assert model.dropped["settled_case"] == model.dropped["almost_label"] == "leakage"
    assert {"leakage", "not selected"} <= set(model.dropped.values())
    assert out.columns == ["account_id", "label", *model.selected] and not set(out.columns) & set(model.dropped)
    must_keep = [c for c, _, _ in model.importance if c.startswith(("risk_", "te_"))]
    assert set(must_keep) <= set(model.selected) | {c for c, why in model.dropped.items() if why in ("all_zero", "constant", "near_constant")}
    top = [c for c, _, r in model.importance if r <= 12]
    assert set(top) <= set(model.selected) | set(model.dropped)
    for c in model.selected:   # nothing useless is left
        values = [r[0] for r in out.select(F.col(f"`{c}`")).collect()]
        assert any(v not in (None, 0) for v in values) and len({v for v in values if v is not None}) > 1


def test_a_loaded_model_gives_the_same_rows(spark, split, model):
    path = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    model.write().save(path)
    again = FeaturePipelineModel.load(path)
    assert (again.selected, again.dropped, again.uid) == (model.selected, model.dropped, model.uid)
    assert again.importance == [tuple(x) for x in model.importance]
    for rows in split:   # the training rows, and unseen ones without a label and with an unknown category
        a, b = [{r.account_id: r for r in m.transform(rows).collect()} for m in (model, again)]
        assert a == b and len(a) == rows.count()
    assert "label" not in again.transform(split[1]).columns
    model.write().overwrite().save(path)


def test_the_estimator_is_saved_too(spark, estimator):
    path = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    estimator.write().save(path)
    again = FeaturePipeline.load(path)
    assert {p.name: again.getOrDefault(p) for p in again.params} == {p.name: estimator.getOrDefault(p) for p in estimator.params}


def test_unseen_categories_take_the_priors(split, model):
    rows = model.engineered(split[1]).where("region = 'ATLANTIS'").select("region_te", "region_freq", "region_freq_rank", "region_is_rare").distinct().collect()
    g = split[0].agg(F.avg("label")).first()[0]
    assert [tuple(r) for r in rows] == [(pytest.approx(g), 0.0, 9999, 1)]


def test_selection_needs_both_classes(split, estimator):
    with pytest.raises(ValueError, match="both classes"):
        estimator.copy().fit(split[0].where("label = 0"))


def test_mean_attributions_are_means_of_the_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(int(k), *[float(v) for v in r], float(r[0] + 0.1 * r[1] > 0), 1.0) for k, r in enumerate(x)], "account_id long, a double, b double, c double, label double, weight double")
    feats = ["a", "b", "c"]
    fitted = ML.learners()["gbt"].setMaxIter(4).fit(ML.assemble(df, feats))
    rows = ML.tree_attributions(df, feats, fitted, top_n=3).groupBy("feature").agg(F.avg(F.abs("value")).alias("m")).collect()
    got = ML.mean_attributions(df.repartition(5), feats, fitted).collect()
    assert {r.feature: pytest.approx(r.m) for r in rows} == {r.feature: r.mean_abs_attribution for r in got}
    assert [r.feature for r in sorted(got, key=lambda r: r["rank"])][0] == "a"
    assert ML.select_features([("a", 2), ("te_x", 4), ("b", 1), ("risk_y", 3)], 2) == ["b", "a", "te_x", "risk_y"]


def test_mean_attributions_read_the_features_that_trees_split_on(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(int(k), 1.0, float(r[0]), 1.0, float(r[1]), float(r[0] > 0), 1.0) for k, r in enumerate(x)],
                               "account_id long, c1 double, a double, c2 double, b double, label double, weight double")
    feats = ["c1", "a", "c2", "b"]   # constant columns: no tree can split on them
    fitted = ML.learners()["gbt"].setMaxIter(3).fit(ML.assemble(df, feats))
    want = {r.feature: r.m for r in ML.tree_attributions(df, feats, fitted, top_n=4).groupBy("feature").agg(F.avg(F.abs("value")).alias("m")).collect()}
    out = ML.mean_attributions(df.withColumns({"c1": F.raise_error(F.lit("read c1")).cast("double"), "c2": F.raise_error(F.lit("read c2")).cast("double")}), feats, fitted)
    got = {r.feature: r.mean_abs_attribution for r in out.collect()}
    assert got == {c: pytest.approx(want[c]) for c in feats} and got["c1"] == got["c2"] == 0.0 and len({r["rank"] for r in out.collect()}) == 4


def test_row_means_and_ends_are_taken_once_a_row(spark):
    """Inside a lambda they would be taken anew for each element: no aggregate or array end stands within another expression's lambda."""
    from riskloom.operators import features as FE
    df = spark.createDataFrame([(1, 1.0, 2.0, 9.0), (2, None, -3.0, 4.0), (3, None, None, None)], "account_id long, a double, b double, c double")
    cols = ["a", "b", "c"]
    ratio, behaviour = FE.RatioModel(cols).transform(df), FE.BehaviourModel(cols, 0.0, 1.0).transform(df)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (ratio, behaviour)]
    assert all(name in plans[0] for name in ("__m",)) and all(name in plans[1] for name in ("__lo", "__hi"))
    assert set(ratio.columns) == {"account_id", *cols, "ratio_numeric_cv", "ratio_top_to_median", "ratio_nonzero_fraction", "ratio_pos_to_neg", "ratio_extreme_range"}
    assert not [c for c in behaviour.columns if c.startswith("__")]
    got = {r.account_id: r for r in ratio.collect()}
    for key, values in ((1, [1.0, 2.0, 9.0]), (2, [-3.0, 4.0])):
        assert got[key].ratio_numeric_cv == pytest.approx(np.std(values) / (abs(np.mean(values)) + FE.EPS))
    assert got[3].ratio_numeric_cv is None
