"""Training: early stopping, pooled out-of-fold fits, the search on a fold, stored numbers, appends that can be retried."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import detectors as D
from riskloom.operators import metrics as M
from riskloom.operators import models as ML
from riskloom.session import checkpoint_dir
from riskloom.sources import tables as TB

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.8 * rng.normal(size=500) > 0.8).astype(int)
    rows = [(int(k), int(y[k]), int(k % 5), *[float(v) for v in x[k]], 1.0 + float(y[k])) for k in range(500)]
    return spark.createDataFrame(rows, "account_id long, label int, fold int, a double, b double, c double, weight double").checkpoint()


def test_trees_stop_early(data):
    """Labels that are mostly noise: without validation all rounds are used, with it far fewer."""
    noisy = ML.training_table(data.withColumn("label", F.when(F.col("account_id") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label"))), FEATS, "account_id")
    own = {"maxDepth": 5, "stepSize": 0.5}
    assert ML.boosted(noisy.where("fold > 1"), max_iter=12, **own).getNumTrees == 12
    assert ML.boosted(noisy.where("fold > 0"), validation=F.col("fold") == 1, max_iter=12, **own).getNumTrees < 12


def test_out_of_fold_rows_are_never_trained_on(data):
    """Each row once, and its probability is that of a model fitted on the other folds alone."""
    out = ML.oof_predictions(data, FEATS, which=("lr", "gbt"))
    assert out.count() == 500 and out.select("account_id").distinct().count() == 500
    assert out.where("prob_lr < 0 or prob_lr > 1 or prob_gbt < 0 or prob_gbt > 1").count() == 0
    by_fold = {f: ML.learners()["lr"].fit(ML.assemble(data.where(F.col("fold") != f), FEATS)) for f in (0, 3)}
    got = {r.account_id: r.prob_lr for r in out.collect()}
    for f, model in by_fold.items():
        for r in model.transform(ML.assemble(data.where(F.col("fold") == f), FEATS)).select("account_id", ML.prob1().alias("p")).collect():
            assert got[r.account_id] == pytest.approx(r.p, abs=1e-6)
    assert M.binary_metrics(out, "prob_lr", "label").first()["roc_auc"] > 0.75


def test_out_of_fold_columns_need_no_join(data, monkeypatch):
    """The models of a fold score its rows in one pass over a table that is kept while they are fitted, and let go after."""
    joins, tables, join, table = [], [], type(data).join, ML.training_table
    monkeypatch.setattr(type(data), "join", lambda self, *own, **named: joins.append(own) or join(self, *own, **named))
    monkeypatch.setattr(ML, "training_table", lambda *own: tables.append(table(*own)) or tables[-1])
    kept = []
    fit = ML.learners
    monkeypatch.setattr(ML, "learners", lambda *own: kept.append(tables[0].storageLevel.useMemory) or fit(*own))
    out = ML.oof_predictions(data, FEATS, which=("lr", "rf"))
    assert out.columns == ["account_id", "label", "fold", "prob_lr", "prob_rf"] and out.count() == 500
    assert joins == [] and all(kept) and len(kept) == 10
    assert not tables[0].storageLevel.useMemory


def test_out_of_fold_rows_that_share_an_id_meet_each_other(spark, data):
    """As in joins on the id: a row without one is left out, rows that share one meet all its probabilities, also from no fold."""
    odd = spark.createDataFrame([(7, 1, 3, 9.0, 0.0, 0.0, 2.0), (7, 0, None, 0.0, 0.0, 0.0, 1.0), (None, 0, 1, 0.0, 0.0, 0.0, 1.0), (900, 0, None, 0.0, 0.0, 0.0, 1.0)], data.schema)
    out = ML.oof_predictions(data.unionByName(odd), FEATS, which=("lr", "rf")).collect()
    assert len([r for r in out if r.account_id != 7]) == 499 and not [r for r in out if r.account_id in (None, 900)]
    own = [r for r in out if r.account_id == 7]
    assert len(own) == 3 * 2 * 2 and {r.fold for r in own} == {2, 3, None}
    assert len({r.prob_lr for r in own}) == len({r.prob_rf for r in own}) == 2 and len({(r.prob_lr, r.prob_rf, r.fold) for r in own}) == 12


def test_the_log_hands_on_its_training_set(spark, data, monkeypatch):
    """The out-of-fold step takes a training set that its caller has fitted, and fits none of its own."""
    from riskloom.plans import q_models
    monkeypatch.setattr(q_models, "_OOF_CACHE", {})
    monkeypatch.setattr(q_models, "training_set", None)
    monkeypatch.setattr(ML, "oof_predictions", lambda df, feats, which: df.select("account_id", "label", "fold", *[F.lit(0.5).alias(f"prob_{n}") for n in which]))
    oof, _, feats = q_models._oof(spark, "own rows", prepared=(data.drop("fold"), FEATS))
    assert oof.count() == 500 and feats == FEATS


def test_search_does_not_depend_on_partitions(data):
    grids = {"lr": [{"regParam": 0.001}, {"regParam": 10.0}, {"regParam": 1000.0}], "rf": [{"maxDepth": 2}, {"maxDepth": 4}]}
    tables = []
    for parts in (1, 7):
        out = ML.search_on_fold(data.repartition(parts, "a"), FEATS, grids=grids)
        tables.append(sorted((r.model, r.params, r.step, r.budget, round(r.average_precision, 9), r.chosen) for r in out.collect()))
    assert tables[0] == tables[1]
    steps = {(m, s): sum(1 for r in tables[0] if r[0] == m and r[2] == s) for m in grids for s in (0, 1)}
    assert steps == {("lr", 0): 3, ("lr", 1): 2, ("rf", 0): 2, ("rf", 1): 1}
    for m in grids:
        last = [r for r in tables[0] if r[0] == m and r[2] == 1]
        assert [r for r in last if r[5]] == [max(last, key=lambda r: r[4])]


def test_the_evaluator_is_the_step_sum(data):
    scored = ML.learners()["lr"].fit(ML.assemble(data, FEATS)).transform(ML.assemble(data, FEATS))
    rows = sorted(((r.p, r.label) for r in scored.select(ML.prob1().alias("p"), "label").collect()), reverse=True)
    hits, total, ap = 0, sum(y for _, y in rows), 0.0
    for k, (_, y) in enumerate(rows):
        hits += y
        ap += y * hits / (k + 1) / total
    assert ML.AveragePrecision().evaluate(scored) == pytest.approx(ap, abs=1e-6)


def test_stacking_from_stored_numbers(data):
    oof = data.select("account_id", "label", *[(1 / (1 + F.exp(-F.col(c)))).alias(f"prob_{c}") for c in FEATS])
    fitted = ML.fit_stacking(oof, FEATS)
    want = {r.account_id: r.ensemble_prob for r in fitted.transform(oof).collect()}
    got = {r.account_id: r.ensemble_prob for r in ML.stacked_probability(oof, FEATS, **fitted.numbers()).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_reconstruction_error_against_numpy(spark):
    """Standardised, projected on the leading components, mean squared residual."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 2))
    x = np.hstack([base, base @ rng.normal(size=(2, 6)) + 0.1 * rng.normal(size=(200, 6))])
    names = [f"f{k}" for k in range(8)]
    df = spark.createDataFrame([(int(k), *[float(v) for v in r]) for k, r in enumerate(x)], "account_id long, " + ", ".join(f"{n} double" for n in names))
    got = {r.account_id: r.ae_raw for r in D.recon_error(df, df, names, "account_id", width=0.25).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, v = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = ((z - z @ v[:2].T @ v[:2]) ** 2).mean(1)
    assert [got[k] for k in range(200)] == pytest.approx(want.tolist(), abs=1e-8)


def test_append_can_be_retried(spark):
    path = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}/log"
    batch = lambda ids: spark.createDataFrame([(f"id{i}", i) for i in ids], "id string, v int")
    TB.append_new(batch([1, 2, 2]), path, "id", "monday")
    TB.append_new(batch([1, 2, 2]), path, "id", "monday")       # a retry replaces itself
    TB.append_new(batch([2, 3]), path, "id", "tuesday")         # what another batch holds stays out
    TB.append_new(batch([1, 2]), path, "id", "monday")
    TB.append_new(batch([]), path, "id", "wednesday")
    assert sorted((r.id, r.v, r.batch) for r in spark.read.parquet(path).collect()) == [("id1", 1, "monday"), ("id2", 2, "monday"), ("id3", 3, "tuesday")]
