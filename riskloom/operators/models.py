"""Classifiers, out-of-fold scoring, stacking, attributions and inference
(M1, M4-M9, M16, M18-M20, F10) on MLlib.

Learners are MLlib estimators (distributed training): gradient-boosted trees,
random forest and weighted logistic regression stand in for the reference's
external boosting libraries. Class imbalance is handled with ``weightCol``
(n_neg / n_pos for positives). Out-of-fold probabilities come from one fit
per fold on the other folds (k small fits, each a distributed job).
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import q
from riskloom.operators.anomaly import fit_impute_medians, impute
from riskloom.session import cut_lineage

SEED = 42


def prepare_training(df: DataFrame, id_col: str, label_col: str, feature_cols: list[str]) -> tuple[DataFrame, list[str], dict]:
    """M1: drop id-like and all-NULL columns, median-then-0 fill, class weights (M2)."""
    nn = df.agg(*[F.count(F.col(q(c))).alias(c) for c in feature_cols]).first()
    feats = [c for c in feature_cols if nn[c] > 0 and c != id_col]
    med = fit_impute_medians(df, feats)
    out = impute(df.select(id_col, label_col, *feats), med)
    w = out.agg(F.sum((F.col(label_col) == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos_w = float((w["n"] - w["p"]) / max(w["p"], 1))
    out = out.withColumn("weight", F.when(F.col(label_col) == 1, F.lit(pos_w)).otherwise(F.lit(1.0)))
    return out, feats, {"medians": med, "pos_weight": pos_w}


def learners(label_col: str = "label") -> dict:
    """M5-M7: three distributed learners (boosted trees, forest, weighted linear)."""
    return {
        "gbt": GBTClassifier(featuresCol="features", labelCol=label_col, weightCol="weight", maxIter=20,
                             maxDepth=4, stepSize=0.1, seed=SEED),
        "rf": RandomForestClassifier(featuresCol="features", labelCol=label_col, weightCol="weight", numTrees=30,
                                     maxDepth=6, seed=SEED),
        "lr": LogisticRegression(featuresCol="features", labelCol=label_col, weightCol="weight", maxIter=100,
                                 regParam=0.01, standardization=True),
    }


def assemble(df: DataFrame, feats: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep").transform(df)


def prob1(col: str = "probability"):
    return vector_to_array(F.col(col))[1]


#: Fits that run at the same time (each is a distributed job of its own).
POOL = 4
#: Rows of a partition of the training table.
TRAIN_ROWS = 200_000


def training_table(df: DataFrame, feats: list[str], id_col: str) -> DataFrame:
    """The assembled training table in an order and partitions that follow from its ids and row count alone, so that samples taken
    inside a fit don't change with how the input came; checkpointed and kept (MEMORY_AND_DISK), for many fits read it several times
    each. The caller unpersists it."""
    parts = max(1, -(-df.count() // TRAIN_ROWS))
    return cut_lineage(assemble(df, feats).repartition(parts, F.xxhash64(q(id_col))).sortWithinPartitions(id_col)).persist()


def boosted(train: DataFrame, label_col: str = "label", validation: Column | None = None, max_iter: int = 60, tol: float = 0.01, **own):
    """M5: boosted trees; with ``validation`` (a condition) the rows that fulfil it only tell when to stop: trees end where their error
    there no longer falls by ``tol``. Those rows must not be the ones that are scored."""
    own = {"featuresCol": "features", "labelCol": label_col, "weightCol": "weight", "maxIter": max_iter, "maxDepth": 4, "stepSize": 0.1, "seed": SEED, **own}
    if validation is not None:
        train = train.withColumn("__validation", validation)
        own |= {"validationIndicatorCol": "__validation", "validationTol": tol}
    return GBTClassifier(**own).fit(train)


def pooled(jobs: list, pool: int = POOL) -> list:
    """Results of the calls ``jobs``, ``pool`` at a time."""
    with ThreadPoolExecutor(pool) as threads:
        return list(threads.map(lambda job: job(), jobs))


def oof_predictions(df: DataFrame, feats: list[str], fold_col: str = "fold", label_col: str = "label",
                    id_col: str = "account_id", which: tuple[str, ...] = ("gbt", "rf", "lr"), k: int = 5) -> DataFrame:
    """M9: each row scored by the model trained on the other folds; one column per learner. The fits share a checkpointed
    table and run POOL at a time; boosted trees stop early by the fold after the scored one, which they don't train on.

    The models of a fold score its rows one after another in one pass, so the columns need no join where ids are unique. The result is
    that of joins on the id all the same: rows without an id are left out, and rows that share one meet each other's probabilities."""
    data = training_table(df, feats, id_col)
    fold, key = F.col(fold_col), q(id_col)

    def fitted(name: str, f: int):
        train = data.filter(fold != f)
        return boosted(train, label_col, fold == (f + 1) % k, 30) if name == "gbt" and k > 2 else learners(label_col)[name].fit(train)

    def scored(f: int, models: list) -> DataFrame:
        rows = data.filter(fold == f).select(id_col, label_col, fold_col, "features")
        for name, model in zip(which, models):
            rows = model.transform(rows).withColumn(f"prob_{name}", prob1()).drop("rawPrediction", "probability", "prediction")
        return rows.drop("features")
    models = pooled([partial(fitted, name, f) for name in which for f in range(k)])
    parts = max(data.rdd.getNumPartitions(), k)
    out = cut_lineage(reduce(DataFrame.unionByName, [scored(f, models[f::k]) for f in range(k)]).coalesce(parts))
    unique = data.groupBy(id_col).count().filter(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty()
    data.unpersist()
    if unique:
        return out.filter(F.col(key).isNotNull())
    shared = df.select(id_col, label_col, fold_col)
    for name in which:
        shared = shared.join(out.select(id_col, f"prob_{name}"), id_col)
    return cut_lineage(shared)


class AveragePrecision(Evaluator):
    """M10's step-sum average precision as an MLlib evaluator."""

    def __init__(self, label_col: str = "label"):
        super().__init__()
        self.label_col = label_col

    def _evaluate(self, scored: DataFrame) -> float:
        from riskloom.operators.metrics import binary_metrics
        pairs = scored.select(F.col(self.label_col).alias("label"), prob1().alias("p"))
        return float(binary_metrics(pairs, "p", "label").first()["average_precision"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


#: M8: the points tried for each learner, and the rounds (or iterations) of the steps of the search.
GRIDS = {"gbt": [{"maxDepth": d, "stepSize": s} for d in (3, 5) for s in (0.1, 0.3)],
         "rf": [{"maxDepth": d, "featureSubsetStrategy": f} for d in (5, 8) for f in ("sqrt", "0.5")],
         "lr": [{"regParam": r, "elasticNetParam": e} for r in (0.001, 0.1) for e in (0.0, 0.5)]}
BUDGETS = {"gbt": ("maxIter", (4, 12)), "rf": ("numTrees", (6, 24)), "lr": ("maxIter", (20, 100))}


def search_on_fold(df: DataFrame, feats: list[str], fold_col: str = "fold", label_col: str = "label", id_col: str = "account_id",
                   fold: int = 0, grids: dict = GRIDS) -> DataFrame:
    """M8: hyper-parameters by average precision (M10) on one fold of models trained on the others: model, params, step, budget,
    average_precision, chosen.

    Successive halving: all points of a learner are fitted with the small budget, the better half again with the next; the best of
    the last step is chosen (ties: the earlier point). Points of all learners run POOL at a time on one checkpointed table."""
    data, score = training_table(df, feats, id_col), AveragePrecision(label_col)
    train, held = data.filter(F.col(fold_col) != fold), data.filter(F.col(fold_col) == fold)

    def tried(name: str, point: dict, budget: int) -> float:
        learner = learners(label_col)[name]
        learner = learner.copy({learner.getParam(k): v for k, v in {**point, BUDGETS[name][0]: budget}.items()})
        return score.evaluate(learner.fit(train).transform(held))
    rows, left = [], {name: list(range(len(points))) for name, points in grids.items()}
    steps = max(len(BUDGETS[name][1]) for name in grids)
    for step in range(steps):
        asked = [(name, i, BUDGETS[name][1][step]) for name, points in left.items() for i in points]
        found = pooled([partial(tried, name, grids[name][i], budget) for name, i, budget in asked])
        for name in left:
            own = sorted(((-ap, i, budget) for (n, i, budget), ap in zip(asked, found) if n == name))
            last = step == steps - 1
            rows += [(name, json.dumps(grids[name][i], sort_keys=True), step, budget, -ap, last and r == 0) for r, (ap, i, budget) in enumerate(own)]
            left[name] = [i for _, i, _ in own[:-(-len(own) // 2)]]
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, params string, step int, budget int, average_precision double, chosen boolean")


@dataclass
class StackModel:
    scaler: object
    meta: object
    base: list[str]

    def numbers(self) -> dict:
        """Means, standard deviations, coefficients and intercept: all that ``stacked_probability`` needs."""
        return {"means": self.scaler.mean.toArray().tolist(), "stds": self.scaler.std.toArray().tolist(),
                "coefs": self.meta.coefficients.toArray().tolist(), "intercept": float(self.meta.intercept)}

    def transform(self, oof: DataFrame) -> DataFrame:
        x = oof.withColumn("prob_mean", sum(F.col(f"prob_{b}") for b in self.base) / len(self.base))
        x = VectorAssembler(inputCols=[f"prob_{b}" for b in self.base] + ["prob_mean"], outputCol="meta_raw").transform(x)
        x = self.scaler.transform(x)
        return self.meta.transform(x).withColumn("ensemble_prob", prob1()).drop(
            "meta_raw", "meta_features", "rawPrediction", "probability", "prediction")


def stacked_probability(df: DataFrame, base: list[str], means: list[float], stds: list[float], coefs: list[float], intercept: float) -> DataFrame:
    """M16 from stored numbers: the base probabilities and their mean, standardised, through the logistic function. One projection."""
    values = [F.col(f"prob_{b}") for b in base]
    values.append(sum(values[1:], values[0]) / len(base))
    z = [(v - F.lit(m)) / F.lit(s) if s else F.lit(0.0) for v, m, s in zip(values, means, stds)]
    margin = sum((F.lit(c) * x for c, x in zip(coefs, z)), F.lit(float(intercept)))
    return df.select("*", (1.0 / (1.0 + F.exp(-margin))).alias("ensemble_prob"))


def fit_stacking(oof: DataFrame, base: list[str], label_col: str = "label", C: float = 0.1) -> StackModel:
    """Base OOF probabilities + their mean -> standardise -> balanced LR.
    ``regParam = 1 / (C * sum of weights)`` maps scikit-learn's C to MLlib's objective."""
    x = oof.withColumn("prob_mean", sum(F.col(f"prob_{b}") for b in base) / len(base))
    x = VectorAssembler(inputCols=[f"prob_{b}" for b in base] + ["prob_mean"], outputCol="meta_raw").transform(x)
    scaler = StandardScaler(inputCol="meta_raw", outputCol="meta_features", withMean=True, withStd=True).fit(x)
    x = scaler.transform(x)
    st = x.agg(F.sum((F.col(label_col) == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    n, p = st["n"], max(st["p"], 1)
    # balanced weights: n / (2 n_class)
    x = x.withColumn("weight", F.when(F.col(label_col) == 1, n / (2.0 * p)).otherwise(n / (2.0 * max(n - p, 1))))
    reg = 1.0 / (C * n)
    meta = LogisticRegression(featuresCol="meta_features", labelCol=label_col, weightCol="weight",
                              regParam=reg, standardization=False).fit(x)
    return StackModel(scaler, meta, base)


def linear_attributions(df: DataFrame, feats: list[str], coefs: list[float], means: dict[str, float],
                        id_col: str = "account_id", top_n: int = 5) -> DataFrame:
    """M18 (linear, exact): a_f = coef_f * (x_f - mean_f); per row the top-n by |a| with
    signed value, built as an in-row array sorted with array_sort (no shuffle)."""
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("feature"),
                               (F.lit(float(coefs[i])) * (F.col(q(c)) - F.lit(float(means[c])))).alias("value"))
                      for i, c in enumerate(feats)])
    srt = F.array_sort(items, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                       .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                       .otherwise(F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)))
    x = df.select(id_col, F.posexplode(F.slice(srt, 1, top_n)).alias("pos", "a"))
    return x.select(id_col, (F.col("pos") + 1).alias("rank"), "a.feature", "a.value",
                    F.when(F.col("a.value") >= 0, "positive").otherwise("negative").alias("direction"))


def global_attribution(df: DataFrame, feats: list[str], coefs: list[float], means: dict[str, float],
                       k: int = 50) -> DataFrame:
    """M18 global: mean |a_f| over all rows (one aggregate), ranked, top k."""
    row = df.agg(*[F.avg(F.abs(F.lit(float(coefs[i])) * (F.col(q(c)) - F.lit(float(means[c]))))).alias(c)
                   for i, c in enumerate(feats)])
    parts = ", ".join(f"'{c}', `{c}`" for c in feats)
    long = row.selectExpr(f"stack({len(feats)}, {parts}) AS (feature, mean_abs_attribution)")
    return long.orderBy(F.desc("mean_abs_attribution"), "feature").limit(k)


def align_features(df: DataFrame, feature_list: list[str], keep: list[str]) -> DataFrame:
    """The stored feature order; absent columns become 0.0, extras dropped, NULL -> 0."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(q(c)).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
            for c in feature_list]
    return df.select(*keep, *cols)


def prob_tier(p):
    """M20 probability tier: >= .75 CRITICAL, >= .50 HIGH, >= .25 MEDIUM, else LOW."""
    return F.when(p >= 0.75, "CRITICAL").when(p >= 0.50, "HIGH").when(p >= 0.25, "MEDIUM").otherwise("LOW")


def inference(df: DataFrame, base_cols: list[str], thresholds: dict[str, float], ensemble_col: str,
              ens_threshold: float = 0.5) -> DataFrame:
    """Label (MULE / LEGITIMATE), tier, number of base models at/above their own threshold."""
    p = F.col(ensemble_col)
    flags = sum((F.col(c) >= thresholds.get(c, 0.5)).cast("int") for c in base_cols)
    return df.select("*", F.col(ensemble_col).alias("mule_prob"),
                     F.when(p >= ens_threshold, "MULE").otherwise("LEGITIMATE").alias("risk_label"),
                     prob_tier(p).alias("risk_tier"), flags.alias("flag_count"))


def select_features(importance: list[tuple[str, int]], top_n: int = 150, must_keep: tuple[str, ...] = ("risk_", "te_")) -> list[str]:
    """the ``top_n`` features by rank, then every other must-keep column in the order given (ordered, de-duplicated)."""
    top = [c for c, rank in sorted(importance, key=lambda x: x[1]) if rank <= top_n]
    return list(dict.fromkeys(top + [c for c, _ in importance if c.startswith(must_keep)]))


# ---- M18 for trees: path (Saabas) attribution over a broadcast node table -------------

def tree_node_table(model) -> "pd.DataFrame":
    """Flatten a fitted tree ensemble (GBT / forest) into a node table:
    tree, node, feature (-1 = leaf), threshold, left, right, value, weight. Its size is
    bounded by trees x (2^(depth+1) - 1) rows, so it can be broadcast."""
    import pandas as pd
    trees = model.trees
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0 / len(trees)] * len(trees)
    rows = []
    for t, (tree, w) in enumerate(zip(trees, weights)):
        stack = [(tree._java_obj.rootNode(), 0)]
        next_id = 1
        while stack:
            node, nid = stack.pop()
            if node.getClass().getSimpleName() == "InternalNode":
                left, right = next_id, next_id + 1
                next_id += 2
                split = node.split()
                rows.append((t, nid, int(split.featureIndex()), float(split.threshold()), left, right,
                             float(node.prediction()), float(w)))
                stack.append((node.leftChild(), left))
                stack.append((node.rightChild(), right))
            else:
                rows.append((t, nid, -1, 0.0, -1, -1, float(node.prediction()), float(w)))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "value", "weight"])


class PathAttribution:
    """Contribution of each feature to the margin of a tree ensemble: over all trees, weight x (child value - node value) at
    every split on the feature along a row's path (left when x <= threshold). bias + contributions = margin."""

    def __init__(self, nodes: "pd.DataFrame", n_features: int):
        self.n_features = n_features
        self.trees = []
        for _, g in nodes.groupby("tree"):
            g = g.sort_values("node")
            self.trees.append((float(g["weight"].iloc[0]), *[g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value")]))
        self.bias = sum(w * value[0] for w, _, _, _, _, value in self.trees)

    def __call__(self, x):
        import numpy as np
        out, rows = np.zeros((len(x), self.n_features)), np.arange(len(x))
        for w, feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            active = feature[node] >= 0
            while active.any():
                f = np.where(active, feature[node], 0)
                after = np.where(active, np.where(x[rows, f] <= threshold[node], left[node], right[node]), node)
                out[rows, f] += np.where(active, (value[after] - value[node]) * w, 0.0)
                node = after
                active = feature[node] >= 0
        return out


def tree_attributions(df: DataFrame, feats: list[str], model, id_col: str = "account_id",
                      top_n: int = 5) -> DataFrame:
    """Per row: the top-n contributions by |value| (``PathAttribution``), their total over all features, and the bias."""
    import numpy as np
    import pandas as pd
    kernel = df.sparkSession.sparkContext.broadcast(PathAttribution(tree_node_table(model), len(feats)))

    def run(it):
        own = kernel.value
        for pdf in it:
            contrib = own(pdf[feats].to_numpy(dtype=float))
            order = np.argsort(-np.abs(contrib), axis=1, kind="stable")[:, :top_n]
            k = order.shape[1]
            yield pd.DataFrame({
                id_col: np.repeat(pdf[id_col].to_numpy(), k),
                "rank": np.tile(np.arange(1, k + 1), len(pdf)),
                "feature": np.array(feats, dtype=object)[order].reshape(-1),
                "value": np.take_along_axis(contrib, order, axis=1).reshape(-1),
                "total": np.repeat(contrib.sum(axis=1), k),
                "bias": own.bias})

    schema = f"{id_col} long, rank int, feature string, value double, total double, bias double"
    return df.select(id_col, *feats).mapInPandas(run, schema)


def mean_attributions(df: DataFrame, feats: list[str], model) -> DataFrame:
    """Feature, mean_abs_attribution, rank over all rows of ``df`` (desc, ties by name).

    A distributed reduction: each task adds up |contribution| per feature over its rows and returns one row a feature; the sums
    meet in one aggregate whose size is the number of features. ``df`` holds the features as doubles without NULL. Only features
    that some tree splits on are read: the contribution of any other is zero in every row."""
    import numpy as np
    import pandas as pd
    nodes = tree_node_table(model)
    used = sorted(set(nodes["feature"][nodes["feature"] >= 0]))
    place = {f: k for k, f in enumerate(used)}
    nodes["feature"] = [place.get(f, -1) for f in nodes["feature"]]
    kernel = df.sparkSession.sparkContext.broadcast(PathAttribution(nodes, len(used)))

    def run(it):
        total, n = np.zeros(len(feats)), 0
        for pdf in it:
            total[used] += np.abs(kernel.value(pdf.to_numpy(dtype=float))).sum(axis=0)
            n += len(pdf)
        yield pd.DataFrame({"feature": feats, "total": total, "n": n})

    sums = df.select(*[F.col(q(feats[f])) for f in used or [0]]).mapInPandas(run, "feature string, total double, n long").groupBy("feature").agg(
        (F.sum("total") / F.sum("n")).alias("mean_abs_attribution"))
    order = Window.orderBy(F.desc("mean_abs_attribution"), "feature")   # a row a feature
    return sums.withColumn("rank", F.row_number().over(order))
