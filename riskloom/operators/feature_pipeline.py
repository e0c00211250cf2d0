"""The ten feature stages as one pyspark.ml estimator whose fitted model is saved and loaded.

``FeaturePipeline.fit`` drops leakage columns, fits the stages 1-9, ranks the engineered columns by mean |attribution| of boosted
trees, keeps the best and every ``risk_`` / ``te_`` column, and drops what is left of all-zero, constant and near-constant columns.
``FeaturePipelineModel.transform`` applies all of it to any rows, with or without a label. A saved model is a folder: MLlib's
metadata, one row of JSON with the numbers of all stages, and the lookup tables (of any size) as Parquet.
"""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.exprs import q
from riskloom.operators import features as FE
from riskloom.operators import models as ML
from riskloom.operators.profile import useless_columns
from riskloom.session import cut_lineage


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, convert)


class _PipelineParams(Params):
    idCol = _param("idCol", "row id, never a feature", TypeConverters.toString)
    labelCol = _param("labelCol", "0/1 target", TypeConverters.toString)
    categoricalCols = _param("categoricalCols", "columns to encode by frequency and target", TypeConverters.toListString)
    numericCols = _param("numericCols", "candidates of the row statistics, interactions and outlier flags", TypeConverters.toListString)
    missingCols = _param("missingCols", "columns whose missing values count", TypeConverters.toListString)
    dateCol = _param("dateCol", "opening date as text", TypeConverters.toString)
    accountTypeCol = _param("accountTypeCol", "column of the account-type risk map", TypeConverters.toString)
    employmentCol = _param("employmentCol", "column of the employment risk map", TypeConverters.toString)
    channelCol = _param("channelCol", "column of the channel risk map", TypeConverters.toString)
    leakageCols = _param("leakageCols", "columns known to leak the label", TypeConverters.toListString)
    leakageCorrelation = _param("leakageCorrelation", "numeric columns with at least this |correlation| with the label leak; above 1: none", TypeConverters.toFloat)
    topN = _param("topN", "features kept by rank of their mean |attribution|; 0: no selection", TypeConverters.toInt)
    maxIter = _param("maxIter", "boosting rounds of the selecting model", TypeConverters.toInt)
    fillValue = _param("fillValue", "what a missing value is to the selecting model", TypeConverters.toFloat)
    nearShare = _param("nearShare", "a column of which one value has more than this share is dropped", TypeConverters.toFloat)

    def of(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def given(self, name: str) -> str | None:
        return self.of(name) or None


class FeaturePipeline(Estimator, _PipelineParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the whole chain; all its settings are ``Param``s, so it is saved and loaded as any MLlib estimator."""

    @keyword_only
    def __init__(self, **own):
        super().__init__()
        self._setDefault(idCol="account_id", labelCol="label", categoricalCols=[], numericCols=[], missingCols=[], dateCol="", accountTypeCol="", employmentCol="", channelCol="",
                         leakageCols=[], leakageCorrelation=0.95, topN=150, maxIter=10, fillValue=-9999.0, nearShare=0.999)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FeaturePipelineModel:
        label, cats, nums = self.of("labelCol"), self.of("categoricalCols"), self.of("numericCols")
        leaks = self._leakage(df)
        cats, nums, missing = [[c for c in cols if c not in leaks] for cols in (cats, nums, self.of("missingCols"))]
        base = df.drop(*leaks)
        # the fits read base columns alone, so none runs the chain of the stages before it
        stages = [FE.MissingFeatures(missing, label).fit(base)] if missing else []
        if cats:
            stages += [FE.FrequencyEncoder(cats).fit(base), FE.TargetEncoder(cats, label).fit(base)]
        if self.given("dateCol"):
            stages.append(FE.DateFeatures(self.of("dateCol")).fit(base))
        outliers = None
        if nums:
            outliers = FE.OutlierFeatures(nums, 100).fit(base)
            stages += [FE.RatioFeatures(nums, 200).fit(base), outliers,
                       FE.BehaviourFeatures(nums, 300, self.given("accountTypeCol"), self.given("employmentCol"), self.given("channelCol")).fit(base)]
        stages.append(FE.RiskProfileFeatures().fit(outliers.transform(base, with_flags=False) if outliers else base))
        if nums:   # no other stage reads the interactions: they come last, for hundreds of columns make every later step of the plan wide
            stages.append(FE.InteractionFeatures(nums, [f"{c}_te" for c in cats], 15).fit(base))
        model = FeaturePipelineModel(stages, {c: "leakage" for c in leaks}, [], [])
        self._copyValues(model)
        made = cut_lineage(model.engineered(df))
        numeric = [f.name for f in made.schema.fields if f.name not in (self.of("idCol"), label) and isinstance(f.dataType, T.NumericType)]
        if self.of("topN") > 0:
            model.importance = self._importance(made, numeric)
            chosen = ML.select_features([(c, rank) for c, _, rank in model.importance], self.of("topN"))
            model.dropped |= {c: "not selected" for c in numeric if c not in chosen}
        else:
            chosen = numeric
        useless = {r.column_name: r.reason for r in useless_columns(made, label, chosen, self.of("nearShare")).collect()}
        model.dropped |= useless
        model.selected = [c for c in chosen if c not in useless]
        return model

    def _leakage(self, df: DataFrame) -> list[str]:
        """Known leakage columns, and numeric ones that are nearly the label (pairwise non-null rows, one aggregate)."""
        known, most = [c for c in self.of("leakageCols") if c in df.columns], self.of("leakageCorrelation")
        y = F.col(q(self.of("labelCol"))).cast("double")
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (self.of("idCol"), self.of("labelCol"), *known)]
        if most > 1 or not numeric:
            return known
        r = df.agg(*[F.abs(F.try_divide(F.covar_pop(F.col(q(c)).cast("double"), F.when(F.col(q(c)).isNotNull(), y)), F.stddev_pop(F.col(q(c))) * F.stddev_pop(F.when(F.col(q(c)).isNotNull(), y)))).alias(f"r{i}")
                     for i, c in enumerate(numeric)]).first()
        return known + [c for i, c in enumerate(numeric) if r[f"r{i}"] is not None and r[f"r{i}"] >= most]

    def _importance(self, made: DataFrame, numeric: list[str]) -> list[tuple[str, float, int]]:
        """(feature, mean |attribution|, rank) under boosted trees with balanced weights, in column order."""
        label = self.of("labelCol")
        names = [f"x{i}" for i in range(len(numeric))]   # no dots or signs in the assembler's names
        x = made.selectExpr(f"CAST({q(label)} AS DOUBLE) AS y", *[f"coalesce(CAST({q(c)} AS DOUBLE), {float(self.of('fillValue'))}D) AS {n}" for c, n in zip(numeric, names)])
        count = x.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
        if not count["n"] or not 0 < count["p"] < count["n"]:
            raise ValueError("selection needs rows of both classes")
        x = x.withColumn("w", F.when(F.col("y") == 1, count["n"] / (2 * count["p"])).otherwise(count["n"] / (2 * (count["n"] - count["p"]))))
        trees = GBTClassifier(featuresCol="features", labelCol="y", weightCol="w", maxIter=self.of("maxIter"), maxDepth=4, stepSize=0.1, seed=ML.SEED)
        fitted = trees.fit(ML.assemble(x, names).select("features", "y", "w"))
        found = {r.feature: r for r in ML.mean_attributions(x, names, fitted).collect()}   # a row a feature
        return [(c, found[n].mean_abs_attribution, found[n]["rank"]) for c, n in zip(numeric, names)]


class FeaturePipelineModel(Model, _PipelineParams, MLReadable, MLWritable):
    """Fitted stages, dropped columns with their reasons, the importance table, and the columns that ``transform`` returns."""

    def __init__(self, stages: list, dropped: dict[str, str], importance: list[tuple[str, float, int]], selected: list[str]):
        super().__init__()
        self.stages, self.dropped, self.importance, self.selected = stages, dropped, importance, selected

    def engineered(self, df: DataFrame) -> DataFrame:
        """All columns of the stages 1-9 for the rows of ``df`` (leakage columns dropped first)."""
        out = df.drop(*[c for c, reason in self.dropped.items() if reason == "leakage"])
        for stage in self.stages:
            out = stage.transform(out)
        return FE.RiskProfileModel.anomaly_score(out, exclude=[self.of("idCol"), self.of("labelCol")])

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in (self.of("idCol"), self.of("labelCol")) if c in df.columns]
        return self.engineered(df).select(*[F.col(q(c)) for c in (*keep, *self.selected)])

    def importance_table(self, spark: SparkSession) -> DataFrame:
        """feature, mean_abs_attribution, rank, selected and why a column was dropped."""
        rows = [(c, v, r, c in set(self.selected), self.dropped.get(c)) for c, v, r in self.importance]
        return spark.createDataFrame(rows, "feature string, mean_abs_attribution double, rank int, selected boolean, dropped string")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: FeaturePipelineModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        stages = []
        for k, stage in enumerate(self.model.stages):
            state = {}
            for f in fields(stage):
                value = getattr(stage, f.name)
                if isinstance(value, DataFrame):
                    value.write.mode("overwrite").parquet(f"{path}/lookups/{k}-{f.name}")
                else:
                    state[f.name] = value
            stages.append({"stage": type(stage).__name__, "state": state})
        own = {"stages": stages, "dropped": self.model.dropped, "importance": self.model.importance, "selected": self.model.selected}
        spark.createDataFrame([(json.dumps(own),)], "json string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeaturePipelineModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        own = json.loads(spark.read.parquet(f"{path}/state").first()["json"])
        stages = []
        for k, saved in enumerate(own["stages"]):
            kind = getattr(FE, saved["stage"])
            lookups = {f.name: spark.read.parquet(f"{path}/lookups/{k}-{f.name}") for f in fields(kind) if f.name not in saved["state"]}
            stages.append(kind(**saved["state"], **lookups))
        model = self.cls(stages, own["dropped"], [tuple(x) for x in own["importance"]], own["selected"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
