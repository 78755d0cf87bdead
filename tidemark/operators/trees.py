"""Learners of Spark ML behind the same two calls: fit on a frame, predict with a column.

Spark ML keeps its training rows by partition, some ten times as large as in their files, so they are dealt in parts of bounded rows."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spread import dealt


def _fitted(rows: DataFrame, features: list[str], ml: Estimator) -> PipelineModel:
    """ml fitted on rows; parts that were dealt and sorted are kept while it reads them again and again."""
    kept = dealt(rows)
    if kept is not rows:
        kept.persist()
    try:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), ml]).fit(kept)
    finally:
        if kept is not rows:
            kept.unpersist()


def forest(train: DataFrame, features: list[str], y: str, trees: int = 20, depth: int = 5, seed: int = 1729) -> PipelineModel:
    """A random forest; rows with a missing feature or target are left out."""
    ml = RandomForestRegressor(featuresCol="_x", labelCol=y, predictionCol="forecast", numTrees=trees, maxDepth=depth, seed=seed)
    return _fitted(train.select(*features, y).dropna(subset=[y]), features, ml)


def boosted(train: DataFrame, features: list[str], y: str, rounds: int = 10, depth: int = 3, seed: int = 1729) -> PipelineModel:
    """Boosted trees for the absolute error."""
    ml = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="forecast", lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed)
    return _fitted(train.select(*features, y).dropna(subset=[y]), features, ml)


def forecasts(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df (rows without missing features) with its forecast."""
    return model.transform(df).drop("_x")


def two_heads(train: DataFrame, features: list[str], label: str, sideways: int, up: int) -> tuple[PipelineModel, PipelineModel]:
    """One classifier for sideways or not, one for up or down among the rest."""
    make = lambda: LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_l", maxIter=20, regParam=1e-3)
    rows = train.select(*features, label).filter(F.col(label).isNotNull())
    flag = lambda v: (F.col(label) == v).cast("double")
    return _fitted(rows.withColumn("_y", flag(sideways)), features, make()), _fitted(rows.filter(F.col(label) != sideways).withColumn("_y", flag(up)), features, make())


def three_classes(heads: tuple[PipelineModel, PipelineModel], df: DataFrame) -> DataFrame:
    """df with p_down, p_sideways, p_up: (1 - s)(1 - u), s, (1 - s)u."""
    from pyspark.ml.functions import vector_to_array

    def scored(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
        return model.transform(rows).withColumn(name, vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_l")

    out = scored(heads[1], scored(heads[0], df, "_s"), "_u")
    s, u = F.col("_s"), F.col("_u")
    parts: dict[str, Column] = {"p_down": (1 - s) * (1 - u), "p_sideways": s, "p_up": (1 - s) * u}
    return out.withColumns(parts).drop("_s", "_u")
