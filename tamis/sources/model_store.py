"""Saving and loading fitted rankers."""

from __future__ import annotations

import json

from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession

from tamis.models.ensembles import Stacking
from tamis.models.rankers import FittedRanker, PrefixRanker, SimilarityModel

_KINDS = {
    k.__name__: k
    for k in (
        GBTClassificationModel,
        GBTRegressionModel,
        LogisticRegressionModel,
        MultilayerPerceptronClassificationModel,
        RandomForestClassificationModel,
        RandomForestRegressionModel,
    )
}


def save(spark: SparkSession, ranker, path: str) -> None:
    """Model files beside a one-row description of how to read them; an ensemble's models lie in it."""
    if isinstance(ranker, Stacking):
        if ranker.second is None:
            raise ValueError("fit first")
        for name, model in ranker.models.items():
            save(spark, model, f"{path}/base/{name}")
        save(spark, ranker.second, f"{path}/second")
        about = (Stacking.__name__, json.dumps(list(ranker.models)), ranker.label, 0)
    elif isinstance(ranker, SimilarityModel):
        about = ("similarity", ranker.fp, ranker.id_col, ranker.n_bits)
        ranker.save(f"{path}/model")
    elif isinstance(ranker, PrefixRanker):
        about = (type(ranker.model).__name__, ranker.features, "", ranker.n_trees)
        ranker.save(f"{path}/model")
    else:
        about = (type(ranker.model).__name__, "", "", int(ranker.from_probability))
        ranker.save(f"{path}/model")
    spark.createDataFrame([about], "kind string, a string, b string, n int").write.json(f"{path}/about")


def load(spark: SparkSession, path: str):
    about = spark.read.schema("kind string, a string, b string, n int").json(f"{path}/about").first()
    if about.kind == "similarity":
        return SimilarityModel.load(spark, f"{path}/model", about.a, about.b, about.n)
    if about.kind == Stacking.__name__:
        stacked = Stacking({name: load(spark, f"{path}/base/{name}") for name in json.loads(about.a)}, about.b)
        stacked.second = load(spark, f"{path}/second")
        return stacked
    model = _KINDS[about.kind].load(f"{path}/model")
    if about.kind.startswith("GBT"):
        return PrefixRanker(model, about.n, about.a)
    return FittedRanker(model, bool(about.n))
