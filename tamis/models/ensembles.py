"""Second-level models over the scores of several rankers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tamis.models.rankers import SCORE, FittedRanker
from tamis.operators.clean import class_weights
from tamis.operators.joins import max_vote
from tamis.operators.order import running_totals


def base_scores(df: DataFrame, models: Mapping[str, object]) -> DataFrame:
    """One score column per model, added row by row: no join is needed."""
    for name, model in models.items():
        df = model.score(df).withColumnRenamed(SCORE, name)
    return df


class Stacking:
    """Base scores as features of an elastic-net logistic model."""

    def __init__(self, models: Mapping[str, object], label: str = "label", reg: float = 0.1):
        self.models, self.label, self.reg = dict(models), label, reg
        self.assembler = VectorAssembler(
            inputCols=list(self.models), outputCol="__stack", handleInvalid="keep"
        )
        self.second: FittedRanker | None = None

    def features(self, df: DataFrame) -> DataFrame:
        return self.assembler.transform(base_scores(df, self.models).fillna(0.0, subset=list(self.models)))

    def fit(self, train: DataFrame) -> Stacking:
        rows = class_weights(self.features(train), self.label, name="__weight")
        model = LogisticRegression(
            featuresCol="__stack", labelCol=self.label, weightCol="__weight", regParam=self.reg
        ).fit(rows)
        self.second = FittedRanker(model, True)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if self.second is None:
            raise ValueError("fit first")
        return self.second.score(self.features(df)).drop("__stack")


def percent_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each score as its percent rank, 0 for the lowest and 1 for the highest; ties share the lowest.

    Puts probabilities and regression outputs on one scale. Equal scores are
    counted first, so what is sorted and joined back has one row per score.
    """
    for c in cols:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
        run = running_totals(counts, [c], {"__upto": "__n"}, totals=True)
        below = (F.col("__upto") - F.col("__n")).cast("double")
        share = F.when(F.col("__upto_total") > 1, below / (F.col("__upto_total") - 1)).otherwise(0.0)
        df = df.join(run.select(c, share.alias("__share")), c, "left").withColumn(c, F.col("__share")).drop("__share")
    return df


def vote(df: DataFrame, models: Mapping[str, object], scale: bool = False) -> DataFrame:
    """Score is the row maximum of the base scores, as they are or as percent ranks."""
    scores = base_scores(df, models)
    if scale:
        scores = percent_ranks(scores, list(models))
    return scores.withColumn(SCORE, max_vote(list(models)))
