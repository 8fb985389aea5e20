"""Rankers: similarity to actives, forests, boosted trees, linear and dense nets.

A ranker is fitted on a table with a vector column and a label and adds a
``score`` column. Spark ML does the distributed fitting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.clean import class_weights, sample_weights
from tamis.operators.metrics import avg_precision, roc_auc
from tamis.operators.neighbors import nearest
from tamis.session import materialize

FEATURES, LABEL, SCORE = "features", "label", "score"


class SimilarityRanker(Estimator):
    """Keeps the actives; the score is the highest Tanimoto similarity to one."""

    def __init__(self, fp: str, id_col: str, label: str, n_bits: int):
        super().__init__()
        self.fp, self.id_col, self.label, self.n_bits = fp, id_col, label, n_bits

    def _fit(self, dataset: DataFrame) -> SimilarityModel:
        actives = dataset.filter(F.col(self.label) == 1).select(
            F.col(self.id_col).alias("ref_id"), F.col(self.fp).alias("ref_fp")
        )
        return SimilarityModel(actives, self.fp, self.id_col, self.n_bits)


class SimilarityModel(Model):
    def __init__(self, actives: DataFrame, fp: str, id_col: str, n_bits: int):
        super().__init__()
        self.actives, self.fp, self.id_col, self.n_bits = actives, fp, id_col, n_bits

    def _transform(self, dataset: DataFrame) -> DataFrame:
        near = nearest(dataset, self.actives, self.fp, self.id_col, self.n_bits, out="__active")
        return near.withColumnsRenamed({"__active_similarity": SCORE, "__active_id": "nearest_active_id"})

    def save(self, path: str) -> None:
        self.actives.write.parquet(path)

    @staticmethod
    def load(spark, path: str, fp: str, id_col: str, n_bits: int) -> SimilarityModel:
        return SimilarityModel(spark.read.parquet(path), fp, id_col, n_bits)


def probability(model_output: DataFrame, column: str = "probability") -> DataFrame:
    return model_output.withColumn(SCORE, vector_to_array(column)[1])


_ML_OUTPUT = ("rawPrediction", "probability", "prediction")


@dataclass
class Ranker:
    """Shared face: ``fit(train, val)`` returns a model whose ``score(df)`` adds ``score``.

    ``conf`` entries are the names of the grids; unknown ones are refused.
    """

    conf: dict = field(default_factory=dict)
    label: str = LABEL
    features: str = FEATURES
    known: Sequence[str] = ()

    def __post_init__(self) -> None:
        wrong = set(self.conf) - set(self.known)
        if wrong:
            raise ValueError(f"unknown settings: {sorted(wrong)}")

    def get(self, key: str, default):
        return self.conf.get(key, default)

    def weighted(self, train: DataFrame) -> DataFrame:
        return class_weights(train, self.label, self.get("weight", "weighted_sample"), "__weight")

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> FittedRanker:
        raise NotImplementedError


@dataclass
class FittedRanker:
    model: object
    from_probability: bool

    def score(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        out = probability(out) if self.from_probability else out.withColumn(SCORE, F.col("prediction"))
        return out.drop(*[c for c in _ML_OUTPUT if c not in df.columns])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


TREES_AT_ONCE = 64  # trees of a boosted model that one plan applies side by side
_FOREST = ("n_estimators", "max_features", "min_samples_leaf", "max_depth", "weight", "seed")
_BOOST = (
    "n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bylevel", "min_child_weight",
    "weight", "seed", "patience", "metric",
)


class RankerRF(Ranker):
    """Random forest; the score is the share of votes for the active class."""

    def __init__(self, conf: dict | None = None, **kw):
        super().__init__(conf or {}, known=_FOREST, **kw)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> FittedRanker:
        forest = RandomForestClassifier(
            featuresCol=self.features,
            labelCol=self.label,
            weightCol="__weight",
            numTrees=self.get("n_estimators", 100),
            featureSubsetStrategy=self.get("max_features", "log2"),
            minInstancesPerNode=self.get("min_samples_leaf", 1),
            maxDepth=self.get("max_depth", 10),
            seed=self.get("seed", 0),
        )
        return FittedRanker(forest.fit(self.weighted(train)), True)


class RankerRFReg(Ranker):
    """Forest on the continuous label; it is judged on the binary one."""

    def __init__(self, conf: dict | None = None, **kw):
        super().__init__(conf or {}, known=_FOREST, **kw)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> FittedRanker:
        weighted = sample_weights(train, self.label, self.get("weight", "no_weight"), "__weight")
        forest = RandomForestRegressor(
            featuresCol=self.features,
            labelCol=self.label,
            weightCol="__weight",
            numTrees=self.get("n_estimators", 100),
            featureSubsetStrategy=self.get("max_features", "log2"),
            minInstancesPerNode=self.get("min_samples_leaf", 1),
            maxDepth=self.get("max_depth", 10),
            seed=self.get("seed", 0),
        )
        return FittedRanker(forest.fit(weighted), False)


@dataclass
class PrefixRanker:
    """The first trees of a boosted model."""

    model: object
    n_trees: int
    features: str = FEATURES

    def steps(self, df: DataFrame, name: str = "__steps") -> DataFrame:
        """Add an array with each tree's weighted output.

        The trees run in the JVM, side by side; after every ``TREES_AT_ONCE`` the
        rows are written, so that the plan does not grow with the trees.
        """
        df = df.withColumn(name, F.array().cast("array<double>"))
        weights, trees = list(self.model.treeWeights), self.model.trees
        for start in range(0, self.n_trees, TREES_AT_ONCE):
            some = range(start, min(self.n_trees, start + TREES_AT_ONCE))
            for i in some:
                tree = trees[i].copy()
                tree.setPredictionCol(f"__t{i}")
                tree.setFeaturesCol(self.features)
                df = tree.transform(df)
            more = F.array(*[F.col(f"__t{i}") * weights[i] for i in some])
            df = df.withColumn(name, F.concat(name, more)).drop(*[f"__t{i}" for i in some])
            if some.stop < self.n_trees:
                df = materialize(df, "margins")
        return df

    def score(self, df: DataFrame) -> DataFrame:
        """The margin: one model of the first trees, built and applied in the JVM."""
        n = self.n_trees
        model = boosted_model(df.sparkSession, self.model.trees[:n], self.model.treeWeights[:n])
        return model.setFeaturesCol(self.features).setPredictionCol(SCORE).transform(df)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def judge_margins(df: DataFrame, label: str, margins: str, metric: str = "precision", first: int = 1) -> DataFrame:
    """Metric of each round of the array ``margins``, a row's margins round by round: ``n_trees, value``.

    One scan: the array is exploded and ranked per round; ``first`` numbers its first entry.
    """
    long = df.select(label, F.posexplode(margins)).select(
        label, (F.col("pos") + first).alias("n_trees"), F.col("col").alias(SCORE)
    )
    judge = avg_precision if metric == "precision" else roc_auc
    return judge(long, SCORE, label, ["n_trees"]).toDF("n_trees", "value")


def running(steps: str) -> Column:
    """Sums of the array's first entries: a row's margin after each of its trees' ``steps``."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    add = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"] + x).alias("all"))
    return F.aggregate(steps, start, add, lambda a: a["all"])


def iteration_metrics(model, val: DataFrame, label: str, metric: str = "precision", features: str = FEATURES) -> DataFrame:
    """Metric of every prefix of a boosted model on the validation rows: ``n_trees, value``."""
    table = PrefixRanker(model, len(model.treeWeights), features).steps(val.select(features, label))
    return judge_margins(table.withColumn("__steps", running("__steps")), label, "__steps", metric)


def best_iteration(values: Sequence[tuple[int, float | None]], patience: int) -> int:
    """Last iteration that was at least as good as all before, stopping once more
    than ``patience`` iterations in a row were worse."""
    best, kept, worse = float("-inf"), 1, 0
    for n, value in values:
        value = float("-inf") if value is None else value
        if value >= best:
            best, kept, worse = value, n, 0
        elif worse >= patience:
            break
        else:
            worse += 1
    return kept


def select_iteration(
    model, val: DataFrame, label: str, metric: str = "precision", patience: int = 50, features: str = FEATURES
) -> PrefixRanker:
    """The prefix that ranks the validation rows best; its metrics are one row per tree."""
    rows = iteration_metrics(model, val, label, metric, features).orderBy("n_trees").collect()
    return PrefixRanker(model, best_iteration([(r.n_trees, r.value) for r in rows], patience), features)


ROUNDS_HELD = 10  # trees fitted between two writes of the margins
LEAST_CURVATURE = 1e-6  # of the logistic loss, far from the border


@dataclass
class BoostedRanker(PrefixRanker):
    """The kept trees, with the validation metric of every round that was fitted."""

    values: list[tuple[int, float | None]] = field(default_factory=list)

    def rounds(self, spark) -> DataFrame:
        """``n_trees, value, kept``: one row per judged round."""
        rows = [(n, value, int(n == self.n_trees)) for n, value in self.values]
        return spark.createDataFrame(rows, "n_trees int, value double, kept int")


class Booster(Ranker):
    """Gradient boosting a round at a time, stopped by the validation rows.

    A round fits one tree to the gradients at the margins so far; under the
    logistic loss rows weigh as much as the loss curves there, so that a leaf is
    a Newton step. Margins lie in a written table, renewed every ``ROUNDS_HELD``
    rounds, when the validation rows of these rounds are judged in one scan.
    Fitting ends once more than ``patience`` rounds in a row were worse, so at
    most ``ROUNDS_HELD`` - 1 trees are fitted in vain, and the best round is kept.

    ``min_child_weight`` is the least sum of curvatures (squares: of weights) in
    a child, ``colsample_bylevel`` the share of the features a node may split
    on, drawn at every node. Without validation rows all trees stay. Rows
    without label or features are left out; validation rows of one class have
    no metric, and then all trees stay.
    """

    logistic = True

    def __init__(self, conf: dict | None = None, **kw):
        super().__init__(conf or {}, known=_BOOST, **kw)

    def judged_by(self) -> str:
        return self.label

    def grown(self, rows: DataFrame, round_: int):
        """One tree on ``x, y, w, margin``."""
        residual = F.col("y") - F.col("margin")
        weight = F.col("w")
        if self.logistic:
            chance = 1.0 / (1.0 + F.exp(-F.col("margin")))
            curvature = F.greatest(chance * (1.0 - chance), F.lit(LEAST_CURVATURE))
            residual, weight = (F.col("y") - chance) / curvature, weight * curvature
        rows = rows.select("x", residual.alias("target"), weight.cast("double").alias("weight"))
        least, share = self.get("min_child_weight", 0.0), 0.0
        if least > 0:
            total = rows.agg(F.sum("weight")).first()[0] or 0.0
            share = least / total if total else 0.5
        columns = self.get("colsample_bylevel", 1.0)
        forest = RandomForestRegressor(
            featuresCol="x",
            labelCol="target",
            weightCol="weight",
            numTrees=1,
            bootstrap=False,
            maxDepth=self.get("max_depth", 5) if share < 0.5 else 0,  # no child could weigh enough
            minWeightFractionPerNode=min(share, 0.499999),
            featureSubsetStrategy="all" if columns >= 1 else str(float(columns)),
            subsamplingRate=self.get("subsample", 1.0),
            seed=self.get("seed", 0) + round_,
        )
        return forest.fit(rows).trees[0]

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> BoostedRanker:
        weight = "__weight"
        fitted_to = self.weighted(train).select(
            F.col(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), F.col(weight).alias("w"), F.lit(False).alias("judged")
        )
        if val is not None:
            others = val.select(
                F.col(self.features).alias("x"), F.col(self.judged_by()).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(True).alias("judged")
            )
            fitted_to = fitted_to.unionByName(others)
        rows = materialize(fitted_to.dropna(subset=["x", "y"]).withColumn("margin", F.lit(0.0)), "margins")
        trees, weights, values = [], [], []
        patience, n_trees = self.get("patience", 50), self.get("n_estimators", 20)
        while len(trees) < n_trees:
            start, state, margins = len(trees), rows, []
            for i in range(start, min(n_trees, start + ROUNDS_HELD)):
                tree = self.grown(state.filter(~F.col("judged")), i)
                # As the first tree of squares is fitted to the label itself, it counts whole.
                step = self.get("learning_rate", 0.1) if self.logistic or i else 1.0
                trees.append(tree)
                weights.append(step)
                margins.append(f"m{i}")
                tree.setFeaturesCol("x").setPredictionCol("__tree")
                state = tree.transform(state).withColumn("margin", F.col("margin") + F.lit(float(step)) * F.col("__tree"))
                state = state.withColumn(f"m{i}", F.col("margin")).drop("__tree")
            if val is None and len(trees) == n_trees:
                break
            rows = materialize(state.select("x", "y", "w", "judged", "margin", F.array(*margins).alias("margins")), "margins")
            if val is not None:
                metric = self.get("metric", "precision")
                judged = judge_margins(rows.filter("judged"), "y", "margins", metric, start + 1)
                found = {r.n_trees: r.value for r in judged.collect()}  # one row per round
                values += [(i + 1, found.get(i + 1)) for i in range(start, len(trees))]
                if len(trees) - best_iteration(values, patience) > patience:
                    break
        kept = best_iteration(values, patience) if values else len(trees)
        return BoostedRanker(boosted_model(train.sparkSession, trees, weights), kept, self.features, values)


def boosted_model(spark, trees: Sequence, weights: Sequence[float]) -> GBTRegressionModel:
    """Spark's boosted model of the given trees."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    listed = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        listed[i], shares[i] = tree._java_obj, float(weight)
    name = f"boosted_{trees[0].uid}_{len(trees)}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(name, listed, shares))


class RankerGBT(Booster):
    """Boosted trees under the logistic loss; the score is the margin."""


class RankerGBTReg(Booster):
    """Boosted regression; the iteration is chosen on the binary validation label."""

    logistic = False

    def __init__(self, conf: dict | None = None, binary_label: str = "active", **kw):
        super().__init__(conf, **kw)
        self.binary_label = binary_label

    def judged_by(self) -> str:
        return self.binary_label

    def weighted(self, train: DataFrame) -> DataFrame:
        return sample_weights(train, self.label, self.get("weight", "no_weight"), "__weight")


class RankerLinear(Ranker):
    """Elastic-net logistic regression, the linear booster's counterpart."""

    def __init__(self, conf: dict | None = None, **kw):
        super().__init__(conf or {}, known=("reg_lambda", "reg_alpha", "n_estimators", "weight"), **kw)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> FittedRanker:
        ridge, lasso = self.get("reg_lambda", 0.1), self.get("reg_alpha", 0.0)
        model = LogisticRegression(
            featuresCol=self.features,
            labelCol=self.label,
            weightCol="__weight",
            maxIter=self.get("n_estimators", 100),
            regParam=ridge + lasso,
            elasticNetParam=lasso / (ridge + lasso) if ridge + lasso else 0.0,
        ).fit(self.weighted(train))
        return FittedRanker(model, True)


class RankerMLP(Ranker):
    """Dense net. Spark's has no row weights, so the active class is repeated instead.

    ``epochs`` lists the iteration counts to try; with validation rows the best
    of them by ROC area or precision is kept.
    """

    def __init__(self, conf: dict | None = None, **kw):
        super().__init__(conf or {}, known=("layers", "epochs", "weight", "seed", "metric"), **kw)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> FittedRanker:
        n_features = len(train.select(vector_to_array(self.features).alias("f")).first().f)
        counts = train.agg(
            F.count_if(F.col(self.label) == 0).alias("n0"), F.count_if(F.col(self.label) == 1).alias("n1")
        ).first()
        repeat = 1
        if self.get("weight", "weighted_sample") == "weighted_sample" and counts.n1:
            repeat = max(1, round(counts.n0 / counts.n1))
        times = F.when(F.col(self.label) == 1, repeat).otherwise(1)
        rows = train.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).drop("__copy")
        judge = avg_precision if self.get("metric", "precision") == "precision" else roc_auc
        best, kept = None, None
        for epochs in self.get("epochs", [50]):
            model = MultilayerPerceptronClassifier(
                featuresCol=self.features,
                labelCol=self.label,
                layers=[n_features, *self.get("layers", [32]), 2],
                maxIter=epochs,
                seed=self.get("seed", 0),
            ).fit(rows)
            fitted = FittedRanker(model, True)
            if val is None:
                kept = fitted
                continue
            value = judge(fitted.score(val), SCORE, self.label).first()[0]
            if kept is None or (value is not None and (best is None or value >= best)):
                best, kept = value, fitted
        return kept
