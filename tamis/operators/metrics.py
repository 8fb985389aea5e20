"""Ranking metrics: ROC area, average precision, hits, enrichment.

Rows are put in one global order (score descending, id ascending) with running
counts, then folded per distinct score; every metric follows from that table,
for any number of groups (splits, models, iterations) in one pass. A label of
-1 or NULL is a row that was not measured and does not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.clean import SENTINEL
from tamis.operators.order import running_totals
from tamis.operators.ranking import best_first, rank_by, top_k


def measured(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.filter(
        F.col(label).isNotNull() & (F.col(label) != SENTINEL) & F.col(score).isNotNull() & ~F.isnan(score)
    )


def score_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its rows, actives and counts from the top.

    Equal scores are folded before the only shuffle that sorts.
    """
    folded = (
        measured(df.withColumn(score, F.col(score).cast("double")), score, label)
        .groupBy(*by, score)
        .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("actives"))
    )
    return running_totals(
        folded, [F.col(score).desc()], {"upto": "n", "actives_upto": "actives"}, by, totals=True
    )


def _roc() -> Column:
    """Chance that an active ranks above an inactive, half for ties; NULL with one class."""
    positives, negatives = F.max("actives_upto_total"), F.max("upto_total") - F.max("actives_upto_total")
    others = F.col("n") - F.col("actives")
    below = (F.col("upto_total") - F.col("actives_upto_total")) - (F.col("upto") - F.col("actives_upto"))
    area = F.sum(F.col("actives") * (below + F.lit(0.5) * others))
    return area / F.nullif((positives * negatives).cast("double"), F.lit(0.0))


def _precision() -> Column:
    """Step-wise average precision; NULL without an active."""
    positives = F.max("actives_upto_total").cast("double")
    gain = F.sum(F.col("actives") * F.col("actives_upto").cast("double") / F.col("upto"))
    return gain / F.nullif(positives, F.lit(0.0))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return score_curve(df, score, label, by).groupBy(*by).agg(_roc().alias("roc_auc"))


def avg_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return score_curve(df, score, label, by).groupBy(*by).agg(_precision().alias("average_precision"))


def hits_at_n(df: DataFrame, score: str, label: str, id_col: str, n: int) -> DataFrame:
    """Actives among the n best; asking for more rows than there are fails."""
    best = top_k(measured(df, score, label), score, id_col, n)
    return best.agg(
        F.lit(n).cast("long").alias("n"),
        F.when(F.count("*") >= n, F.coalesce(F.sum(label), F.lit(0)))
        .otherwise(F.raise_error(F.lit("n exceeds the number of rows")).cast("long"))
        .alias("hits"),
    )


def hits_at_ratio(df: DataFrame, score: str, label: str, id_col: str, ratio: float) -> DataFrame:
    """Actives among the int(ratio * rows) best."""
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be within [0, 1]")
    ranked = rank_by(measured(df, score, label), score, id_col, size="size")
    n = F.floor(F.col("size") * F.lit(ratio))
    return ranked.agg(
        F.max(n).alias("n"), F.sum(F.when(F.col("rank") <= n, F.col(label)).otherwise(0)).alias("hits")
    )


def _ranked_curve(
    df: DataFrame, score: str, label: str, id_col: str, ratios: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Curve rows plus, per ratio, the actives inside the int(n * ratio) best."""
    rows = measured(df, score, label).select(
        *by, id_col, F.col(score).cast("double").alias(score), F.col(label).cast("long").alias(label)
    )
    ranked = running_totals(
        rows, best_first(score, id_col), {"upto": F.lit(1), "actives_upto": label}, by, totals=True
    )
    inside = [F.col("upto") <= F.floor(F.col("upto_total") * F.lit(float(r))) for r in ratios]
    return ranked.groupBy(*by, score).agg(
        F.count("*").alias("n"),
        F.sum(label).alias("actives"),
        *[F.max(c).alias(c) for c in ("upto", "actives_upto", "upto_total", "actives_upto_total")],
        *[F.sum(F.when(c, F.col(label)).otherwise(0)).alias(f"hits_{i}") for i, c in enumerate(inside)],
    )


def _ratio_table(curve: DataFrame, ratios: Sequence[float], by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    totals = curve.groupBy(*by).agg(
        F.max("upto_total").alias("n"),
        F.max("actives_upto_total").alias("actives"),
        *[F.sum(f"hits_{i}").alias(f"hits_{i}") for i in range(len(ratios))],
        *extra,
    )
    def entry(i: int, r: float) -> Column:
        k = F.floor(F.col("n") * F.lit(float(r)))
        return F.struct(F.lit(float(r)).alias("ratio"), k.alias("k"), F.col(f"hits_{i}").alias("hits"))
    return totals.withColumn("__at", F.array(*[entry(i, r) for i, r in enumerate(ratios)])).drop(
        *[f"hits_{i}" for i in range(len(ratios))]
    )


def _ef(hits: Column, actives: Column, ratio: Column) -> Column:
    return hits / F.nullif(actives.cast("double"), F.lit(0.0)) / ratio


def _ef_max(k: Column, actives: Column, ratio: Column) -> Column:
    return F.least(k, actives) / F.nullif(actives * ratio, F.lit(0.0))


def enrichment(
    df: DataFrame, score: str, label: str, id_col: str, ratios: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """EF, its maximum and NEF at each ratio; NULL where there is no active."""
    curve = _ranked_curve(df, score, label, id_col, ratios, by)
    table = _ratio_table(curve, ratios, by).select(*by, "n", "actives", F.inline("__at"))
    a, r = F.col("actives"), F.col("ratio")
    return table.select(
        *by,
        "ratio",
        "k",
        "actives",
        "hits",
        _ef(F.col("hits"), a, r).alias("ef"),
        _ef_max(F.col("k"), a, r).alias("ef_max"),
    ).withColumn("nef", F.col("ef") / F.nullif(F.col("ef_max"), F.lit(0.0)))


def ef(df: DataFrame, score: str, label: str, id_col: str, ratios: Sequence[float]) -> DataFrame:
    return enrichment(df, score, label, id_col, ratios).select("ratio", "k", "actives", "hits", "ef", "ef_max")


def nef(df: DataFrame, score: str, label: str, id_col: str, ratios: Sequence[float]) -> DataFrame:
    return enrichment(df, score, label, id_col, ratios).select("ratio", "nef")


def evaluation_report(
    df: DataFrame,
    split: str,
    score: str,
    label: str,
    id_col: str,
    ratios: Sequence[float],
    hit_ratio: float = 0.01,
    by: Sequence[str] = (),
) -> DataFrame:
    """Long table ``split, metric, ratio, value``.

    Every split present gets precision, roc, hits among the int(n * hit_ratio)
    best and its actives; the test split also EF and NEF at each ratio.
    Regression scores are judged on the binary label by passing that label.
    """
    keys = [*by, split]
    wanted = [hit_ratio, *ratios]
    curve = _ranked_curve(df, score, label, id_col, wanted, keys)
    totals = _ratio_table(
        curve, wanted, keys, [_precision().alias("precision"), _roc().alias("roc")]
    )
    a, at = F.col("actives"), F.col("__at")

    def line(metric: str, ratio: float | None, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(ratio).cast("double").alias("ratio"), value.cast("double").alias("value")
        )

    common = [
        line("precision", None, F.col("precision")),
        line("roc", None, F.col("roc")),
        line("hits", hit_ratio, at[0]["hits"]),
        line("actives", None, a),
    ]
    test_only = []
    for i, r in enumerate(ratios, start=1):
        value = _ef(at[i]["hits"], a, at[i]["ratio"])
        top = _ef_max(at[i]["k"], a, at[i]["ratio"])
        test_only += [line("EF", r, value), line("NEF", r, value / F.nullif(top, F.lit(0.0)))]
    lines = F.when(F.col(split) == "test", F.array(*common, *test_only)).otherwise(F.array(*common))
    return totals.select(*keys, F.inline(lines))


def diff_metrics(a: DataFrame, b: DataFrame, on: Sequence[str], cols: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Absolute difference of recomputed and recorded metrics, and whether all are within ``tol``."""
    left = a.select(*on, *[F.col(c).alias(f"__a_{c}") for c in cols])
    right = b.select(*on, *[F.col(c).alias(f"__b_{c}") for c in cols])
    def diff(c: str) -> Column:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        return F.when(x.isNull() & y.isNull(), 0.0).otherwise(F.abs(x - y)).alias(f"diff_{c}")

    diffs = [diff(c) for c in cols]
    table = left.join(right, list(on), "full").select(*on, *diffs)
    same = F.lit(True)
    for c in cols:
        same = same & F.coalesce(F.col(f"diff_{c}") <= tol, F.lit(False))
    return table.withColumn("within", same.cast("int"))


class _RankingEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Base of the evaluators usable in Spark ML model selection."""

    @keyword_only
    def __init__(self, *, predictionCol: str = "score", labelCol: str = "label"):
        super().__init__()
        self._setDefault(predictionCol="score", labelCol="label")
        self._set(**self._input_kwargs)

    def isLargerBetter(self) -> bool:
        return True

    def _scored(self, dataset: DataFrame) -> DataFrame:
        p = self.getPredictionCol()
        if dataset.schema[p].dataType.typeName() != "double":
            dataset = dataset.withColumn(p, vector_to_array(p)[1])
        return dataset

    def _metric(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _evaluate(self, dataset: DataFrame) -> float:
        value = self._metric(self._scored(dataset)).first()[0]
        return float("nan") if value is None else value


class RocAucEvaluator(_RankingEvaluator):
    def _metric(self, dataset: DataFrame) -> DataFrame:
        return roc_auc(dataset, self.getPredictionCol(), self.getLabelCol())


class AveragePrecisionEvaluator(_RankingEvaluator):
    def _metric(self, dataset: DataFrame) -> DataFrame:
        return avg_precision(dataset, self.getPredictionCol(), self.getLabelCol())
