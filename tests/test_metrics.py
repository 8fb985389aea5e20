import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import metrics


def frame(spark, scores, labels):
    rows = [(i, float(s), y) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "id long, score double, label int")


def golden(spark, n, actives, k, hits):
    """n rows with the given actives, ``hits`` of them among the k best."""
    score = (F.lit(n) - F.col("id")).cast("double")
    label = (F.col("id") < hits) | ((F.col("id") >= k) & (F.col("id") < k + actives - hits))
    return spark.range(n).select("id", score.alias("score"), label.cast("int").alias("label"))


def test_published_enrichment(spark):
    row = metrics.enrichment(golden(spark, 42727, 55, 427, 34), "score", "label", "id", [0.01]).first()
    assert (row.k, row.actives, row.hits) == (427, 55, 34)
    assert row.ef == pytest.approx(61.8182, abs=1e-4)
    assert row.nef == pytest.approx(0.618182, abs=1e-6)


def test_capped_enrichment(spark):
    row = metrics.enrichment(golden(spark, 42727, 55, 42, 12), "score", "label", "id", [0.001]).first()
    assert (row.k, row.hits) == (42, 12)
    assert row.ef == pytest.approx(218.1818, abs=1e-4)
    assert row.nef == pytest.approx(0.285714, abs=1e-6)


def test_no_actives_is_null(spark):
    row = metrics.enrichment(frame(spark, [1, 2, 3], [0, 0, 0]), "score", "label", "id", [0.5]).first()
    assert row.ef is None and row.ef_max is None and row.nef is None


def test_sentinel_does_not_count(spark):
    row = metrics.enrichment(frame(spark, [3, 2, 1], [1, -1, 0]), "score", "label", "id", [0.5]).first()
    assert (row.k, row.actives, row.hits) == (1, 1, 1)


def test_ties(spark):
    assert metrics.roc_auc(frame(spark, [1, 1, 2, 2], [0, 1, 0, 1]), "score", "label").first()[0] == 0.5
    assert metrics.avg_precision(frame(spark, [2, 2, 1], [1, 0, 1]), "score", "label").first()[0] == pytest.approx(7 / 12)


def test_one_class_is_null(spark):
    assert metrics.roc_auc(frame(spark, [1, 2], [1, 1]), "score", "label").first()[0] is None


def test_against_pairs(spark, many_ranges):
    rng = random.Random(1)
    scores = [rng.randrange(25) for _ in range(400)]
    labels = [int(rng.random() < 0.2) for _ in scores]
    df = frame(spark, scores, labels)
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "score", "label").first()[0] == pytest.approx(auc)
    ap, seen = 0.0, 0
    for t in sorted(set(scores), reverse=True):
        above = [y for s, y in zip(scores, labels) if s >= t]
        ap += (sum(above) - seen) / len(pos) * sum(above) / len(above)
        seen = sum(above)
    assert metrics.avg_precision(df, "score", "label").first()[0] == pytest.approx(ap)


def test_hits_at_n_refuses_too_many(spark):
    df = frame(spark, [1, 2], [1, 0])
    assert metrics.hits_at_n(df, "score", "label", "id", 1).first().hits == 0
    with pytest.raises(Exception, match="exceeds"):
        metrics.hits_at_n(df, "score", "label", "id", 3).collect()


def test_report_has_test_only_lines(spark):
    df = frame(spark, range(40), [int(i % 4 == 0) for i in range(40)])
    df = df.withColumn("split", F.when(F.col("id") < 20, "train").otherwise("test"))
    lines = {(r.split, r.metric) for r in metrics.evaluation_report(df, "split", "score", "label", "id", [0.1]).collect()}
    assert ("train", "roc") in lines and ("test", "NEF") in lines
    assert ("train", "NEF") not in lines and not any(s == "val" for s, _ in lines)


def test_evaluators(spark):
    df = frame(spark, [1, 1, 2, 2], [0, 1, 0, 1])
    assert metrics.RocAucEvaluator().evaluate(df) == 0.5
    assert metrics.AveragePrecisionEvaluator(labelCol="label", predictionCol="score").evaluate(df) == 0.5
    assert metrics.RocAucEvaluator().isLargerBetter()
