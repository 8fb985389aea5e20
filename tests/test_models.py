import math

import pytest
from pyspark.sql import functions as F

from queries.base import N_BITS, compounds
from tamis.functions.bits import bits_to_vector
from tamis.models import ensembles, rankers
from tamis.operators.metrics import roc_auc
from tamis.operators.splits import stratified_folds
from tamis.plans.crossval import grid, run_cv
from tamis.session import materialize, work_path
from tamis.sources import model_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    df = stratified_folds(compounds(spark, SF), "id", "active")
    return materialize(
        df.select("id", "fold_id", "fp", bits_to_vector("bits").alias("features"), F.col("active").cast("double").alias("label")),
        "rows",
    )


def scores(df):
    return {r.id: r.score for r in df.select("id", "score").collect()}


def test_prefix_of_all_trees_is_the_model(spark, rows):
    ranker = rankers.RankerGBT({"n_estimators": 4, "max_depth": 2})
    fitted = ranker.fit(rows)
    raw = fitted.model.setFeaturesCol("features").transform(rows).select("id", F.col("prediction").alias("score"))
    a, b = scores(fitted.score(rows)), scores(raw)
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_iteration_metrics_judge_each_prefix(spark, rows):
    model = rankers.RankerGBT({"n_estimators": 3, "max_depth": 2}).fit(rows).model
    values = {r.n_trees: r.value for r in rankers.iteration_metrics(model, rows, "label", "roc").collect()}
    for n in (1, 3):
        scored = rankers.PrefixRanker(model, n).score(rows)
        assert values[n] == pytest.approx(roc_auc(scored, "score", "label").first()[0])


def test_best_iteration_and_patience():
    best = rankers.best_iteration
    assert best([(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6)], 50) == 3
    assert best([(1, 0.5), (2, 0.4), (3, 0.3), (4, 0.9)], 1) == 1
    assert best([(1, 0.5), (2, 0.4), (3, 0.9)], 1) == 3


def test_boosting_stops_with_its_patience(spark, rows, monkeypatch):
    monkeypatch.setattr(rankers, "ROUNDS_HELD", 3)
    conf = {"n_estimators": 40, "patience": 2, "max_depth": 2, "learning_rate": 0.5, "metric": "roc"}
    train, val = rows.filter("fold_id < 7"), rows.filter("fold_id >= 7")
    fitted = rankers.RankerGBT(conf).fit(train, val)
    assert fitted.n_trees == rankers.best_iteration(fitted.values, 2)
    assert len(fitted.values) < 40 and len(fitted.values) - fitted.n_trees <= 2 + 3
    assert [r.kept for r in fitted.rounds(spark).orderBy("n_trees").collect()].index(1) + 1 == fitted.n_trees
    again = {r.n_trees: r.value for r in rankers.iteration_metrics(fitted.model, val, "label", "roc").collect()}
    assert again == {n: pytest.approx(v, abs=1e-9) for n, v in fitted.values}
    # The same trees whether margins are written after three rounds or after all.
    monkeypatch.setattr(rankers, "ROUNDS_HELD", 40)
    longer = rankers.RankerGBT({**conf, "n_estimators": len(fitted.values)}).fit(train, val)
    assert longer.values == [(n, pytest.approx(v, abs=1e-9)) for n, v in fitted.values]


def test_boosted_leaves_are_newton_steps(spark):
    from pyspark.ml.functions import array_to_vector

    data = [(float(i % 2), float(i % 8 == 0 or i % 2 and i % 10 != 1)) for i in range(80)]
    df = spark.createDataFrame(data, "x double, label double").withColumn("features", array_to_vector(F.array("x")))
    conf = {"n_estimators": 2, "max_depth": 1, "learning_rate": 1.0, "weight": "no_weight"}
    margins = {r.x: r.score for r in rankers.RankerGBT(conf).fit(df).score(df).collect()}
    for x, margin in margins.items():
        y, expected = [l for v, l in data if v == x], 0.0
        for _ in range(2):
            p = 1 / (1 + math.exp(-expected))
            expected += sum(l - p for l in y) / (len(y) * p * (1 - p))
        assert margin == pytest.approx(expected)
    heavy = rankers.RankerGBT({**conf, "min_child_weight": 30.0}).fit(df).score(df)  # 80 rows weigh 20 at first
    assert heavy.select("score").distinct().count() == 1


def test_boosted_squares_approach_the_label(spark, rows):
    df = rows.withColumn("value", F.col("id") % 5 + F.col("label"))
    ranker = rankers.RankerGBTReg({"n_estimators": 3, "max_depth": 2, "colsample_bylevel": 0.5}, label="value", binary_label="label")
    fitted = ranker.fit(df, df.filter("fold_id = 1"))
    assert 1 <= fitted.n_trees <= 3 and len(fitted.values) == 3
    whole = ranker.fit(df.withColumn("value", F.when(F.col("id") % 7 != 0, F.col("value")))).score(df)
    means = whole.agg(F.avg("score"), F.avg("value")).first()
    assert means[0] == pytest.approx(means[1], abs=0.2)


def test_models_survive_storage(spark, rows):
    for ranker in (
        rankers.RankerRF({"n_estimators": 3, "max_depth": 2}).fit(rows),
        rankers.RankerGBT({"n_estimators": 2, "max_depth": 2}).fit(rows),
    ):
        path = work_path(spark, "model")
        model_store.save(spark, ranker, path)
        assert scores(model_store.load(spark, path).score(rows)) == scores(ranker.score(rows))
    similar = rankers.SimilarityRanker("fp", "id", "label", N_BITS).fit(rows)
    path = work_path(spark, "model")
    model_store.save(spark, similar, path)
    assert scores(model_store.load(spark, path).transform(rows)) == scores(similar.transform(rows))


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError):
        rankers.RankerRF({"trees": 3})


def test_ensembles(spark, rows):
    models = {
        "forest": rankers.RankerRF({"n_estimators": 3, "max_depth": 3}).fit(rows),
        "linear": rankers.RankerLinear({"n_estimators": 5}).fit(rows),
    }
    voted = ensembles.vote(rows, models).select("forest", "linear", "score").collect()
    assert all(r.score == max(r.forest, r.linear) for r in voted)
    stacked = ensembles.Stacking(models).fit(rows).score(rows)
    assert stacked.count() == rows.count() and roc_auc(stacked, "score", "label").first()[0] > 0.5


def test_cross_validation_table(spark, rows):
    assert [c["b"] for c in grid({"a": [1, 2], "b": [3, 4]})] == [3, 4, 3, 4]
    out = run_cv(
        rows, {"linear": rankers.RankerLinear}, {"linear": {"n_estimators": [3], "reg_lambda": [0.1, 1.0]}}, [0], "id", "label", use_val=True
    )
    assert {(r.setting, r.split) for r in out.collect()} == {(i, s) for i in (0, 1) for s in ("train", "val", "test")}


def test_percent_ranks_of_unlike_scores(spark):
    df = spark.createDataFrame([(1, 0.1, 90.0), (2, 0.1, 10.0), (3, 0.9, 50.0), (4, 0.5, None)], "id long, a double, b double")
    out = {r.id: (r.a, r.b) for r in ensembles.percent_ranks(df, ["a", "b"]).collect()}
    assert out == {1: (0.0, 1.0), 2: (0.0, 0.0), 3: (1.0, 0.5), 4: (pytest.approx(2 / 3), None)}


def test_a_constant_ranker_fails_the_report(spark):
    from queries.models import checked
    from tamis.operators.metrics import evaluation_report

    rows = [(i, s, float(i % 3 == 0), 0.5) for s in ("train", "test") for i in range(30)]
    report = evaluation_report(spark.createDataFrame(rows, "id long, split string, label double, score double"), "split", "score", "label", "id", [0.01, 0.1])
    out = {(r.split, r.metric, r.ratio): r for r in checked(report).collect()}
    assert out["train", "roc", None].told_apart is False
    assert not out["test", "NEF", 0.01].in_range and out["test", "NEF", 0.1].in_range


def test_stacking_is_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from tamis.models import ensembles, rankers
    from tamis.sources import model_store

    rows = [(i, float(i % 4 == 0), [float(i % 4 == 0), float(i % 7)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>").withColumn("features", array_to_vector("x"))
    models = {"forest": rankers.RankerRF({"n_estimators": 3, "max_depth": 2}).fit(df), "linear": rankers.RankerLinear({"n_estimators": 5}).fit(df)}
    stacked = ensembles.Stacking(models).fit(df)
    model_store.save(spark, stacked, str(tmp_path / "stacked"))
    again = model_store.load(spark, str(tmp_path / "stacked"))
    one, two = ([r.score for r in m.score(df).orderBy("id").collect()] for m in (stacked, again))
    assert one == two and len(set(one)) > 1


def test_nan_is_no_reading(spark):
    from tamis.operators import aggregates

    df = spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", None), ("d", 0.05)], "name string, x double")
    r = aggregates.describe(df, ["x"]).first()
    assert (r["count"], r["mean"], r["min"], r["max"]) == (2, 0.275, 0.05, 0.5)
    assert aggregates.over_threshold(df, F.lit(1).alias("p"), "x").first()[1:] == (4, 1)
    means = {r.name: r.x for r in aggregates.with_mean_std(df, "name", ["x"], 3).collect()}
    assert means["mean"] == 0.275 and means["std"] == 0.318
