import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import ranking, splits
from tamis.operators.selection import values_at


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(i, rng.choice("abc"), int(rng.random() < 0.1), float(rng.randrange(40))) for i in range(500)]
    return spark.createDataFrame(data, "id long, lib string, y int, s double")


def test_stratified_folds_conserve_rows(rows):
    out = splits.stratified_folds(rows, "id", "y").toPandas()
    assert len(out) == 500 and out["id"].is_unique
    sizes = out.groupby(["y", "fold_id"]).size()
    for y in (0, 1):
        assert sizes[y].max() - sizes[y].min() <= 1
        assert sizes[y].tolist() == sorted(sizes[y], reverse=True)


def test_fold_remainder(spark):
    df = spark.range(23).withColumn("y", F.lit(1))
    sizes = splits.stratified_folds(df, "id", "y").groupBy("fold_id").count().orderBy("fold_id").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_seeds_shuffle(rows):
    one, two = (splits.stratified_folds(rows, "id", "y", seed=s).toPandas().set_index("id")["fold_id"] for s in (1, 2))
    assert (one.sort_index() != two.sort_index()).any()


def test_library_folds_balance_actives(rows):
    out = splits.library_folds(rows, "id", "lib", "y").toPandas()
    assert len(out) == 500
    actives = out.groupby("fold_id")["y"].sum()
    assert actives.max() - actives.min() <= 2


def test_small_label_groups_go_one_to_a_fold(spark):
    df = spark.createDataFrame([(i, "rare" if i < 4 else None) for i in range(44)], "id long, g string")
    out = splits.multi_label_folds(df, "id", ["g"]).toPandas()
    assert out[out["g"] == "rare"]["fold_id"].is_unique
    assert set(out[out["g"].isna()].groupby("fold_id").size()) == {4}


def test_rotation():
    r = splits.rotation
    assert [(r(i)["test"], r(i)["val"]) for i in (0, 4, 5)] == [([1], [0]), ([9], [8]), ([9], [8])]
    assert r(0)["train"] == list(range(2, 8)) and r(4)["train"] == list(range(8)) == r(5)["train"]
    assert r(0, False)["train"] == [0, *range(2, 8)]
    assert r(4, False)["train"] == list(range(8)) and r(5, False)["train"] == list(range(9))
    with pytest.raises(ValueError):
        r(6)


def test_holdout(rows):
    out = splits.holdout(rows, "id", "y", 0.8, seed=1).toPandas()
    for _, part in out.groupby("y"):
        assert (part["split"] == "train").sum() == round(0.8 * len(part) + 1e-9)


def test_best_per_and_top_models(rows):
    p = rows.toPandas().sort_values(["s", "id"], ascending=[False, True])
    best = {r.lib: r.id for r in ranking.best_per(rows, "lib", "s", "id").collect()}
    assert best == p.groupby("lib")["id"].first().to_dict()
    top = ranking.top_models(rows, "lib", "id", "s", 5).toPandas()
    for lib, part in top.sort_values("rank").groupby("lib"):
        assert part["id"].tolist() == p[p["lib"] == lib]["id"].head(5).tolist()


@pytest.mark.parametrize("slack", [1 << 16, 10])
def test_top_k_of_any_size(rows, monkeypatch, slack):
    monkeypatch.setattr(ranking, "SLACK", slack)
    p = rows.toPandas().sort_values(["s", "id"], ascending=[False, True])["id"].tolist()
    for k in (1, 50, 400, 600):
        assert [r.id for r in ranking.top_k(rows, "s", "id", k).collect()] == p[:k]
    t = rows.toPandas().assign(t=lambda x: -x["s"]).sort_values(["t", "id"], ascending=[False, True])["id"].tolist()
    both = ranking.overlap_at_k(rows.withColumn("t", -F.col("s")), "s", "t", "id", "id", [50, 400]).collect()
    assert {r.k: r.n_shared for r in both} == {k: len(set(p[:k]) & set(t[:k])) for k in (50, 400)}


def test_a_key_repeated_in_a_list_counts_once(spark):
    df = spark.createDataFrame([(1, "a", 9.0, 1.0), (2, "a", 8.0, 9.0), (3, "b", 7.0, 8.0), (4, "c", 1.0, 7.0)], "id int, k string, x double, y double")
    out = {r.k: r.n_shared for r in ranking.overlap_at_k(df, "x", "y", "id", "k", [1, 2, 3]).collect()}
    assert out == {1: 1, 2: 1, 3: 2}


def test_expand_and_fraction(spark, rows):
    df = spark.createDataFrame([("a", 2), ("b", 0)], "k string, n int")
    assert [(r.k, r.repeat) for r in ranking.expand(df, "n").collect()] == [("a", 1), ("a", 2)]
    assert ranking.top_fraction(rows, "s", "id", 0.15).count() == 75
    assert ranking.sample_n(rows, "id", 20, 1).collect() == ranking.sample_n(rows, "id", 20, 1).collect()


def test_coverage(spark):
    df = spark.createDataFrame([(1, 1, 9.0, 0.0), (2, 1, 0.0, 5.0), (3, 0, 8.0, 4.0)], "id int, y int, a double, b double")
    out = {r.model: r for r in ranking.coverage(df, ["a", "b"], "y", "id", 1).collect()}
    assert (out["a"].actives, out["a"].union_minus_model, out["a"].vote_minus_model) == (1, 1, 0)
    assert (out["b"].union_minus_model, out["b"].model_minus_vote) == (1, 1)


def test_cut_keeps_the_best(spark, rows):
    value = F.col("s").cast("double")
    cut = lambda df, v, k: values_at(df, v, {"cut": lambda n: F.greatest(n - k, F.lit(0))}, slack=30)[0]["cut"]
    assert 30 <= rows.filter(value >= cut(rows, value, 30)).count() <= 60
    assert rows.filter(value >= cut(rows, value, 600)).count() == rows.filter(value.isNotNull()).count()
    ties = spark.range(300).withColumn("s", F.lit(1.0))  # no cut helps
    assert [r.id for r in ranking.top_k(ties, "s", "id", 20).collect()] == list(range(20))


def test_ids_may_be_text(spark):
    df = spark.createDataFrame([("b", "x", 1.0), ("a", "x", 1.0), ("c", "y", 2.0)], "id string, k string, s double")
    assert sorted(r.id for r in ranking.best_per(df, "k", "s", "id").collect()) == ["a", "c"]
