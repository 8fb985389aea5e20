"""Rows without a key, a fingerprint or a number, and models of many trees."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamis.models import rankers
from tamis.operators.clean import class_weights
from tamis.operators.identity import group_identities
from tamis.operators.joins import exclude_shared, max_vote
from tamis.operators.neighbors import leader_clusters
from tamis.operators.ranking import best_per, rank_by, top_k
from tamis.operators.splits import library_folds


def test_rows_without_a_library_get_folds(spark):
    df = spark.range(300).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("library"), (F.col("id") % 4 == 0).cast("int").alias("active")
    )
    got = library_folds(df, "id", "library", "active", k=5).collect()
    assert len(got) == 300 and {r.fold_id for r in got} == set(range(5))
    actives = Counter(r.fold_id for r in got if r.active)
    assert max(actives.values()) - min(actives.values()) <= 1


def test_extras_go_to_the_folds_with_fewest_actives(spark):
    df = spark.range(400).selectExpr("id", "cast(sqrt(id) as int) as library", "1 as active")
    got = library_folds(df, "id", "library", "active", k=7).collect()
    sizes = defaultdict(Counter)
    for r in got:
        sizes[r.library][r.fold_id] += 1
    load = [0] * 7
    for library in sorted(sizes):
        n = sum(sizes[library].values())
        extra = sorted(range(7), key=lambda f: (load[f], f))[: n % 7]
        assert {f: sizes[library][f] for f in range(7)} == {f: n // 7 + (f in extra) for f in range(7)}
        load = [load[f] + sizes[library][f] for f in range(7)]


def test_identities_without_ids(spark):
    rows = [(1, "i5", "s1"), (2, None, "s1"), (3, "i2", "s2"), (4, "i5", "s2"), (5, None, "s9"), (6, None, "s9"), (7, None, None), (8, None, None), (9, "i7", None)]
    df = spark.createDataFrame(rows, "row int, id string, s string")
    got = {r.row: (r.molecule_id, r.duplicate_id) for r in group_identities(df, "id", "s", ["row"]).collect()}
    assert got == {
        1: ("i2", 0), 2: ("i2", 1), 3: ("i2", 2), 4: ("i2", 3), 5: (None, 0), 6: (None, 1), 7: (None, 0), 8: (None, 0), 9: ("i7", 0),
    }


def test_clusters_of_rows_without_a_fingerprint(spark):
    df = spark.createDataFrame([(1, [7]), (2, [7]), (3, None), (4, [1 << 40]), (5, None)], "id long, fp array<long>")
    got = {r.id: (r.leader_id, r.cluster_id) for r in leader_clusters(df, "fp", "id", 64, 0.3).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 1), 4: (4, 2), 5: (5, 3)}


def test_nan_is_no_score(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0.5, nan, "a"), (2, nan, 0.1, "a"), (3, 0.9, 0.2, "b"), (4, None, nan, "b")], "id int, x double, y double, k string")
    assert [r.id for r in top_k(df, "x", "id", 3).collect()] == [3, 1]
    assert [r.id for r in rank_by(df, "x", "id").orderBy("rank").collect()] == [3, 1, 2, 4]
    assert {r.k: r.id for r in best_per(df, "k", "x", "id").collect()} == {"a": 1, "b": 3}
    assert [r.v for r in df.orderBy("id").select(max_vote(["x", "y"]).alias("v")).collect()] == [0.5, 0.1, 0.9, None]


def test_labels_other_than_0_and_1_weigh_nothing(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (-1,), (None,)], "label int")
    assert [r.class_weight for r in class_weights(df, "label").collect()] == [1.0, 1.0, 2.0, None, None]
    a = spark.createDataFrame([(1,), (2,), (None,)], "key int")
    assert [r.key for r in exclude_shared(a, a.filter("key = 1"), "key").collect()] == [2]


def test_many_trees(spark):
    from pyspark.ml.linalg import Vectors

    data = [(i, Vectors.dense([float(i % 7), float(i % 3)]), float(i % 2)) for i in range(60)]
    rows = spark.createDataFrame(data, ["id", "features", "label"])
    model = rankers.RankerGBT({"n_estimators": 6, "max_depth": 2}).fit(rows).model

    class Repeated:
        trees, treeWeights, _java_obj = model.trees * 100, list(model.treeWeights) * 100, None

    wide = rankers.PrefixRanker(Repeated, 600).steps(rows.select("id", "features")).collect()
    few = {r.id: r.score for r in rankers.PrefixRanker(model, 6).score(rows).collect()}
    assert all(len(r["__steps"]) == 600 and sum(r["__steps"][:6]) == pytest.approx(few[r.id]) for r in wide)
