import random

from pyspark.sql import functions as F

from tamis.operators import joins
from tamis.operators.graph import components
from tamis.operators.identity import group_identities


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def check(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(df, "u", "v").collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want


def test_long_path(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    check(spark, list(zip(order, order[1:])))


def test_random_graph_with_a_hub(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(7, 1000 + i) for i in range(300)]
    check(spark, edges)


def test_chain_of_ids_and_structures(spark):
    rows = [(0, "a", "s1"), (1, "b", "s1"), (2, "b", "s2"), (3, "c", "s2"), (4, "d", "s3"), (5, "e", None)]
    df = spark.createDataFrame(rows, "n int, id string, s string")
    out = {r.n: (r.molecule_id, r.duplicate_id) for r in group_identities(df, "id", "s", ["n"]).collect()}
    assert out == {0: ("a", 0), 1: ("a", 1), 2: ("a", 2), 3: ("a", 3), 4: ("d", 0), 5: ("e", 0)}


def test_known_rows_and_rows_without_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    known = spark.createDataFrame([("a",), (None,)], "k string")
    kept, unkeyed = joins.exclude_known(df, known, key="k")
    assert [r.i for r in kept.collect()] == [2] and [r.i for r in unkeyed.collect()] == [3]
    report = joins.exclusion_report(df, known, key="k").first()
    assert (report.n_rows, report.n_kept, report.n_removed, report.n_without_key) == (3, 1, 1, 1)


def test_cluster_flags(spark):
    clusters = spark.createDataFrame(
        [(1, "train", 0), (1, "train", 1), (2, "ordered", 0), (3, "train", 0)], "c int, d string, h int"
    )
    cand = spark.createDataFrame([(10, 1), (11, 2), (12, 9)], "i int, c int")
    out = {r.i: r for r in joins.cluster_flags(cand, clusters, "c", "d", "h", ["train", "ordered"]).collect()}
    assert (out[10].in_train, out[10].active_in_train, out[10].in_ordered) == (1, 1, 0)
    assert (out[11].in_train, out[11].in_ordered, out[11].active_in_ordered) == (0, 1, 0)
    assert (out[12].in_train, out[12].in_ordered) == (0, 0)


def test_zip_rows_reports_misaligned(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, ka string")
    b = spark.createDataFrame([(1, "x"), (2, "q")], "j int, kb string")
    out = joins.zip_rows(a, b, ["i"], ["j"], ("ka", "kb")).orderBy("position").collect()
    assert [r.aligned for r in out] == [1, 0, 0]


def test_enrich_takes_one_row_per_key(spark):
    info = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert [tuple(r) for r in joins.enrich(df, info, "k", ["v"]).collect()] == [(1, "a")]


def test_mapping_and_suffix(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (3, "z"), (3, "z")], "k int, v string")
    assert sorted(r.k for r in joins.compare_maps(a, b, "k", "v").collect()) == [2, 3]
    assert joins.join_suffix(a, b, "k", "k").columns == ["k", "v", "v_y"]
    assert joins.append_unmatched(a, b.select("k", F.lit("n").alias("n")), "k", a.filter("k > 1")).count() == 4


def test_large_molecules_are_numbered_in_ranges(spark, many_ranges, monkeypatch):
    from tamis.operators import order

    monkeypatch.setattr(order, "SMALL", 5)
    rows = [(i, "a" if i < 12 else f"b{i // 4}", f"s{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "n int, id string, s string").repartition(4)
    got = {r.n: (r.molecule_id, r.duplicate_id) for r in group_identities(df, "id", "s", [F.col("n").desc()]).collect()}
    want = {}
    for n, i, _ in rows:
        want[n] = (i, sum(j == i and m > n for m, j, _ in rows))
    assert got == want


def test_nothing_shared(spark):
    df = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, s string")
    out = {(r.molecule_id, r.duplicate_id) for r in group_identities(df, "id", "s", ["s"]).collect()}
    assert out == {("a", 0), ("b", 0)}
