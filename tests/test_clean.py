import math

import pytest
from pyspark.sql import functions as F

from tamis.functions import rows, text
from tamis.operators import aggregates, checks, clean


def test_bounds(spark):
    df = spark.createDataFrame(
        [(-100.0, "a"), (-99.9, "a"), (float("nan"), "a"), (None, "a"), (5.0, None)], "v double, s string"
    )
    assert [r.v for r in clean.clean_readings(df, "v", "s").collect()] == [-99.9]


def test_missing_retest_is_inactive(spark):
    df = spark.createDataFrame(
        [("a", 40.0, 0), ("a", 50.0, 0), ("b", 40.0, 0), ("b", 36.0, 1), ("c", 90.0, 0), ("c", 10.0, 1), ("c", 80.0, 1)],
        "m string, v double, r int",
    ).withColumn("alert", (F.col("m") == "z").cast("int"))
    out = {r.m: r for r in clean.activity_labels(df, "m", "v", "r", "alert").collect()}
    assert (out["a"].primary_filter, out["a"].retest_filter, out["a"].activity) == (1, 0, 0)
    assert out["b"].activity == 1
    assert out["c"].retest_median == 45.0 and out["c"].activity == 1
    assert clean.label_activity(df, "m", "v", "r", "alert").count() == 7


def test_tiers(spark):
    df = spark.createDataFrame(
        [(80.0, 72.0, 1), (80.0, 72.0, 0), (50.0, 60.0, 1), (35.0, 90.0, 1), (34.0, 90.0, 1)], "a double, b double, ok int"
    )
    assert [r[0] for r in df.select(rows.activity_tier("a", "b", "ok")).collect()] == ["strong", "none", "normal", "weak", "none"]
    assert [r[0] for r in df.select(rows.hit_flag("a", "b", "ok")).collect()] == [1, 0, 1, 0, 0]


def test_row_arithmetic_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a double, b double")
    got = df.select(rows.row_sum(["a", "b"]), rows.row_mean(["a", "b"]), rows.row_min(["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0), (0.0, None, None), (4.0, 2.0, 1.0)]


def test_unknown_code_fails(spark):
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    with pytest.raises(Exception, match="unknown code"):
        df.select(text.standardize("c", {"x": "X"})).collect()
    assert [r[0] for r in df.select(text.standardize("c", {"x": "X"}, keep_unknown=True)).collect()] == ["X", "y"]


def test_funnel_counts_each_row_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (9, 1), (None, 9), (9, 9)], "a int, b int")
    out = clean.funnel(df, [("a", F.col("a") > 5), ("b", F.col("b") > 5)]).collect()
    assert [(r["filter"], r.n_failed, r.n_left) for r in out] == [("a", 3, 2), ("b", 1, 1)]
    assert clean.passing(df, [("a", F.col("a") > 5), ("b", F.col("b") > 5)]).count() == 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.01, 0.29, 0.999, 1.0)], "s double")
    out = {r.bin: r.n for r in aggregates.score_histogram(df, "s").collect()}
    assert len(out) == 100 and sum(out.values()) == 4
    assert {b for b, n in out.items() if n} == {0, 1, 29, 99}


def test_all_edges_fall_in_their_own_bin(spark):
    df = spark.createDataFrame([(b / 100,) for b in range(100)], "s double")
    assert all(r.n == 1 for r in aggregates.score_histogram(df, "s").collect())


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert {(r.y, r.class_weight) for r in clean.class_weights(df, "y").collect()} == {(0, 1.0), (1, 3.0)}
    assert {r.class_weight for r in clean.class_weights(df, "y", "no_weight").collect()} == {0.5}
    values = spark.createDataFrame([(-0.5,), (0.5,), (1.2,), (7.0,)], "v double")
    got = {r.v: r.sample_weight for r in clean.sample_weights(values, "v").collect()}
    assert got == {-0.5: 2.0, 0.5: 2.0, 1.2: 4.0, 7.0: 4.0}


def test_collapse_is_ordered(spark):
    df = spark.createDataFrame(
        [(1, 1, 10.0, "L2", "late"), (1, 0, 20.0, "L1", "first"), (1, 2, 60.0, "L2", "last")],
        "m long, d int, v double, lib string, c string",
    )
    row = clean.collapse_primary(df, "m", "d", "v", {"libs": "lib"}, ["c"]).first()
    assert (row.libs, row.c, row.primary_median) == ("L1, L2", "first", 20.0)


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, None)], "k int, v string")
    assert checks.expect(df, rows=3, columns=2, distinct={"k": 1})["rows"] == 3
    with pytest.raises(AssertionError):
        checks.expect(df, rows=4)
    assert [r.n_rows for r in checks.violations_of_unique(df, ["k", "v"]).collect()] == [2]
    with pytest.raises(AssertionError):
        checks.assert_unique(df, ["k", "v"])
    with pytest.raises(AssertionError):
        checks.expect_no_fanout(df.select("k"), df.select("k"), ["k"])
    assert checks.differences(df.limit(1), df.limit(1), ["k"], ["v"]).isEmpty()
    with pytest.raises(AssertionError):
        checks.assert_same(spark.createDataFrame([(1, 2.0)], "k int, v double"), spark.createDataFrame([(1, 3.0)], "k int, v double"), ["k"], ["v"])


def test_split_valid_by_batches(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")

    def convert(batches):
        for b in batches:
            ok = b["s"].str.isdigit()
            yield b.assign(error=ok.map({True: None, False: "not a number"}))

    valid, bad = checks.split_valid_by(df, convert, "s string, error string")
    assert [r.s for r in valid.collect()] == ["1"] and [r.error for r in bad.collect()] == ["not a number"]


def test_describe_and_mean_std(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "p string, v double")
    table = {r.p: r.v for r in aggregates.with_mean_std(df, "p", ["v"]).collect()}
    assert table == {"a": 1.0, "b": 3.0, "mean": 2.0, "std": round(math.sqrt(2), 2)}
    row = aggregates.describe(df, ["v"]).first()
    assert (row["count"], row["mean"], row["q25"], row["q50"]) == (2, 2.0, 1.5, 2.0)
