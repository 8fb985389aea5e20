import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import ranking, selection
from tamis.operators.order import exact_quantiles
from tamis.operators.ranking import sample_n, top_fraction, top_k
from tamis.operators.selection import bucket, group_values_at, values_at

HARD = [0.0, -0.0, 5e-324, -5e-324, 1e-300, 1e300, 1.7e308, -1.7e308, math.inf, -math.inf, 1.0, 1.0, 1 + 2**-52, 1 + 2**-51]


def numbers(n, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.choice(HARD), lambda: rng.gauss(0, 1), lambda: 10 ** rng.uniform(-300, 300), lambda: 7.0 + rng.random() * 1e-12]
    return [rng.choice(kinds)() for _ in range(n)]


def test_buckets_rise_with_the_value(spark):
    values = sorted(set(numbers(4000, 1)))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    steps = [r.b for r in df.select("v", bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert steps == sorted(steps)


@pytest.mark.parametrize("seed", [2, 3])
def test_values_at_every_kind_of_place(spark, seed):
    values = numbers(2000, seed)
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double").repartition(5)
    spots = [0, 1, 2, 500, 999, 1000, 1001, 1500, 1998, 1999]
    found, size = values_at(df, "v", {str(s): lambda n, s=s: F.lit(s) for s in spots})
    assert size == 2000
    assert [found[str(s)] for s in spots] == [sorted(values)[s] for s in spots]


def test_places_that_do_not_exist(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert values_at(df, "v", {"a": lambda n: n, "b": lambda n: n - 1}) == ({"a": None, "b": 2.0}, 2)
    assert values_at(df.limit(0), "v", {"a": lambda n: F.lit(0)}) == ({"a": None}, 0)
    row = exact_quantiles(df.limit(0), "v", {"q": 0.5}).collect()
    assert len(row) == 1 and row[0].q is None
    assert exact_quantiles(df.limit(0).withColumn("g", F.lit(1)), "v", {"q": 0.5}, ["g"]).count() == 0


def test_groups_with_a_hot_one_and_null_keys(spark, many_ranges):
    rng = random.Random(4)
    rows = [
        (0 if i % 3 == 0 else rng.choice([None, *range(1, 60)]), rng.choice("ab"), v)
        for i, v in enumerate(numbers(6000, 5))
    ]
    rows += [(999, "a", None), (998, "a", math.nan), (997, "b", 3.5)]
    df = spark.createDataFrame(rows, "g int, h string, v double").repartition(7)
    spots = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "third": lambda n: F.floor(n / 3), "none": lambda n: n}
    got = {(r.g, r.h): r for r in group_values_at(df, "v", spots, ["g", "h"]).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault((g, h), []).append(v)
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        values.sort()
        n, r = len(values), got[key]
        assert (r["size"], r.low, r.mid, r.third, r.none) == (n, values[0], values[n // 2], values[n // 3], None)


def test_close_values_take_rounds_not_rows(spark):
    """Values that share every first bucket are told apart by later rounds."""
    values = [1.0 + i * 2**-52 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.select(bucket(F.col("v"))).distinct().count() == 1
    assert values_at(df, "v", {"m": lambda n: F.lit(1234)})[0]["m"] == values[1234]


def test_quantiles_match_numpy_and_carry_infinity(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(0, 3) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    marks = {f"q{i}": i / 20 for i in range(21)}
    row = exact_quantiles(df, "v", marks).first()
    assert [row[m] for m in marks] == pytest.approx(np.quantile(values, list(marks.values())))
    ends = spark.createDataFrame([(-math.inf,), (math.inf,), (math.inf,)], "v double")
    assert exact_quantiles(ends, "v", {"a": 0.0, "b": 1.0}).first() == (-math.inf, math.inf)


def test_no_table_is_written_or_sorted_without_groups(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("nothing should be written")

    monkeypatch.setattr(selection, "materialize", refuse)
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    assert values_at(df, "v", {"m": lambda n: F.floor(n / 2)})[1] == 10_000


def test_slack_lets_through_a_bounded_number_of_rows(spark):
    values = numbers(3000, 9)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    for slack in (0, 1, 20, 5000):
        for place in (0, 10, 1700, 2999):
            got = values_at(df, "v", {"x": lambda n: F.lit(place)}, slack)[0]["x"]
            assert ordered[max(place - slack, 0)] <= got <= ordered[place]


@pytest.mark.parametrize("slack", [0, 1 << 16])
@pytest.mark.parametrize("k", [0, 1, 7, 40, 300, 10**6])
def test_top_k_with_ties_and_missing_scores(spark, monkeypatch, k, slack):
    monkeypatch.setattr(ranking, "SLACK", slack)
    rng = random.Random(8)
    rows = [(i, rng.choice([None, math.nan, 1.0, 2.0, 2.0, -3.0, math.inf, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(4)
    scored = sorted((-s, i) for i, s in rows if s is not None and not math.isnan(s))
    assert [(r.s, r.id) for r in top_k(df, "s", "id", k).collect()] == [(-s, i) for s, i in scored[:k]]


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_top_fraction_counts_rows_without_a_score(spark, ratio):
    rows = [(i, float(i % 9)) for i in range(80)] + [(i, None) for i in range(80, 120)]
    df = spark.createDataFrame(rows, "id long, s double")
    best = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[: math.floor(120 * ratio)]
    got = top_fraction(df, "s", "id", ratio).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [(r[0], i + 1) for i, r in enumerate(best)]


def test_sample_is_repeatable_and_whole(spark):
    df = spark.range(500).withColumnRenamed("id", "doc")
    a, b = ({r.doc for r in sample_n(x, "doc", 50, 3).collect()} for x in (df, df.repartition(9)))
    assert a == b and len(a) == 50
    assert sample_n(df, "doc", 600).count() == 500
