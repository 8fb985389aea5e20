import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamis.operators.order import exact_quantiles, hash_positions, part_of, positions, positions_by_size, running_totals
from tamis.operators.ranking import row_range


@pytest.fixture(scope="module")
def hot(spark):
    """3000 rows, a third of them in group 0, with ties and a NULL group."""
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else (None if i % 50 == 1 else rng.randrange(1, 40)), float(rng.randrange(60))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g int, v double").repartition(7)


def test_running_totals_of_a_hot_group(hot, many_ranges):
    out = running_totals(hot, [F.col("v").desc(), "id"], {"n": F.lit(1), "s": "v"}, ["g"], totals=True).toPandas()
    assert len(out) == 3000
    p = out.sort_values(["v", "id"], ascending=[False, True])
    grouped = p.groupby("g", dropna=False)
    assert (grouped.cumcount() + 1 == p["n"]).all()
    assert np.allclose(grouped["v"].cumsum(), p["s"])
    assert (grouped["v"].transform("size") == p["n_total"]).all()


def test_group_spreads_over_partitions(hot, many_ranges):
    """The hot group must not meet in one piece."""
    from tamis.operators import order

    seen = []
    original = order.materialize
    order.materialize = lambda df, name="t": seen.append(original(df, name)) or seen[-1]
    try:
        positions(hot, ["id"], ["g"]).count()
    finally:
        order.materialize = original
    slots = seen[0].filter("g = 0").select(F.shiftright("__row", 33)).distinct().count()
    assert slots > 1


def test_global_positions(hot, many_ranges):
    out = positions(hot, [F.col("v").desc(), "id"], size="n").toPandas().sort_values("position")
    assert out["position"].tolist() == list(range(1, 3001))
    expected = out.sort_values(["v", "id"], ascending=[False, True])
    assert expected["id"].tolist() == out["id"].tolist()
    assert set(out["n"]) == {3000}


def test_positions_by_size_are_positions(hot, monkeypatch):
    """Whether groups are numbered in tasks, in ranges, or some one way and some the other."""
    from tamis.operators import order

    by = [F.col("v").desc(), "id"]
    expected = sorted(map(tuple, positions(hot, by, ["g"]).collect()))
    ranged = []
    real = order.positions
    monkeypatch.setattr(order, "positions", lambda *a: ranged.append(1) or real(*a))
    for small, calls in ((1 << 16, 0), (100, 1), (0, 2)):
        monkeypatch.setattr(order, "SMALL", small)
        got = positions_by_size(hot, by, ["g"])
        assert dict(got.dtypes)["position"] == "bigint"
        assert sorted(map(tuple, got.collect())) == expected
        assert len(ranged) == calls


def test_hash_positions_follow_the_hash(hot):
    out = hash_positions(hot, "id", ["g"], seed=3).toPandas()
    out["h"] = [hashlib.md5(f"{i}:3".encode()).hexdigest() for i in out["id"]]
    ranks = out.sort_values("h").groupby("g", dropna=False).cumcount() + 1
    assert (ranks.reindex(out.index) == out["position"]).all()
    assert (out.groupby("g", dropna=False)["id"].transform("size") == out["group_size"]).all()


@pytest.mark.parametrize("n,k", [(23, 10), (3, 10), (20, 10), (1, 1), (51, 50)])
def test_part_of_cuts_like_an_array_split(spark, n, k):
    df = spark.range(1, n + 1).select(part_of(F.col("id"), F.lit(n), k).alias("p"))
    sizes = pd.Series([r.p for r in df.collect()]).value_counts()
    assert [sizes.get(i, 0) for i in range(k)] == [len(a) for a in np.array_split(np.arange(n), k)]


def test_exact_quantiles(hot, many_ranges):
    marks = {"a": 0.25, "b": 0.4, "c": 0.5, "d": 0.9}
    out = exact_quantiles(hot, "v", marks, ["g"]).toPandas().set_index("g", drop=False)
    p = hot.toPandas()
    for g, rows in p.groupby("g", dropna=False):
        mine = out[out["g"].isna()] if pd.isna(g) else out[out["g"] == g]
        for name, q in marks.items():
            assert mine[name].iloc[0] == pytest.approx(rows["v"].quantile(q))


def test_row_ranges_tile_the_table(hot):
    ids = [r.id for p in range(4) for r in row_range(hot, p, 1000, ["id"]).collect()]
    assert sorted(ids) == list(range(3000))


def test_small_groups_are_sorted_and_large_ones_searched(spark, monkeypatch):
    """Both ways give the same places, for null keys, NaN, equal and missing values."""
    from tamis.operators import selection

    values = [("a", 1.0), ("a", 4.0), ("a", 2.0), ("a", 2.0), (None, 3.0), (None, float("nan")), (None, -1.0), ("b", None), ("c", 0.5)]
    df = spark.createDataFrame(values, "g string, v double")
    places = {"low": lambda n: F.floor((n - 1) / 2), "third": lambda n: F.lit(2)}
    expected = [(None, 2, -1.0, None), ("a", 4, 2.0, 2.0), ("c", 1, 0.5, None)]
    searched = []
    real = selection._searched_values
    monkeypatch.setattr(selection, "_searched_values", lambda *a: searched.append(1) or real(*a))
    for small, calls in ((1 << 16, 0), (2, 1), (0, 2)):
        monkeypatch.setattr(selection, "SMALL", small)
        got = selection.group_values_at(df, "v", places, ["g"]).select("g", "size", "low", "third").collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
        assert len(searched) == calls
