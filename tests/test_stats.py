import random

import numpy as np
import pytest

from tamis.operators import stats


def test_chi2_tail():
    for x, dof, p in [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (0.0, 3, 1.0), (2.705543, 1, 0.1)]:
        assert stats.chi2_sf(x, dof) == pytest.approx(p, rel=1e-5)


def table(spark, cells):
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_chi2_counts_empty_cells(spark):
    cells = {("x", "p"): 10, ("x", "q"): 4, ("y", "q"): 6, ("z", "p"): 3, ("z", "q"): 7, ("y", "r"): 5}
    o = np.array([[10, 4, 0], [0, 6, 5], [3, 7, 0]])
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    row = stats.chi2_table(table(spark, cells), "a", "b").first()
    assert row.statistic == pytest.approx(((o - e) ** 2 / e).sum()) and row.dof == 4
    assert row.p_value == pytest.approx(stats.chi2_sf(row.statistic, 4))


def test_chi2_correction_for_one_degree(spark):
    cells = {("x", "p"): 12, ("x", "q"): 5, ("y", "p"): 3, ("y", "q"): 9}
    o = np.array([[12, 5], [3, 9]])
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    row = stats.chi2_table(table(spark, cells), "a", "b").first()
    assert row.statistic == pytest.approx(((np.abs(o - e) - 0.5) ** 2 / e).sum())
    plain = stats.chi2_table(table(spark, cells), "a", "b", correction=False).first()
    assert plain.statistic == pytest.approx(((o - e) ** 2 / e).sum())


def test_chi2_uniform(spark):
    df = spark.createDataFrame([(4, 1), (6, 1), (8, 1)], "u int, v int")
    out = {r["column"]: r for r in stats.chi2_uniform(df, ["u", "v"]).collect()}
    assert out["u"].statistic == pytest.approx(8 / 6) and out["v"].statistic == 0.0 and out["u"].dof == 2


def test_simulated_test(spark):
    linked = table(spark, {("x", "p"): 30, ("x", "q"): 3, ("y", "p"): 4, ("y", "q"): 28})
    assert stats.perm_test(linked, "a", "b", 300).first().p_value == pytest.approx(1 / 301)
    rng = random.Random(1)
    free = spark.createDataFrame([(rng.choice("xyz"), rng.choice("pq")) for _ in range(300)], "a string, b string")
    one, two = (stats.perm_test(free, "a", "b", 400, seed=4).first() for _ in range(2))
    assert one == two and one.p_value > 0.02


def test_simulated_test_matches_the_exact_one(spark):
    """Tea tasting: the exact two-sided p-value is 34/70."""
    tea = table(spark, {("m", "M"): 3, ("m", "T"): 1, ("t", "M"): 1, ("t", "T"): 3})
    assert stats.perm_test(tea, "a", "b", 4000).first().p_value == pytest.approx(34 / 70, abs=0.04)


def test_simulated_test_in_many_blocks(spark, monkeypatch):
    """Three categories a block on both sides: the same distribution, and the same table again."""
    rng = random.Random(2)
    rows = [(rng.randrange(11), rng.randrange(9)) for _ in range(150)]
    rows += [(0, rng.randrange(9)) for _ in range(80)]  # a hot category
    df = spark.createDataFrame(rows, "a int, b int")
    whole = stats.perm_test(df, "a", "b", 500).first()
    monkeypatch.setattr(stats, "CATEGORY_BLOCK", 3)
    parts, again = (stats.perm_test(df, "a", "b", 500).first() for _ in range(2))
    assert parts == again and parts.statistic == pytest.approx(whole.statistic)
    assert parts.p_value == pytest.approx(whole.p_value, abs=0.12) and 0.02 < whole.p_value < 0.98
    tea = table(spark, {("m", "M"): 3, ("m", "T"): 1, ("t", "M"): 1, ("t", "T"): 3})
    monkeypatch.setattr(stats, "CATEGORY_BLOCK", 1)
    assert stats.perm_test(tea, "a", "b", 2000).first().p_value == pytest.approx(34 / 70, abs=0.06)


def test_simulated_test_needs_two_categories(spark):
    for rows in ([], [("x", "p"), ("x", "q")], [("x", "p"), ("y", None)]):
        with pytest.raises(ValueError):
            stats.perm_test(spark.createDataFrame(rows, "a string, b string"), "a", "b", 10)


def test_random_cells_keep_the_totals():
    rng = np.random.default_rng(0)
    for rows, cols in [([5, 0, 1, 900], [400, 6, 500]), ([1] * 50, [10, 0, 40]), ([7], [3, 4]), ([0], [0])]:
        i, j, n = stats.random_cells(rng, np.array(rows), np.array(cols))
        dense = np.zeros((len(rows), len(cols)), dtype=int)
        np.add.at(dense, (i, j), n)
        assert dense.sum(1).tolist() == rows and dense.sum(0).tolist() == cols and (n > 0).all()


def test_draws_beyond_the_generators_range(monkeypatch):
    """Sums of ratios give the distribution the generator gives, and take any population."""
    rng = np.random.default_rng(1)
    plain = rng.hypergeometric(40, 60, 30, size=4000)
    monkeypatch.setattr(stats, "DRAWN_DIRECTLY", 0)
    own = np.array([stats.draw_marked(rng, 40, 60, 30) for _ in range(4000)])
    assert abs(own.mean() - plain.mean()) < 0.15 and abs(own.std() - plain.std()) < 0.15
    assert [stats.draw_marked(rng, 5, 0, 3), stats.draw_marked(rng, 0, 5, 3), stats.draw_marked(rng, 5, 3, 8)] == [3, 0, 5]
    big = stats.draw_colours(rng, np.array([10**12, 3 * 10**12, 0]), 10**10)
    assert big.sum() == 10**10 and big[2] == 0 and abs(big[0] - 2.5e9) < 1e6


def test_hill_fit_recovers_the_curve(spark):
    doses = [90, 45, 30, 12, 6, 3, 1.2, 0.6]
    rows = [
        (c, float(d), float(stats.hill(np.array(d), np.array(m), np.array(h), 0.0, 180.0)))
        for c, m, h in (("a", 8.0, 1.5), ("b", 3.0, 0.75))
        for d in doses
        for _ in range(4)
    ]
    df = spark.createDataFrame(rows, "c string, d double, y double")
    mids, slopes = [2.0**i for i in range(-1, 7)], [0.5 * i for i in range(1, 7)]
    grid = {r.c: r for r in stats.fit_hill(df, "c", "d", "y", mids, slopes).collect()}
    assert (grid["a"].midpoint, grid["a"].slope, grid["a"].sse, grid["a"].n) == (8.0, 1.5, 0.0, 32)
    fine = {r.c: r for r in stats.fit_hill(df, "c", "d", "y", mids, slopes, refine=5).collect()}
    assert fine["b"].midpoint == pytest.approx(3.0, rel=0.02) and fine["b"].slope == pytest.approx(0.75, abs=0.02)
    assert fine["b"].sse < grid["b"].sse


def test_hill_fit_runs_without_python(spark):
    """Missing and undefined readings are left out, rows without a compound are one."""
    rows = [("a", 1.0, 90.0), ("a", 4.0, 36.0), ("a", 2.0, float("nan")), ("a", None, 5.0), ("a", 2.0, None), (None, 1.0, 90.0), (None, 4.0, 36.0)]
    df = spark.createDataFrame(rows, "c string, d double, y double")
    fitted = stats.fit_hill(df, "c", "d", "y", [0.5, 1.0, 2.0], [1.0, 2.0])
    assert {(r.c, r.midpoint, r.slope, r.sse, r.n) for r in fitted.collect()} == {("a", 1.0, 1.0, 0.0, 2), (None, 1.0, 1.0, 0.0, 2)}
    assert {r.c for r in stats.fit_hill(df, "c", "d", "y", [0.5, 1.0, 2.0], [1.0, 2.0], refine=1).collect()} == {"a", None}
    flat = spark.createDataFrame([("f", 1.0, 90.0), ("f", 9.0, 90.0)], "c string, d double, y double")  # the least slope is reached
    assert [r.n for r in stats.fit_hill(flat, "c", "d", "y", [1.0, 3.0], [0.01, 0.5], refine=2).collect()] == [2]
    plan = fitted._jdf.queryExecution().toString()
    assert "Python" not in plan and "collect_list" not in plan
    assert stats.fit_hill(df.limit(0), "c", "d", "y", [1.0], [1.0]).collect() == []
