"""Summaries of campaigns: folds, selections, clusters, scores, prices, models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.rows import number
from tamis.operators.order import exact_quantiles

TIERS = ("strong", "normal", "weak")


def count_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per combination; NULL is a group."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def fold_counts(df: DataFrame, fold: str, active: str) -> DataFrame:
    """Total, active and inactive per fold, and a row over all folds (fold NULL)."""
    return df.rollup(fold).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(active) == 1).alias("active"),
        F.count_if(F.col(active) == 0).alias("inactive"),
    )


def hit_rate(df: DataFrame, hit: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum(hit).alias("hits"),
        F.count("*").alias("n"),
        F.round(100.0 * F.sum(hit) / F.count("*"), 2).alias("hit_rate"),
    )


def summarize_sets(df: DataFrame, sets: Mapping[str, Column], hit: str, tier: str) -> DataFrame:
    """Count, hits, tiers, misses and hit rate of overlapping selections.

    One pass with a filtered aggregate per selection; no row is duplicated.
    """
    aggs, rows = [], []
    for i, (name, member) in enumerate(sets.items()):
        inside = F.coalesce(member, F.lit(False))
        aggs += [
            F.count_if(inside).alias(f"n{i}"),
            F.sum(F.when(inside, F.col(hit)).otherwise(0)).alias(f"h{i}"),
            *[F.count_if(inside & (F.col(tier) == t)).alias(f"{t}{i}") for t in TIERS],
        ]
        n, h = F.col(f"n{i}"), F.col(f"h{i}")
        rows.append(
            F.struct(
                F.lit(name).alias("selection"),
                n.alias("n"),
                h.alias("hits"),
                *[F.col(f"{t}{i}").alias(t) for t in TIERS],
                (n - h).alias("misses"),
                F.round(100.0 * h / F.nullif(n, F.lit(0)), 6).alias("hit_rate"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def cluster_tiers(df: DataFrame, cluster: str, tier: str) -> DataFrame:
    """Tier counts of the clusters with at least one active."""
    counts = df.groupBy(cluster).agg(*[F.count_if(F.col(tier) == t).alias(t) for t in TIERS])
    return counts.withColumn("total", sum(F.col(t) for t in TIERS)).filter("total > 0")


def tiers_by_cluster(df: DataFrame, cluster: str, tier: str) -> DataFrame:
    """Same, plus a row of totals named ``Total``."""
    table = cluster_tiers(df, cluster, tier).withColumn(cluster, F.col(cluster).cast("string"))
    totals = table.agg(*[F.sum(c).alias(c) for c in (*TIERS, "total")])
    return table.unionByName(totals.withColumn(cluster, F.lit("Total")))


def cluster_fractions(df: DataFrame, cluster: str, tier: str) -> DataFrame:
    """Share of active clusters with a strong, normal, weak, strong-or-normal member."""
    share = lambda c: F.round(F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), 6)
    return cluster_tiers(df, cluster, tier).agg(
        F.count("*").alias("active_clusters"),
        *[share(F.col(t) > 0).alias(f"with_{t}") for t in TIERS],
        share((F.col("strong") > 0) | (F.col("normal") > 0)).alias("with_strong_or_normal"),
    )


def active_clusters(df: DataFrame, cluster: str, hit: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.sum(hit).alias("hits")).filter("hits > 0")


def describe(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per column; NaN is no reading.

    The columns are stacked, so the quartiles of all of them take one sort.
    """
    cells = [F.struct(F.lit(c).alias("column"), number(F.col(c).cast("double")).alias("value")) for c in cols]
    long = df.select(F.inline(F.array(*cells)))
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.round(F.avg("value"), digits).alias("mean"),
        F.round(F.stddev_samp("value"), digits).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    marks = exact_quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"])
    table = moments.join(marks, "column", "left")
    return table.withColumns({q: F.round(q, digits) for q in ("q25", "q50", "q75")})


def score_histogram(df: DataFrame, score: str, bins: int = 100) -> DataFrame:
    """Equal half-open bins over [0, 1); empty ones count 0, a score of 1 is in none.

    ``floor(score * bins)`` only proposes a bin: 0.29 * 100 floors to 28 while
    0.29 lies in [29/100, 30/100). The edges decide.
    """
    s, guess = F.col(score), F.floor(F.col(score) * bins)
    edge = lambda b: b / F.lit(float(bins))
    bin_ = (
        F.when(s < edge(guess), guess - 1).when(s >= edge(guess + 1), guess + 1).otherwise(guess)
    )
    counts = (
        df.filter((s >= 0) & (s < 1)).select(bin_.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    )
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"), edge(F.col("id")).alias("low"), edge(F.col("id") + 1).alias("high")
    )
    return edges.join(counts, "bin", "left").fillna(0, subset=["n"])


def price_summary(df: DataFrame, price: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sum, min, max of the price, sum of the amount and the amounts that occur.

    Amounts are counted per value first, so repeats never reach the final task.
    """
    per_amount = df.groupBy(*by, amount).agg(
        F.count("*").alias("__n"),
        F.count(price).alias("__np"),
        F.sum(price).alias("__s"),
        F.min(price).alias("__lo"),
        F.max(price).alias("__hi"),
    )
    return per_amount.groupBy(*by).agg(
        F.sum("__n").alias("n"),
        F.round(F.sum("__s") / F.sum("__np"), 6).alias("price_mean"),
        F.round(F.sum("__s"), 2).alias("price_sum"),
        F.min("__lo").alias("price_min"),
        F.max("__hi").alias("price_max"),
        F.sum(F.col(amount) * F.col("__n")).alias("amount_sum"),
        F.count(amount).alias("distinct_amounts"),
    )


def mean_cv(
    metrics: DataFrame, by: Sequence[str], cols: Sequence[str], run: str, runs: Sequence[int] = (0, 1, 2, 3), missing: float = -1
) -> DataFrame:
    """Mean metric over the cross-validation runs; a missing log does not count."""
    used = metrics.filter(F.col(run).isin(list(runs)))
    return used.groupBy(*by).agg(
        *[F.avg(F.nullif(F.col(c), F.lit(float(missing)))).alias(f"mean_{c}") for c in cols]
    )


def selection_table(
    metrics: DataFrame, finalists: DataFrame, on: Sequence[str], cols: Sequence[str], run: str, last_run: int = 4
) -> DataFrame:
    """One line per finalist on the last run with three digits; -1 when its log is missing."""
    last = metrics.filter(F.col(run) == last_run).select(*on, *cols)
    lines = finalists.join(last, list(on), "left").fillna(-1.0, subset=list(cols))
    return lines.withColumns({c: F.round(c, 3) for c in cols})


def distinct_codes(df: DataFrame, col: str, file: str) -> DataFrame:
    """Codes that occur in each file, sorted and joined."""
    return (
        df.select(file, col)
        .distinct()
        .groupBy(file)
        .agg(F.array_join(F.array_sort(F.collect_list(col)), ",").alias("codes"), F.count(col).alias("n_codes"))
    )


def with_mean_std(df: DataFrame, label: str, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """The table with a ``mean`` and a sample ``std`` row appended, rounded; NaN enters neither."""
    rows = [
        df.agg(*[f(number(c)).alias(c) for c in cols]).withColumn(label, F.lit(name))
        for name, f in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    base = df.select(F.col(label).cast("string").alias(label), *[F.col(c).cast("double").alias(c) for c in cols])
    table = base.unionByName(rows[0]).unionByName(rows[1])
    return table.withColumns({c: F.round(c, digits) for c in cols})


def over_threshold(df: DataFrame, part: str | Column, score: str, threshold: float = 0.1) -> DataFrame:
    """Rows and rows above the threshold per part; NaN is no score."""
    return df.groupBy(part).agg(
        F.count("*").alias("n_rows"), F.count_if(number(score) > threshold).alias("n_over")
    )


def fold_cluster_overlap(df: DataFrame, fold: str, cluster: str) -> DataFrame:
    """Per fold: rows, clusters, clusters in no other fold; and a row over all folds.

    Counted per (cluster, fold) first; what follows handles one row per pair.
    """
    pairs = df.groupBy(cluster, fold).agg(F.count("*").alias("n"))
    spread = pairs.groupBy(cluster).agg(
        F.collect_list(F.struct(F.col(fold).cast("string").alias("fold"), "n")).alias("folds")
    )
    per_fold = spread.select(F.inline("folds"), (F.size("folds") == 1).cast("int").alias("alone"))
    table = per_fold.groupBy("fold").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_clusters"), F.sum("alone").alias("n_unique_clusters")
    )
    overall = spread.agg(
        F.sum(F.aggregate("folds", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("n_rows"),
        F.count("*").alias("n_clusters"),
        F.lit(0).cast("long").alias("n_unique_clusters"),
    )
    return table.unionByName(overall.withColumn("fold", F.lit("all")))


def clusters_of_one_fold(df: DataFrame, fold: str, cluster: str) -> DataFrame:
    """Union over the folds of the clusters found in no other fold."""
    return df.groupBy(cluster).agg(F.min(fold).alias("fold"), F.max(fold).alias("__hi")).filter(
        "fold = __hi"
    ).drop("__hi")
