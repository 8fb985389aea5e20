"""Ranks, best-of-group, top-k and comparisons of ranked lists.

Ties are always broken by the id, ascending.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.rows import number
from tamis.operators.order import positions
from tamis.operators.selection import values_at
from tamis.session import materialize

SLACK = 1 << 16  # rows that a cut may let through beside the k best; they are ranked, too


def best_first(score: str, id_col: str) -> list[Column]:
    """Best score first; rows without a score, NaN included, come last."""
    return [number(score).desc_nulls_last(), F.col(id_col).asc()]


def rank_by(df: DataFrame, score: str, id_col: str, name: str = "rank", size: str | None = None) -> DataFrame:
    """Rank 1..n, best score first."""
    return positions(df, best_first(score, id_col), name=name, size=size)


def best_per(df: DataFrame, key: str, score: str, id_col: str) -> DataFrame:
    """Best row of each group, as a partial aggregate: no group is gathered."""
    rest = [c for c in df.columns if c != key]
    order = F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("i"))
    return (
        df.filter(number(score).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), order).alias("__best"))
        .select(key, "__best.*")
    )


def distinct_on(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in the order of a unique column."""
    rest = [c for c in df.columns if c != key]
    firsts = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return firsts.select(key, "__first.*")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number the rows inside each group from ``start``."""
    return positions(df, order, keys, name).withColumn(name, F.col(name) + (start - 1))


def index_rows(df: DataFrame, order: Sequence[str | Column], name: str = "index_id") -> DataFrame:
    """Gapless index 0..n-1."""
    return positions(df, order, name=name).withColumn(name, F.col(name) - 1)


def row_range(df: DataFrame, p: int, n: int, order: Sequence[str | Column]) -> DataFrame:
    """Slice p of n rows: positions p*n+1 .. (p+1)*n. Whole scans use file splits instead."""
    placed = positions(df, order, name="__position")
    return placed.filter(F.col("__position").between(p * n + 1, (p + 1) * n)).drop("__position")


def expand(df: DataFrame, count: str, name: str = "repeat") -> DataFrame:
    """Repeat a row as often as its count says; none for 0."""
    n = F.col(count).cast("int")
    return df.filter(n > 0).withColumn(name, F.explode(F.sequence(F.lit(1), n)))


def _best(rows: DataFrame, value: Column, order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows in ``order``, ranked; ``value`` falls or stays along the order.

    The k-th value, or one less than ``SLACK`` rows lower, is found by counting; rows
    that reach it are ranked like any table, so neither a large k nor ties bring the
    rows into one task.
    """
    place = {"cut": lambda n: F.greatest(n - k, F.lit(0))}
    cut = values_at(rows, value, place, slack=SLACK)[0]["cut"]
    near = rows if cut is None else rows.filter(value >= cut)
    return positions(near, order, name=name).filter(F.col(name) <= k)


def _scored_best(df: DataFrame, score: str, id_col: str, k: int, name: str) -> DataFrame:
    rows = df.filter(number(score).isNotNull())
    return _best(rows, F.col(score).cast("double"), best_first(score, id_col), k, name)


def top_k(df: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    """k best rows, best first."""
    return _scored_best(df, score, id_col, k, "__rank").orderBy("__rank").drop("__rank")


def top_k_with_payload(
    scores: DataFrame, payload: DataFrame, score: str, id_col: str, k: int
) -> DataFrame:
    """k best with wide columns, joined only after the cut, so they never are sorted.

    The list's size is known when it is joined; adaptive execution sends it to
    the tasks if it is small.
    """
    return payload.join(_scored_best(scores, score, id_col, k, "__rank").drop("__rank"), id_col)


def top_fraction(df: DataFrame, score: str, id_col: str, ratio: float) -> DataFrame:
    """Best int(n * ratio) rows, with their rank; rows without a score count in n and come last."""
    counts = df.agg(F.count("*").alias("n"), F.count(number(score)).alias("scored")).first()
    k = math.floor(counts.n * ratio)
    if k > counts.scored:
        return rank_by(df, score, id_col).filter(F.col("rank") <= k)
    return _scored_best(df, score, id_col, k, "rank")


def top_models(df: DataFrame, model: str, id_col: str, metric: str, k: int) -> DataFrame:
    """k best entries per model with their rank; a model with many entries spreads over tasks."""
    placed = positions(df, [F.col(metric).desc_nulls_last(), F.col(id_col)], [model], "rank")
    return placed.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("int"))


def take_n(recipes: DataFrame, model: str, n: DataFrame, items: str, count: str) -> DataFrame:
    """First n entries of each model's ordered list; n differs per model.

    ``recipes`` has one ordered array per model.
    """
    return (
        recipes.join(n, model)
        .select(model, F.posexplode(F.slice(F.col(items), F.lit(1), F.col(count))))
        .withColumnsRenamed({"pos": "place", "col": "item"})
    )


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the smallest hash of (id, seed): uniform and repeatable."""
    mark = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    first = -F.conv(F.substring(mark, 1, 13), 16, 10).cast("double")  # 52 bits, exact in a double
    drawn = _best(df, first, [mark, F.col(id_col)], n, "__rank")
    return drawn.orderBy("__rank").drop("__rank")


def _counts_at(df: DataFrame, rank: str, ks: Sequence[int]) -> DataFrame:
    """For each k: rows with rank <= k, and that as a percentage of k. One pass."""
    counts = df.agg(*[F.count_if(F.col(rank) <= k).alias(f"k{k}") for k in ks])
    rows = [
        F.struct(
            F.lit(int(k)).cast("long").alias("k"),
            F.col(f"k{k}").alias("n_shared"),
            F.round(100.0 * F.col(f"k{k}") / k, 2).alias("percent"),
        )
        for k in ks
    ]
    return counts.select(F.inline(F.array(*rows)))


def first_ranks(df: DataFrame, score: str, id_col: str, key: str, upto: int | None = None) -> DataFrame:
    """Best rank of every key; a key repeated in the list counts once.

    With ``upto`` only that many best rows are ranked.
    """
    if upto is None:
        ranked = rank_by(df.filter(number(score).isNotNull()), score, id_col)
    else:
        ranked = _scored_best(df, score, id_col, upto, "rank")
    return ranked.groupBy(key).agg(F.min("rank").alias("rank"))


def overlap_at_k(
    df: DataFrame, score_a: str, score_b: str, id_col: str, key: str, ks: Sequence[int]
) -> DataFrame:
    """Distinct keys shared by two rankers' k best, for each k.

    Both lists are ranked once to the largest k; a key is shared at k when its
    worse rank is at most k. The scores are read several times, so they are
    written first.
    """
    scores = materialize(df.select(*dict.fromkeys((id_col, key, score_a, score_b))), "scores")
    a, b = (first_ranks(scores, s, id_col, key, max(ks)) for s in (score_a, score_b))
    both = a.join(b.withColumnRenamed("rank", "__other"), key)
    return _counts_at(both.withColumn("rank", F.greatest("rank", "__other")), "rank", ks)


def hits_in_top_k(df: DataFrame, hits: DataFrame, score: str, id_col: str, key: str, ks: Sequence[int]) -> DataFrame:
    """Distinct known hits among the k best, for each k."""
    listed = first_ranks(df, score, id_col, key, max(ks)).join(hits.select(key).distinct(), key, "left_semi")
    return _counts_at(listed, "rank", ks)


def coverage(df: DataFrame, scores: Sequence[str], label: str, id_col: str, k: int) -> DataFrame:
    """Per ranker: actives the others' union or the max vote finds in its k best and it does not.

    Also the actives it alone adds over the max vote.
    """
    narrow = df.select(id_col, label, *scores)
    votes = materialize(narrow.withColumn("max_vote", F.greatest(*[F.col(s) for s in scores])), "votes")
    lists = []
    for s in (*scores, "max_vote"):
        best = top_k(votes.select(id_col, label, s), s, id_col, k).filter(F.col(label) == 1)
        lists.append(best.select(id_col, F.lit(s).alias("__list")))
    found = (
        reduce(lambda a, b: a.union(b), lists)
        .groupBy(id_col)
        .agg(*[F.max((F.col("__list") == s).cast("int")).alias(s) for s in (*scores, "max_vote")])
    )
    anyone = F.greatest(*[F.col(s) for s in scores])
    counts = found.agg(
        *[F.count_if(F.col(s) == 1).alias(f"n_{s}") for s in scores],
        *[F.count_if((anyone == 1) & (F.col(s) == 0)).alias(f"u_{s}") for s in scores],
        *[F.count_if((F.col("max_vote") == 1) & (F.col(s) == 0)).alias(f"v_{s}") for s in scores],
        *[F.count_if((F.col("max_vote") == 0) & (F.col(s) == 1)).alias(f"w_{s}") for s in scores],
    )
    rows = [
        F.struct(
            F.lit(s).alias("model"),
            F.col(f"n_{s}").alias("actives"),
            F.col(f"u_{s}").alias("union_minus_model"),
            F.col(f"v_{s}").alias("vote_minus_model"),
            F.col(f"w_{s}").alias("model_minus_vote"),
        )
        for s in scores
    ]
    return counts.select(F.inline(F.array(*rows)))


def union_ids(dfs: Sequence[DataFrame], id_col: str) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [d.select(id_col) for d in dfs]).distinct()
