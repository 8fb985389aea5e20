"""Joins of catalogs with known sets, clusters, scores and corrections.

The side that could be hot is always joined with one row per key on the other
side, so a hot key multiplies nothing and adaptive execution can split it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.rows import number
from tamis.operators.order import positions


def join_suffix(left: DataFrame, right: DataFrame, lk: str, rk: str, suffix: str = "_y") -> DataFrame:
    """Inner join; the right side's colliding columns get the suffix."""
    shared = set(left.columns) & set(right.columns)
    renamed = right.withColumnsRenamed({c: c + suffix for c in shared})
    key = rk + suffix if rk in shared else rk
    joined = left.join(renamed, left[lk] == renamed[key])
    return joined.drop(key) if lk == rk else joined


def enrich(df: DataFrame, info: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Inner join with a projection of ``info`` reduced to one row per key.

    Of several rows the smallest is kept, so the result does not depend on order.
    """
    one = info.groupBy(on).agg(F.min(F.struct(*cols)).alias("__info")).select(on, "__info.*")
    return df.join(one, on)


def text_key(text: str | Column) -> Column:
    """128-bit digest of a long text, to join on instead of the text itself."""
    return F.md5(text)


def exclude_known(df: DataFrame, *known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in no known table, and apart from them the rows without a key.

    SQL never matches NULL with NULL; rows without a structure are set aside
    instead of passing as new. Long texts are better compared by ``text_key``.
    """
    seen = reduce(lambda a, b: a.union(b), [k.select(key) for k in known]).distinct()
    return df.filter(F.col(key).isNotNull()).join(seen, key, "left_anti"), df.filter(F.col(key).isNull())


def exclusion_report(df: DataFrame, *known: DataFrame, key: str) -> DataFrame:
    kept, unkeyed = exclude_known(df, *known, key=key)
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        kept.agg(F.count("*")).scalar().alias("n_kept"),
        unkeyed.agg(F.count("*")).scalar().alias("n_without_key"),
    ).withColumn("n_removed", F.col("n_rows") - F.col("n_kept") - F.col("n_without_key"))


def exclude_shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key does not occur in ``b``; rows without a key are not new."""
    return a.filter(F.col(key).isNotNull()).join(b.select(key).distinct(), key, "left_anti")


def leaders(df: DataFrame, id_col: str, leader: str) -> DataFrame:
    """Rows whose id is some row's cluster leader."""
    ids = df.select(F.col(leader).alias(id_col)).distinct()
    return df.join(ids, id_col, "left_semi")


def reconcile(left: DataFrame, right: DataFrame, key_a: tuple[str, str], key_b: tuple[str, str], id_col: str) -> DataFrame:
    """Ids of ``left`` by the keys on which they meet ``right``: ``found_by`` a, b, both."""
    by = []
    for name, (lk, rk) in (("a", key_a), ("b", key_b)):
        keys = right.select(F.col(rk).alias(lk)).distinct()
        by.append(left.join(keys, lk, "left_semi").select(id_col, F.lit(name).alias("__way")))
    found = by[0].union(by[1]).groupBy(id_col).agg(
        F.max((F.col("__way") == "a").cast("int")).alias("a"),
        F.max((F.col("__way") == "b").cast("int")).alias("b"),
    )
    way = F.when(F.col("a") + F.col("b") == 2, "both").when(F.col("a") == 1, "a").otherwise("b")
    return found.select(id_col, way.alias("found_by"))


def only_one_way(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter("found_by <> 'both'")


def zip_rows(
    a: DataFrame, b: DataFrame, a_order: Sequence[str | Column], b_order: Sequence[str | Column], key: tuple[str, str]
) -> DataFrame:
    """Row i of ``a`` beside row i of ``b``, with ``aligned`` telling whether the keys agree.

    Prefer a join on the key; this is for files that promise equal order.
    """
    left = positions(a, a_order, name="__position")
    right = positions(b, b_order, name="__position")
    both = left.join(right, "__position", "full")
    same = F.coalesce(F.col(key[0]) == F.col(key[1]), F.lit(False))
    return both.withColumn("aligned", same.cast("int")).withColumnRenamed("__position", "position")


def cluster_flags(
    candidates: DataFrame, clusters: DataFrame, cluster: str, dataset: str, hit: str, sets: Sequence[str]
) -> DataFrame:
    """Per candidate and reference set: is its cluster seen there, and seen with a hit."""
    seen = clusters.groupBy(cluster).agg(
        *[F.max((F.col(dataset) == s).cast("int")).alias(f"in_{s}") for s in sets],
        *[
            (F.sum(F.when(F.col(dataset) == s, F.col(hit)).otherwise(0)) > 0).cast("int").alias(f"active_in_{s}")
            for s in sets
        ],
    )
    flags = [f"{kind}_{s}" for s in sets for kind in ("in", "active_in")]
    return candidates.join(seen, cluster, "left").fillna(0, subset=flags)


def attach_fold(df: DataFrame, folds: DataFrame, key: str, fold: str = "fold_id") -> DataFrame:
    """Fold number written back on the full table; a row of no fold keeps NULL."""
    return df.join(folds.select(key, fold), key, "left")


def compare_maps(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Entries of ``a`` that do not meet exactly one equal entry in ``b``."""
    right = b.groupBy(key).agg(F.count("*").alias("n_matches"), F.min(value).alias("__other"))
    both = a.join(right, key, "left").fillna(0, subset=["n_matches"])
    agree = (F.col("n_matches") == 1) & F.col(value).eqNullSafe(F.col("__other"))
    return both.filter(~agree).select(key, value, F.col("__other").alias("other"), "n_matches")


def append_unmatched(left: DataFrame, right: DataFrame, on: str, match: DataFrame) -> DataFrame:
    """``left`` plus the rows of ``right`` that ``match`` lacks on ``on``."""
    rest = right.join(match.select(on).distinct(), on, "left_anti")
    return left.unionByName(rest, allowMissingColumns=True)


def join_scores(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Scores of two rankers side by side per compound."""
    return a.join(b, on)


def max_vote(cols: Sequence[str]) -> Column:
    """Row maximum of base predictions, on their own scales; NaN is no vote."""
    votes = [number(c) for c in cols]
    return F.greatest(*votes) if len(votes) > 1 else votes[0]
