"""Folds, rotations and holdouts.

Shuffling is the order of a hash of the id: repeatable, and computed in 65536
equal hash ranges per class, so the class that holds nearly all rows is never
sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.order import hash_positions, part_of, running_totals


def stratified_folds(
    df: DataFrame, id_col: str, label: str, k: int = 10, seed: int | None = None, name: str = "fold_id"
) -> DataFrame:
    """Each class shuffled and cut in k parts; the first n mod k parts get one more row."""
    placed = hash_positions(df, id_col, [label], seed, "__position", "__size")
    return placed.withColumn(name, part_of(F.col("__position"), F.col("__size"), k)).drop(
        "__position", "__size"
    )


def library_folds(
    df: DataFrame, id_col: str, group: str, label: str, k: int = 10, seed: int | None = None, name: str = "fold_id"
) -> DataFrame:
    """Stratified inside each library; larger parts go to the folds with fewest actives so far.

    Folds differ by one active at most, so the fewest are found by going round:
    a library starts at the fold after the last one that got an extra active,
    which a running total over the libraries gives. Rows without a library are
    one library, the first.
    """
    counts = df.groupBy(F.col(group).alias("__library")).agg(F.count_if(F.col(label) == 1).alias("__n"))
    upto = running_totals(counts.withColumn("__extra", F.col("__n") % k), ["__library"], {"__upto": "__extra"})
    starts = upto.select("__library", (F.col("__upto") - F.col("__extra")).alias("__start"))
    placed = hash_positions(df, id_col, [group, label], seed, "__position", "__size")
    part = part_of(F.col("__position"), F.col("__size"), k)
    return (
        placed.join(starts, placed[group].eqNullSafe(starts["__library"]))
        .withColumn(name, ((part + F.col("__start")) % k).cast("int"))
        .select(*df.columns, name)
    )


def multi_label_folds(
    df: DataFrame, id_col: str, cols: Sequence[str], k: int = 10, seed: int | None = None, name: str = "fold_id"
) -> DataFrame:
    """Balanced on a label combination (NULL is a value).

    A combination with fewer than k rows gives one row to each of some folds;
    each combination starts at a fold of its own.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    start = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % k
    placed = hash_positions(df, id_col, cols, seed, "__position", "__size")
    part = part_of(F.col("__position"), F.col("__size"), k)
    return placed.withColumn(name, ((part + start) % k).cast("int")).drop("__position", "__size")


def rotation(run: int, use_val: bool = True) -> dict[str, list[int]]:
    """Folds of train, val and test in run 0..5.

    Runs 0-3 rotate over folds 0-7; run 4 trains on 0-7 and tests on 9; run 5
    may use every fold but 9. Without validation its fold joins the training.
    """
    if not 0 <= run <= 5:
        raise ValueError("run must be 0..5")
    folds = range(10) if run == 5 else range(8)
    test, val = (9, 8) if run >= 4 else (2 * run + 1, 2 * run)
    held = {test, val} if use_val else {test}
    return {"train": [f for f in folds if f not in held], "val": [val] if use_val else [], "test": [test]}


def cv_split(df: DataFrame, run: int, use_val: bool = True, fold: str = "fold_id", name: str = "split") -> DataFrame:
    """Rows of the run's folds with their split; other folds are left out."""
    split: Column = F.lit(None).cast("string")
    for part, folds in rotation(run, use_val).items():
        if folds:
            split = F.when(F.col(fold).isin(folds), part).otherwise(split)
    return df.withColumn(name, split).filter(F.col(name).isNotNull())


def loo_fold(df: DataFrame, i: int, fold: str = "fold_id", name: str = "split") -> DataFrame:
    """Fold i is the test, all others train."""
    return df.withColumn(name, F.when(F.col(fold) == i, "test").otherwise("train"))


def holdout(
    df: DataFrame, id_col: str, label: str, frac: float = 0.8, seed: int | None = None, name: str = "split"
) -> DataFrame:
    """One stratified split: the first round(frac * n) rows of each class train, the rest validate."""
    placed = hash_positions(df, id_col, [label], seed, "__position", "__size")
    train = F.col("__position") <= F.round(F.col("__size") * F.lit(float(frac)))
    return placed.withColumn(name, F.when(train, "train").otherwise("val")).drop("__position", "__size")
