"""Filters, predicates and labels on raw readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.order import grouped_median
from tamis.session import materialize

SENTINEL = -1  # label of a row that was not measured


def clean_readings(df: DataFrame, value: str, structure: str, lower: float = -100.0) -> DataFrame:
    """Readings above the bound with a structure. NaN sorts above all numbers, so it is dropped by name."""
    return df.filter((F.col(value) > lower) & ~F.isnan(value) & F.col(structure).isNotNull())


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def fill_missing(df: DataFrame, value: float = 0, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(cols) if cols else None)


def drop_sentinel(df: DataFrame, label: str, sentinel: int = SENTINEL) -> DataFrame:
    return df.filter(F.col(label) != sentinel)


def at_dose(df: DataFrame, control: str, dose: str, level: float = 33.0) -> DataFrame:
    """Rows of no control state at one concentration; control is empty, not NULL."""
    return df.filter((F.col(control) == "") & (F.col(dose).try_cast("double") == level))


def flag_retest(df: DataFrame, plate: str, mark: str = "CP", name: str = "is_retest") -> DataFrame:
    return df.withColumn(name, F.col(plate).contains(mark).cast("int"))


def contains_counts(df: DataFrame, col: str, codes: Sequence[str]) -> DataFrame:
    """Rows containing each code, in one pass; a row may count for many codes."""
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(col).contains(c)).alias(f"c{i}") for i, c in enumerate(codes)],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("code"), F.col(f"c{i}").alias("n")) for i, c in enumerate(codes)]
    )
    return counts.select("n_rows", F.inline(pairs)).select("code", "n", "n_rows")


def in_ranges(ranges: Mapping[str, tuple[float, float]]) -> Column:
    """All columns inside their inclusive range."""
    return reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()])


def range_filter(df: DataFrame, ranges: Mapping[str, tuple[float, float]], status: str | None = None) -> DataFrame:
    keep = in_ranges(ranges)
    return df.filter(keep & (F.col(status) == "OK") if status else keep)


def pass_fraction(df: DataFrame, keep: Column) -> DataFrame:
    """Rows in, rows kept, percentage with one digit."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(keep).alias("n_passed")
    ).withColumn("percent_passed", F.round(100.0 * F.col("n_passed") / F.col("n_rows"), 1))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after, and rows failing at, each of several filters in sequence.

    One pass: a row is charged to the first stage it fails; NULL fails.
    """
    failed = F
    for i, (_, keep) in enumerate(stages):
        failed = failed.when(~F.coalesce(keep, F.lit(False)), i)
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(failed == i).alias(f"f{i}") for i in range(len(stages))],
    )
    rows, left = [], F.col("total")
    for i, (name, _) in enumerate(stages):
        left = left - F.col(f"f{i}")
        rows.append(
            F.struct(
                F.lit(i + 1).alias("stage"),
                F.lit(name).alias("filter"),
                F.col(f"f{i}").alias("n_failed"),
                left.alias("n_left"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def passing(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [keep for _, keep in stages]))


def median_over(df: DataFrame, value: str, keys: Sequence[str], name: str = "median") -> DataFrame:
    """Median of a group on each of its rows. The join's other side has one row per group."""
    return df.join(grouped_median(df, value, keys, name), list(keys), "left")


def activity_labels(
    df: DataFrame, molecule: str, value: str, retest: str, alert: str | Column, threshold: float = 35.0
) -> DataFrame:
    """Per molecule: primary, retest and alert filter and the activity they give.

    A molecule without retest readings has no retest median and is inactive.
    ``alert`` is 1 on any row that raised one.
    """
    flagged = df.withColumn("__alert", F.col(alert) if isinstance(alert, str) else alert)
    medians = grouped_median(flagged, value, [molecule, retest])
    wide = medians.groupBy(molecule).agg(
        F.max(F.when(F.col(retest) == 0, F.col("median"))).alias("primary_median"),
        F.max(F.when(F.col(retest) == 1, F.col("median"))).alias("retest_median"),
    )
    alerts = flagged.groupBy(molecule).agg(F.max("__alert").alias("__alert"))
    reached = lambda c: F.coalesce(F.col(c) >= threshold, F.lit(False)).cast("int")
    return (
        alerts.join(wide, molecule, "left")
        .select(
            molecule,
            "primary_median",
            "retest_median",
            reached("primary_median").alias("primary_filter"),
            reached("retest_median").alias("retest_filter"),
            (1 - F.coalesce(F.col("__alert"), F.lit(0))).alias("alert_filter"),
        )
        .withColumn(
            "activity", F.col("primary_filter") * F.col("retest_filter") * F.col("alert_filter")
        )
    )


def label_activity(
    df: DataFrame, molecule: str, value: str, retest: str, alert: str | Column, threshold: float = 35.0
) -> DataFrame:
    """The molecule's label copied to all its rows.

    Labels are written, so that no shuffle behind them is left when the rows are shuffled.
    """
    labels = materialize(activity_labels(df, molecule, value, retest, alert, threshold), "labels")
    # One row per molecule already; said so, for the planner to leave the join out where no label is used.
    return df.join(labels.dropDuplicates([molecule]), molecule, "left")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str, mode: str = "weighted_sample", name: str = "class_weight") -> DataFrame:
    """Weight 1 for class 0 and n0/n1 for class 1, none for other labels; or 0.5 each with ``no_weight``."""
    if mode == "no_weight":
        return df.withColumn(name, F.lit(0.5))
    if mode != "weighted_sample":
        raise ValueError("mode is no_weight or weighted_sample")
    ratio = df.agg(
        (F.count_if(F.col(label) == 0) / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("ratio")
    )
    return df.withColumn(name, F.when(F.col(label) == 0, 1.0).when(F.col(label) == 1, ratio.scalar()))


def sample_weights(df: DataFrame, label: str, mode: str = "weighted_sample", name: str = "sample_weight") -> DataFrame:
    """Weight n / (rows whose label has the same integer part); or 1 with ``no_weight``."""
    if mode == "no_weight":
        return df.withColumn(name, F.lit(1.0))
    if mode != "weighted_sample":
        raise ValueError("mode is no_weight or weighted_sample")
    whole = F.when(F.col(label) >= 0, F.floor(label)).otherwise(F.ceil(label)).alias("__class")
    sizes = df.groupBy(whole).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("n"))
    weights = sizes.select("__class", (total.scalar() / F.col("__n")).alias(name))
    return df.select("*", whole).join(weights, "__class", "left").drop("__class")


def collapse_primary(
    df: DataFrame,
    molecule: str,
    duplicate: str,
    value: str,
    lists: Mapping[str, str],
    firsts: Sequence[str],
    median: str = "primary_median",
) -> DataFrame:
    """One row per molecule: median reading, distinct ids joined, first of the others.

    ``lists`` maps output name to column; ids are sorted before joining.
    ``firsts`` come from the row with the lowest duplicate number. Medians are
    written, so that no shuffle behind them is left when the rows are shuffled.
    """
    medians = materialize(grouped_median(df, value, [molecule], median), "medians")
    plain = df.groupBy(molecule).agg(
        F.min_by(F.struct(*firsts), duplicate).alias("__first"),
        *[F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(n) for n, c in lists.items()],
    ).select(molecule, *[F.col(f"__first.{c}").alias(c) for c in firsts], *lists)
    return plain.join(medians, molecule, "left")
