"""Global and per-group order, computed without one task holding a group.

``running_totals`` is the base: rows are range-partitioned by (group, order), so
a group that holds a third of the table spreads over a third of the partitions.
Each partition is summed by itself and shifted by the totals of the partitions
before it. The sorted rows are written once, because the range bounds come from
a sample and must not change between the two reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tamis.operators.selection import SMALL, group_values_at, values_at
from tamis.session import materialize

SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row below


def _columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def running_totals(
    df: DataFrame,
    order_by: Sequence[str | Column],
    measures: dict[str, str | Column],
    partition_by: Sequence[str] = (),
    totals: bool = False,
) -> DataFrame:
    """Add ``measures[name]`` summed from the group's first row to this one.

    ``order_by`` must be a total order. With ``totals`` the sum over the whole
    group is added too, as ``<name>_total``.
    """
    group = F.struct(*partition_by) if partition_by else F.struct(F.lit(0).alias("all"))
    keys = [*map(F.col, partition_by), *_columns(order_by)]
    ins = [(F.col(m) if isinstance(m, str) else m).alias(f"__in_{n}") for n, m in measures.items()]
    slot = F.shiftright("__row", SLOT_BITS)
    rows = materialize(
        df.select("*", *ins)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__row", F.monotonically_increasing_id()),
        "ordered",
    ).withColumns({"__slot": slot, "__group": group})

    pieces = rows.groupBy("__slot", "__group").agg(
        *[F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in measures]
    )
    before = W.partitionBy("__group").orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select(
        "__slot",
        "__group",
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__shift_{n}") for n in measures],
        *[F.sum(f"__sum_{n}").over(W.partitionBy("__group")).alias(f"{n}_total") for n in measures if totals],
    )
    if not partition_by:
        shifts = F.broadcast(shifts)  # one row per range partition
    inside = (
        W.partitionBy("__slot", "__group").orderBy("__row").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    summed = rows.select("*", *[F.sum(f"__in_{n}").over(inside).alias(f"__cum_{n}") for n in measures])
    return summed.join(shifts, ["__slot", "__group"]).select(
        *df.columns,
        *[(F.col(f"__cum_{n}") + F.col(f"__shift_{n}")).alias(n) for n in measures],
        *[f"{n}_total" for n in measures if totals],
    )


def positions(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "position",
    size: str | None = None,
) -> DataFrame:
    """Number rows 1..n in ``order_by``; optionally add the group's row count."""
    if partition_by:
        out = running_totals(df, order_by, {name: F.lit(1)}, partition_by, totals=size is not None)
        return out.withColumnRenamed(f"{name}_total", size) if size else out
    keys = _columns(order_by)
    rows = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__row", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("__slot", F.shiftright("__row", SLOT_BITS))
    counts = rows.groupBy("__slot").agg(F.count("*").alias("__n"))
    before = W.orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(  # one row per range partition
        "__slot",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
        F.sum("__n").over(W.partitionBy()).alias("__total"),
    )
    inside = F.col("__row").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    return rows.join(F.broadcast(shifts), "__slot").select(
        *df.columns,
        (inside + F.col("__shift") + 1).alias(name),
        *([F.col("__total").alias(size)] if size else []),
    )


def positions_by_size(
    df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str], name: str = "position"
) -> DataFrame:
    """``positions`` of grouped rows, without writing those of groups that fit a task.

    Groups of up to 65 536 rows are numbered in the tasks that hold them, after one
    shuffle by group; only larger ones are cut in ranges. The table is read more
    than once and must be the same each time, such as a written one.
    """
    sizes = df.groupBy(*partition_by).agg(F.count("*").alias("__n"))
    large = materialize(
        sizes.filter(F.col("__n") > SMALL).select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(partition_by)]),
        "large",
    )
    number = F.row_number().over(W.partitionBy(*partition_by).orderBy(*_columns(order_by))).cast("long")
    if large.isEmpty():
        return df.withColumn(name, number)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(partition_by)])
    hot = F.broadcast(large)  # a row per 65 536 rows at most
    small = df.join(hot, same, "left_anti").withColumn(name, number)
    return small.unionByName(positions(df.join(hot, same, "left_semi"), order_by, partition_by, name))


def hash_positions(
    df: DataFrame,
    key: str,
    partition_by: Sequence[str] = (),
    seed: int | None = None,
    name: str = "position",
    size: str = "group_size",
    digits: int = 4,
) -> DataFrame:
    """Number the rows of each group in the order of a hash of their key.

    The hash is uniform, so its first ``digits`` hex digits are equal ranges
    known beforehand: no sampling and no written table. A hot group falls into
    16**digits pieces. ``key`` must be unique.
    """
    text = F.col(key).cast("string")
    if seed is not None:
        text = F.concat(text, F.lit(f":{seed}"))
    rows = df.withColumn("__hash", F.md5(text)).withColumn("__piece", F.substring("__hash", 1, digits))
    group = F.struct(*partition_by) if partition_by else F.struct(F.lit(0).alias("all"))
    rows = rows.withColumn("__group", group)
    counts = rows.groupBy("__group", "__piece").agg(F.count("*").alias("__n"))
    before = W.partitionBy("__group").orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        "__group",
        "__piece",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
        F.sum("__n").over(W.partitionBy("__group")).alias(size),
    )
    inside = F.row_number().over(W.partitionBy("__group", "__piece").orderBy("__hash", key))
    return (
        rows.withColumn("__inside", inside)
        .join(shifts, ["__group", "__piece"])
        .select(*df.columns, (F.col("__inside") + F.col("__shift")).alias(name), size)
    )


def part_of(position: Column, size: Column, parts: int) -> Column:
    """0-based part of a 1-based position when ``size`` rows are cut in ``parts``
    nearly equal runs, the first ``size mod parts`` runs one row longer."""
    base = F.floor(size / parts)
    longer = size - base * parts
    split = longer * (base + 1)
    at = position - 1
    return (
        F.when(at < split, F.floor(at / (base + 1)))
        .otherwise(longer + F.floor((at - split) / F.greatest(base, F.lit(1))))
        .cast("int")
    )


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated exact quantiles per group, one column per entry; NULL and NaN are no values.

    Found by counting buckets; a task sorts only groups of up to 65 536 values.
    Without ``partition_by`` there is one row, of NULLs if there is no value.
    """
    places = {}
    for name, q in quantiles.items():
        places[f"__lo_{name}"] = lambda n, q=float(q): F.floor((n - 1) * F.lit(q))
        places[f"__hi_{name}"] = lambda n, q=float(q): F.ceil((n - 1) * F.lit(q))
    if partition_by:
        ends = group_values_at(df, value, places, partition_by, "__size")
    else:
        values, size = values_at(df, value, places)
        ends = df.sparkSession.range(1).select(
            F.lit(size).alias("__size"), *[F.lit(v).cast("double").alias(n) for n, v in values.items()]
        )

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        spot = (F.col("__size") - 1) * F.lit(float(q))
        return F.when(low == high, low).otherwise(low + (high - low) * (spot - F.floor(spot)))

    return ends.select(*partition_by, *[between(name, q).alias(name) for name, q in quantiles.items()])


def grouped_median(df: DataFrame, value: str, partition_by: Sequence[str], name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, partition_by)
