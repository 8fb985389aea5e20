"""Values at given places of the order, found by counting buckets instead of sorting.

A round maps each value to a bucket that rises with it and counts the buckets;
running sums over the counts tell which bucket holds a place. The next round
reads only the rows of that bucket and cuts it finer. The table is neither
sorted nor written: tasks fold their rows to counts before the shuffle, and a
group has at most about a million buckets, however many rows.

The first buckets are 256 to the octave, later ones 65 536 to the range of values
found, so a few rounds end at single values. The input is read once a round and
must be the same each time. Groups are counted first: those small enough for a
task are sorted there, in one shuffle, and only the larger ones are searched.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tamis.session import materialize

SMALL = 1 << 16  # values of a group that one task may sort
OCTAVE = 256
FINER = 1 << 16
ABOVE_ZERO = 300_000  # more than 256 times the octaves below one
INFINITE = 1_000_000

Place = Callable[[Column], Column]  # number of values -> 0-based place in ascending order


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.abs(value)
    step = (
        F.when(size == 0, 0)
        .when(size == float("inf"), INFINITE)
        .otherwise(F.floor(F.log2(size) * OCTAVE) + ABOVE_ZERO)
    )
    return F.when(value < 0, -step).otherwise(step)


def _finer(value: Column, low: Column, high: Column) -> Column:
    return F.floor((value - low) / (high - low) * FINER)


def _counted(rows: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """Buckets with their count, ends and the number of values before them in their group."""
    buckets = rows.groupBy(*by, "__bucket").agg(
        F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), *more
    )
    group = W.partitionBy(*by)
    before = F.sum("__n").over(group.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    return buckets.withColumns(
        {"__before": F.coalesce(before, F.lit(0)), "__total": F.sum("__n").over(group)}
    )


def _holding(buckets: DataFrame, keys: Sequence[str], wants: Column) -> DataFrame:
    """One row per wanted place: the bucket that holds it and the place inside it."""
    here = lambda w: (F.col("__before") <= w["place"]) & (w["place"] < F.col("__before") + F.col("__n"))
    inside = F.col("place") - F.col("__before")
    value = (
        F.when((inside == 0) | (F.col("__min") == F.col("__max")), F.col("__min"))
        .when(inside == F.col("__n") - 1, F.col("__max"))
    )
    return buckets.select(
        *keys, "__n", "__min", "__max", "__before", F.inline(F.filter(wants, here))
    ).select(*keys, "name", "size", inside.alias("place"), "__min", "__max", value.alias("value"))


def _numbers(df: DataFrame, value: str | Column, keys: Sequence[str]) -> DataFrame:
    """The rows with a number."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(*keys, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))


def _first(rows: DataFrame, places: Mapping[str, Place], keys: Sequence[str]) -> DataFrame:
    """The first round over the rows with a number."""
    wants = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                at(F.col("__total")).cast("long").alias("place"),
                F.col("__total").alias("size"),
            )
            for name, at in places.items()
        ]
    )
    return _holding(_counted(rows.withColumn("__bucket", bucket(F.col("__v"))), keys), keys, wants)


def values_at(
    df: DataFrame, value: str | Column, places: Mapping[str, Place], slack: int = 0
) -> tuple[dict[str, float | None], int]:
    """The values at some places of the whole table, None where there is no such place; and how many values there are.

    The driver sees one row per place and round. The count is 0 if no place was met.
    With ``slack`` a value up to so many places lower will do, which spares rounds.
    """
    rows = _numbers(df, value, [])
    found = _first(rows, places, [])
    out: dict[str, float | None] = dict.fromkeys(places)
    size = 0
    while True:
        lower = F.when(F.col("place") <= slack, F.col("__min"))
        picks = found.withColumn("value", F.coalesce("value", lower)).collect()
        size = max([size, *(p["size"] for p in picks)])
        out |= {p.name: p.value for p in picks if p.value is not None}
        wanted: dict[tuple[float, float], list] = {}
        for p in picks:
            if p.value is None:
                wanted.setdefault((p["__min"], p["__max"]), []).append(p)
        if not wanted:
            return out, size
        v = F.col("__v")
        cuts, wants = F, F
        for i, ((low, high), places_in) in enumerate(wanted.items()):
            part = F.struct(F.lit(i).alias("part"), _finer(v, F.lit(low), F.lit(high)).alias("step"))
            cuts = cuts.when(v.between(low, high), part)
            wants = wants.when(
                F.col("__part") == i,
                F.array(
                    *[
                        F.struct(
                            F.lit(p.name).alias("name"),
                            F.lit(p.place).cast("long").alias("place"),
                            F.lit(p["size"]).cast("long").alias("size"),
                        )
                        for p in places_in
                    ]
                ),
            )
        near = reduce(lambda a, b: a | b, [v.between(low, high) for low, high in wanted])
        cut = rows.filter(near).withColumn("__cut", cuts)
        steps = cut.select("__v", F.col("__cut.part").alias("__part"), F.col("__cut.step").alias("__bucket"))
        found = _holding(_counted(steps, ["__part"]), [], wants)


def group_values_at(
    df: DataFrame, value: str | Column, places: Mapping[str, Place], keys: Sequence[str], size: str = "size"
) -> DataFrame:
    """The values at some places of each group, and its number of values as ``size``.

    One row per group that has one of the places; NULL for those it does not have.
    """
    rows = _numbers(df, value, keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    large = materialize(
        sizes.filter(F.col("__n") > SMALL).select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)]), "large"
    )
    if large.isEmpty():
        return _sorted_values(rows, places, keys, size)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)])
    hot = F.broadcast(large)  # a row per 65 536 rows at most
    small = _sorted_values(rows.join(hot, same, "left_anti"), places, keys, size)
    return small.unionByName(_searched_values(rows.join(hot, same, "left_semi"), places, keys, size))


def _sorted_values(rows: DataFrame, places: Mapping[str, Place], keys: Sequence[str], size: str) -> DataFrame:
    """The same for groups that fit a task."""
    groups = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__all"))
    counted = groups.withColumn("__total", F.size("__all").cast("long"))
    spots = {name: at(F.col("__total")).cast("int") for name, at in places.items()}
    has = reduce(lambda a, b: a | b, [spot.between(0, F.col("__total") - 1) for spot in spots.values()])
    return counted.filter(has).select(
        *keys, F.col("__total").alias(size), *[F.get("__all", spot).alias(name) for name, spot in spots.items()]
    )


def _searched_values(rows: DataFrame, places: Mapping[str, Place], keys: Sequence[str], size: str) -> DataFrame:
    """The same for groups of any size.

    What later rounds need of a group, at most two numbers and a name per place,
    is written and joined to the rows.
    """
    found = _first(rows, places, keys)
    rounds = []
    while True:
        found = materialize(found, "places")
        rounds.append(found.select(*keys, "name", "size", "value"))
        open_ = found.filter(F.col("value").isNull())
        if open_.isEmpty():
            break
        wants = open_.groupBy(*keys, "__min", "__max").agg(
            F.collect_list(F.struct("name", "place", "size")).alias("__wants")  # as many as places at most
        )
        ends = {"__min": "__low", "__max": "__high", **{k: f"__key_{i}" for i, k in enumerate(keys)}}
        wants = wants.withColumnsRenamed(ends)
        v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
        same = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(ends[k])) for k in keys], v.between(low, high)
        )
        steps = rows.join(wants, same).withColumn("__bucket", _finer(v, low, high))
        part = [*keys, "__low", "__high"]
        found = _holding(
            _counted(steps, part, F.first("__wants").alias("__wants")), keys, F.col("__wants")
        )
    every = reduce(DataFrame.unionByName, rounds)
    return every.groupBy(*keys).agg(
        F.max("size").alias(size),
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in places],
    )
