"""Rows that cannot be concerned by a step go past it without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis.session import materialize

MOST_BITS = 1 << 26  # a million blocks of 64; bounds the broadcast


def marks(keys: DataFrame) -> tuple[DataFrame, int]:
    """A bit set of the ``key`` column (long), 16 bits for each key and ``MOST_BITS`` at most.

    With more keys than that it lets more rows through, which costs work and
    changes no result.
    """
    held = materialize(keys.select("key").distinct(), "keys")
    bits = min(MOST_BITS, 1 << max(10, (16 * held.count()).bit_length()))
    place = F.pmod("key", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    blocks = held.select(F.shiftright(place, 6).alias("block"), bit.alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("bits"))
    return materialize(blocks, "marks"), bits


def split(rows: DataFrame, key: Column, marked: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the marked ones, and rows whose key is not; each as ``row``, a struct."""
    blocks, bits = marked
    place = F.pmod(key, F.lit(bits))
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        F.shiftright(place, 6).alias("block"),
        place.bitwiseAND(F.lit(63)).cast("int").alias("bit"),
    ).join(F.broadcast(blocks), "block", "left")
    hit = F.coalesce(F.bit_get("bits", F.col("bit")) == 1, F.lit(False))
    return packed.filter(hit).select("row"), packed.filter(~hit).select("row")
