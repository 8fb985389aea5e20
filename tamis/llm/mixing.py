"""Mixing sources to target weights by pivotal dependent rounding.

Sources get targets in words: a share of a total by weight, no more than
``most`` times what they have, the excess shared again. A document is then due
``target / size of its source`` copies; the whole part is certain, the
fractional part is rounded together with others. Two fractions exchange words
until one of them is 0 or 1, at random and without bias, so the words a source
takes stay what they were. A bucket of documents leaves one fraction at most;
the fractions left over are paired again in a reduction tree whose levels are
keyed by (source, group), until a source has one, which a last draw rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamis.llm.text import n_words, named
from tamis.operators.order import positions
from tamis.session import materialize

ALIKE = 64  # rows with the same id and size that one node may hold beside others
FAN_IN = 4096  # documents of a bucket, and fractions joined by a node of the tree


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from rows with ``source`` and ``size``.

    Sources by code point, null last, weigh ``weights`` in turn. They share
    ``share`` times all sizes; a target over ``most`` times its source's size
    stops there and the excess goes to the others by weight. That is one level
    of words per weight, found by a sum per round: a few numbers reach the
    driver, whatever the number of sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = [F.col("source").isNull(), F.col("source")]
    turn = F.pmod(F.col("position") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    sources = materialize(positions(sums, order).withColumn("weight", weight).drop("position"), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        held, left = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        new = (total - held * most) / left if left else math.inf
        if new <= level or not left:
            break
        level = new
    target = F.least(cap, F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(*keys: Column | int | str) -> Column:
    """In [0, 1), the same in every run."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def pivot(part: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Fractions after rounding them one against the next; one at most is still fractional.

    An exchange keeps ``size[i] * part[i] + size[j] * part[j]``, and its two
    outcomes have the odds that keep each fraction's mean.
    """
    out = part.copy()
    open_ = -1
    for i in range(len(out)):
        if not 0.0 < out[i] < 1.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        a, b = float(size[i]), float(size[j])
        up = min((1.0 - out[i]) * a, out[j] * b)  # words i can take from j
        down = min(out[i] * a, (1.0 - out[j]) * b)
        rise = coin[i] * (up + down) < down
        if rise:
            new_i, new_j = out[i] + up / a, out[j] - up / b
            i_done = (1.0 - out[i]) * a <= out[j] * b
            j_done = out[j] * b <= (1.0 - out[i]) * a
            out[i], out[j] = (1.0 if i_done else new_i), (0.0 if j_done else new_j)
        else:
            new_i, new_j = out[i] - down / a, out[j] + down / b
            i_done = out[i] * a <= (1.0 - out[j]) * b
            j_done = (1.0 - out[j]) * b <= out[i] * a
            out[i], out[j] = (0.0 if i_done else new_i), (1.0 if j_done else new_j)
        open_ = i if not i_done else (j if not j_done else -1)
    return out


def _round_groups(rows: DataFrame) -> DataFrame:
    """One level: rounds ``part`` inside each (source, node)."""

    def run(group: pa.Table) -> pa.Table:
        draw, part, size, coin = (group[c].to_numpy() for c in ("draw", "part", "size", "coin"))
        order = np.lexsort((part, size, draw))
        rounded = np.empty(len(order))
        rounded[order] = pivot(part[order], size[order], coin[order])
        at = group.schema.get_field_index("part")
        return group.set_column(at, group.schema.field(at), pa.array(rounded))

    return rows.groupBy("source", "node").applyInArrow(run, rows.schema)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, size, source_size, target, copies, taken``, and the columns ``keep``.

    ``size`` counts words, ``copies`` is 0 to ``most``, ``taken`` is their
    product. The words a source takes miss its target by less than its largest
    document. Documents without words take none. Null sources are one source, a
    null id is an id like others, repeated rows are rounded one by one, an empty
    table gives an empty table. Draws come from hashes of ids and sizes, so
    reruns agree; rows that more than ``ALIKE`` others equal in both are dealt
    out by their place as well, and may swap their decisions.
    """
    own = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *own)
    sized = materialize(sized, "sizes")
    alike = sized.groupBy("id", "size").agg(F.count("*").alias("n")).filter(F.col("n") > ALIKE)
    alike = alike.select(F.col("id").alias("alike_id"), F.col("size").alias("alike_size"), F.lit(1).cast("long").alias("alike"))
    placed = sized.withColumn("place", F.monotonically_increasing_id())
    same = F.col("id").eqNullSafe(F.col("alike_id")) & (F.col("size") == F.col("alike_size"))
    salt = F.coalesce(F.col("alike") * F.col("place"), F.lit(0).cast("long"))
    sized = placed.join(alike, same, "left").select("id", "source", "size", salt.alias("salt"), *[f"keep_{i}" for i in range(len(keep))])
    targets = source_targets(sized, weights, share, float(most))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.least(due, F.lit(float(most))))
    nodes = F.ceil(F.col("n_docs") / FAN_IN)
    rows = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .select("id", sized["source"], "size", "salt", *[f"keep_{i}" for i in range(len(keep))], "source_size", "target", due.alias("due"), whole.alias("whole"), nodes.alias("nodes"))
        .withColumns(
            {
                "part": F.when(F.col("size") > 0, F.col("due") - F.col("whole")).otherwise(F.lit(0.0)),
                "draw": _uniform("draw", F.lit(seed), F.col("id"), F.col("size"), F.col("salt")),
                "coin": _uniform("coin", F.lit(seed), F.col("id"), F.col("size"), F.col("salt")),
                "node": F.floor(_uniform("node", F.lit(seed), F.col("id"), F.col("size"), F.col("salt")) * F.col("nodes")),
            }
        )
        .drop("due")
    )
    done, nodes_left = None, None
    while True:
        level = materialize(_round_groups(rows), "level")
        open_ = (F.col("part") > 0) & (F.col("part") < 1)
        closed = level.filter(~open_)
        done = closed if done is None else done.unionByName(closed)
        nodes_left = level.filter(open_).agg(F.max("nodes")).first()[0]
        if nodes_left is None or nodes_left <= 1:
            last = level.filter(open_).withColumn("part", (F.col("coin") < F.col("part")).cast("double"))
            done = done.unionByName(last)
            break
        rows = level.filter(open_).withColumns(
            {"node": F.floor(F.col("node") / FAN_IN), "nodes": F.ceil(F.col("nodes") / FAN_IN), "coin": _uniform("again", F.col("coin"))}
        )
    copies = (F.col("whole") + F.col("part")).cast("long")
    return done.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 2, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its own copies say, all columns unchanged.

    Rows that share an id are decided one by one. The rows are written once with
    a number; decisions come back as bits, 64 rows in one.
    """
    row = named(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    sizes = rows.select(*[F.col(c).alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"), (row, "row"))])
    decided = mixed(sizes, "id", most=most, keep=["row"], **options)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(F.lit(63)).cast("int"))
    bits = [F.bit_or(F.when(F.col("copies") >= k, one).otherwise(F.lit(0).cast("long"))).alias(f"bits_{k}") for k in range(1, most + 1)]
    decided = materialize(decided.filter("copies > 0").groupBy(F.shiftright("row", 6).alias("block")).agg(*bits), "decided")
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(row).alias("row"))
    joined = packed.withColumn("block", F.shiftright("row", 6)).join(decided, "block")
    times = sum(F.bit_get(f"bits_{k}", F.col("row").bitwiseAND(F.lit(63)).cast("int")).cast("int") for k in range(1, most + 1))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), times)).alias("time")).select("doc.*")
