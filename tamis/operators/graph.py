"""Connected components of a graph of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamis.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node that has a link to another; ``root`` is the least node reachable.

    Each round hangs every node on its least neighbour, jumps once along these
    pointers and contracts what hangs together, until no link is left. Neighbour
    minima are folded before the shuffle; every join has one row per key on one
    side, read from a written table, so adaptive execution can split a hot key
    of the other. Links with a null end and loops link nothing.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    edges = materialize(ends, "links")
    tops = None  # node -> where it hangs after the rounds so far
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")),
            "hooks",
        )
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        jumped = materialize(hooks.join(above, "up").select("node", F.col("upper").alias("up")), "jumps")
        at_a = jumped.select(F.col("node").alias("a"), F.col("up").alias("top_a"))
        at_b = jumped.select(F.col("node").alias("b"), F.col("up").alias("top_b"))
        moved = edges.join(at_a, "a").join(at_b, "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
        edges = materialize(moved.filter("a <> b").distinct(), "links")
        if tops is None:
            tops = jumped
        else:
            step = jumped.select(F.col("node").alias("up"), F.col("up").alias("top"))
            tops = materialize(
                tops.join(step, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "tops"
            )
    if tops is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tops.withColumnRenamed("up", "root")
