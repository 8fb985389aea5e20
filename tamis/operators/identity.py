"""Rows that share an id or a structure belong to one molecule (transitively)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.graph import components
from tamis.operators.order import positions_by_size
from tamis.session import materialize, passing_work, work_path


def group_identities(
    df: DataFrame,
    id_key: str,
    structure_key: str,
    order: Sequence[str | Column],
    group: str = "molecule_id",
    duplicate: str = "duplicate_id",
) -> DataFrame:
    """Molecule number and numbered duplicates.

    The molecule is named by its smallest id key. Ids and structures are the two
    sides of a graph; ids are linked through the smallest id of each structure,
    so a structure with a million ids gives a million links, not their square.
    A row without an id belongs to the molecule of its structure; if no row with
    that structure has an id, the structure is a molecule without a name. A row
    with neither is a molecule of its own.

    The rows are written once, with their molecule; ``df`` is not read afterwards.
    """
    spark = df.sparkSession
    path = work_path(spark, "named")
    with passing_work(spark):  # links and what the rounds over them leave
        pairs = df.select(F.col(id_key).alias("a"), F.col(structure_key).alias("b")).na.drop()
        hubs = pairs.groupBy("b").agg(F.min("a").alias("hub"), F.max("a").alias("far"))
        linking = materialize(hubs.filter("hub < far").select("b", "hub"), "hubs")
        found = components(pairs.join(linking, "b").select("a", F.col("hub").alias("b")))
        keyed = df.filter(F.col(id_key).isNotNull()).withColumn("__key", F.col(id_key))
        nameless = df.filter(F.col(id_key).isNull())
        by = [group]
        if not nameless.isEmpty():
            through = nameless.join(hubs.select("b", F.col("hub").alias("__key")), nameless[structure_key] == hubs["b"], "left")
            keyed = keyed.unionByName(through.select(*[nameless[c] for c in df.columns], "__key"))
            by = [group, "__alone"]
        named = keyed.join(found, keyed["__key"] == found["node"], "left").withColumn(group, F.coalesce("root", "__key"))
        alone = F.struct(F.col(structure_key), F.when(F.col(structure_key).isNull(), F.monotonically_increasing_id()))
        named = named.withColumn("__alone", F.when(F.col(group).isNull(), F.to_json(alone)))
        named = materialize(named.drop("__key", "node", "root"), path=path, codec="zstd")
    # By the molecule alone wherever all have a name: steps behind then need no other shuffle.
    numbered = positions_by_size(named, order, by, duplicate)
    return numbered.withColumn(duplicate, F.col(duplicate) - 1).drop("__alone")
