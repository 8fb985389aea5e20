"""Exact duplicates by a 128-bit content hash, told apart byte by byte.

Texts are grouped by (MD5, text): the hash deals the rows out and settles
nearly every comparison, the text itself keeps colliding texts apart. Equal
texts of a task are folded before the shuffle, so a text that a third of all
rows share leaves each task as one row. The narrow rows of the documents then
look their group up by MD5, SHA-256 and length; adaptive execution can split a
hot group there, since the other side has one row per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tamis.llm.sieve import marks, split
from tamis.llm.text import lower_ascii


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lower_ascii,
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Two texts are equal if they are identical after ``normalise``; null counts
    as empty. Of equal texts the row with the ``smallest`` or ``largest`` id
    stays. Other columns are ignored, whatever their names. Rows that repeat
    text and id get the same decision. A row without an id stays only if no row
    of its group has one. An empty table gives an empty table.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}, neither smallest nor largest")
    pick = F.min if keep == "smallest" else F.max
    texts = docs.select(
        F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("body")
    )

    def prints(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"sha": F.sha2("body", 256), "size": F.octet_length("body"), "hash": digest(F.col("body"))}
        )

    groups = (
        texts.select("id", "body", digest(F.col("body")).alias("hash"))
        .groupBy("hash", "body")
        .agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", F.sha2("body", 256).alias("sha"), F.octet_length("body").alias("size"), "keep_id", "group_size")
    )
    rows = prints(texts).select("id", "hash", "sha", "size")
    return rows.join(groups, ["hash", "sha", "size"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lower_ascii,
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row of each group of equal texts, all columns unchanged: that with the ``smallest`` or ``largest`` id.

    Rows without an id stay only where no row of the group has one; of rows with
    equal ids the least (greatest) text as it stands stays, of rows equal in
    that too any one. A null text equals the empty one. Only rows whose hash
    occurs twice or more are moved, and their bytes decide; an empty table stays
    empty.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}, neither smallest nor largest")

    def body(text: Column) -> Column:
        return normalise(F.coalesce(text, F.lit("")))

    key = F.xxhash64(digest(body(F.col(text_col))))
    twice = docs.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    may, others = split(docs, key, marks(twice))
    own_id, own_text = F.col("row")[id_col], F.col("row")[text_col]
    if keep == "smallest":
        pick = F.min_by("row", F.struct(own_id.isNull(), own_id, own_text))
    else:
        pick = F.max_by("row", F.struct(own_id.isNotNull(), own_id, own_text))
    rows = may.select("row", body(own_text).alias("body"))
    kept = rows.groupBy(digest(F.col("body")).alias("hash"), "body").agg(pick.alias("row"))
    return kept.select("row.*").unionByName(others.select("row.*"))
