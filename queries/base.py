"""Registry and the views the queries share; each view exists once per dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.functions.bits import pack_bits, sign_bits
from tamis.functions.text import canonical
from tamis.operators.joins import text_key
from tamis.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

N_BITS = 64  # sign bits of the 64 floats


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


COMPOUNDS_SQL = """compounds AS (
  SELECT vec_id AS id, label AS cluster, CAST(label = 1 AS INTEGER) AS active,
         array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits
  FROM embeddings)"""

FOLDED_SQL = (
    COMPOUNDS_SQL
    + """, folded AS (
  SELECT *, CAST(ntile(10) OVER (PARTITION BY active ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS INTEGER) AS fold_id
  FROM compounds)"""
)

# Tanimoto of two bit strings a.bits and b.bits.
TANIMOTO_SQL = """bit_count(CAST(a.bits AS BIT) & CAST(b.bits AS BIT)) * 1e0
  / nullif(bit_count(CAST(a.bits AS BIT) | CAST(b.bits AS BIT)), 0)"""


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    bits = sign_bits("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("cluster"),
        (F.col("label") == 1).cast("int").alias("active"),
        bits.alias("bits"),
    ).withColumn("fp", pack_bits("bits", N_BITS))


READINGS_SQL = """readings AS (
  SELECT event_id, user_id AS molecule, value AS inhibition, event_type AS library, props,
         CAST(contains(event_type, 'r') AS INTEGER) AS is_retest
  FROM events)"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("molecule"),
        F.col("value").alias("inhibition"),
        F.col("event_type").alias("library"),
        "props",
        F.col("event_type").contains("r").cast("int").alias("is_retest"),
    )


RANKED_SQL = """ranked AS (
  SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label, l.toxic AS alert, d.lang
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("quality").alias("label"),
        F.col("toxic").alias("alert"),
        "lang",
    )


SCORES_SQL = """two_scores AS (
  SELECT l_orderkey AS id, round(sum(l_extendedprice), 2) AS score_a, round(sum(l_quantity), 2) AS score_b
  FROM lineitem GROUP BY l_orderkey)"""


def two_scores(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.round(F.sum("l_extendedprice"), 2).alias("score_a"),
            F.round(F.sum("l_quantity"), 2).alias("score_b"),
        )
    )


ORDERED_SQL = """order_like AS (
  SELECT l_orderkey, l_linenumber, l_quantity * 2e0 AS replicate1, l_extendedprice / 1000e0 AS replicate2,
         l_returnflag AS selection, CAST(l_linestatus = 'F' AS INTEGER) AS clean
  FROM lineitem)"""
TIER_SQL = """CASE WHEN clean = 1 AND replicate1 >= 72 AND replicate2 >= 72 THEN 'strong'
       WHEN clean = 1 AND replicate1 >= 50 AND replicate2 >= 50 THEN 'normal'
       WHEN clean = 1 AND replicate1 >= 35 AND replicate2 >= 35 THEN 'weak' ELSE 'none' END"""
HIT_SQL = "CAST(clean = 1 AND replicate1 >= 50 AND replicate2 >= 50 AS INTEGER)"


def order_like(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") * 2.0).alias("replicate1"),
        (F.col("l_extendedprice") / 1000.0).alias("replicate2"),
        F.col("l_returnflag").alias("selection"),
        (F.col("l_linestatus") == "F").cast("int").alias("clean"),
    )


CANONICAL_SQL = "trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))"
TEXTS_SQL = f"""texts AS (
  SELECT doc_id, lang, source, n_chars, {CANONICAL_SQL} AS canonical,
         doc_id IN (SELECT doc_id FROM labels) AS labelled
  FROM documents)"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the digest of their canonical text as the key to compare."""
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", "lang", "source", "n_chars", text_key(canonical("text")).alias("canonical"))
