"""Projections, filters, predicates and data checks."""

from pyspark.sql import functions as F

from queries.base import ORDERED_SQL, HIT_SQL, TIER_SQL, order_like, query, table
from tamis.functions import rows
from tamis.functions.text import standardize
from tamis.operators import checks, clean

# Fixed values.
CODES = {"click": "CK", "error": "ER", "purchase": "PU", "signup": "SU", "view": "VW"}
NAME_PARTS = ["ECONOMY", "E", "M", "SMALL", "AR"]
RANGES = {"p_size": (5, 40), "p_retailprice": (950.0, 1050.0)}


@query(
    "lower_bound_filter",
    """SELECT event_id, value FROM (SELECT event_id, value - 120e0 AS value, props FROM events)
       WHERE value > -100 AND value IS NOT NULL AND NOT isnan(value) AND props IS NOT NULL""",
)
def lower_bound_filter(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.col("value") - 120.0)
    return clean.clean_readings(df, "value", "props").select("event_id", "value")


DOCS_LABELS = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _docs_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")


@query("dropna_subset", f"SELECT * FROM ({DOCS_LABELS}) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def dropna_subset(spark, sf):
    return clean.drop_missing(_docs_labels(spark, sf), ["quality", "toxic"])


@query(
    "fill_missing",
    f"SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM ({DOCS_LABELS})",
)
def fill_missing(spark, sf):
    return clean.fill_missing(_docs_labels(spark, sf), 0)


@query(
    "control_and_dose_filter",
    """SELECT event_id, concentration FROM (
         SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS control,
                CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) AS concentration FROM events)
       WHERE control = '' AND CAST(concentration AS DOUBLE) = 33""",
)
def control_and_dose_filter(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("control"),
        F.floor("value").cast("int").cast("string").alias("concentration"),
    )
    return clean.at_dose(df, "control", "concentration").select("event_id", "concentration")


@query(
    "retest_flag",
    "SELECT event_id, CAST(contains(event_type, 'r') AS INTEGER) AS is_retest FROM events",
)
def retest_flag(spark, sf):
    return clean.flag_retest(table(spark, sf, "events"), "event_type", "r").select("event_id", "is_retest")


@query(
    "standardize_codes",
    "SELECT event_id, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())
    + " ELSE error('unknown code') END AS code FROM events",
)
def standardize_codes(spark, sf):
    return table(spark, sf, "events").select("event_id", standardize("event_type", CODES).alias("code"))


@query(
    "contains_counts",
    "WITH n AS (SELECT count(*) AS n_rows FROM part) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS code, count(*) FILTER (WHERE contains(p_type, '{c}')) AS n, (SELECT n_rows FROM n) AS n_rows FROM part"
        for c in NAME_PARTS
    ),
)
def contains_counts(spark, sf):
    return clean.contains_counts(table(spark, sf, "part"), "p_type", NAME_PARTS)


STATUS = "CASE WHEN p_brand = 'Brand#1' THEN 'alert' ELSE 'OK' END"
IN_RANGE = "p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 950 AND 1050"


def _parts(spark, sf):
    return table(spark, sf, "part").withColumn(
        "status", F.when(F.col("p_brand") == "Brand#1", "alert").otherwise("OK")
    )


@query("range_battery", f"SELECT p_partkey, p_size, p_retailprice FROM part WHERE {IN_RANGE} AND {STATUS} = 'OK'")
def range_battery(spark, sf):
    return clean.range_filter(_parts(spark, sf), RANGES, "status").select("p_partkey", "p_size", "p_retailprice")


@query(
    "range_fraction",
    f"""SELECT n_rows, n_passed, round(100e0 * n_passed / n_rows, 1) AS percent_passed FROM (
          SELECT count(*) AS n_rows, count(*) FILTER (WHERE {IN_RANGE} AND {STATUS} = 'OK') AS n_passed FROM part)""",
)
def range_fraction(spark, sf):
    return clean.pass_fraction(_parts(spark, sf), clean.in_ranges(RANGES) & (F.col("status") == "OK"))


@query(
    "filter_funnel",
    """WITH s AS (SELECT CASE WHEN NOT o_orderstatus <> 'P' THEN 1 WHEN NOT o_totalprice >= 50000 THEN 2
                            WHEN NOT o_orderpriority <> '5-LOW' THEN 3 ELSE 4 END AS fail FROM orders),
       n AS (SELECT v.stage, v.filter, (SELECT count(*) FROM s WHERE fail = v.stage) AS n_failed,
                    (SELECT count(*) FROM s WHERE fail > v.stage) AS n_left
             FROM (VALUES (1, 'settled'), (2, 'large'), (3, 'urgent')) v(stage, filter))
       SELECT * FROM n""",
)
def filter_funnel(spark, sf):
    stages = [
        ("settled", F.col("o_orderstatus") != "P"),
        ("large", F.col("o_totalprice") >= 50000),
        ("urgent", F.col("o_orderpriority") != "5-LOW"),
    ]
    return clean.funnel(table(spark, sf, "orders"), stages)


@query("select_rename", "SELECT p_retailprice AS score, p_partkey AS id, p_brand AS cluster FROM part")
def select_rename(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")
    )


@query(
    "binarize_text_label",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS label FROM orders",
)
def binarize_text_label(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", rows.yes_no("o_orderstatus", "F").alias("label"))


@query(
    "sentinel_missing",
    f"SELECT * FROM (SELECT doc_id, coalesce(quality, -1) AS label FROM ({DOCS_LABELS})) WHERE label <> -1",
)
def sentinel_missing(spark, sf):
    df = _docs_labels(spark, sf).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("label"))
    return clean.drop_sentinel(df, "label")


NULLABLE = "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b FROM lineitem"


def _nullable(spark, sf):
    zero = F.lit(0.0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_discount", zero).alias("a"),
        F.nullif("l_tax", zero).alias("b"),
    )


@query("sum_nullable", f"SELECT l_orderkey, l_linenumber, round(coalesce(a, 0) + coalesce(b, 0), 6) AS price FROM ({NULLABLE})")
def sum_nullable(spark, sf):
    return _nullable(spark, sf).select(
        "l_orderkey", "l_linenumber", F.round(rows.row_sum(["a", "b"]), 6).alias("price")
    )


@query(
    "replicate_mean",
    f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS mean
        FROM ({NULLABLE})""",
)
def replicate_mean(spark, sf):
    return _nullable(spark, sf).select(
        "l_orderkey", "l_linenumber", F.round(rows.row_mean(["a", "b"]), 6).alias("mean")
    )


@query("row_min_distance", f"SELECT l_orderkey, l_linenumber, least(a, b) AS distance FROM ({NULLABLE})")
def row_min_distance(spark, sf):
    return _nullable(spark, sf).select("l_orderkey", "l_linenumber", rows.row_min(["a", "b"]).alias("distance"))


@query("hit_flag", f"WITH {ORDERED_SQL} SELECT l_orderkey, l_linenumber, {HIT_SQL} AS hit FROM order_like")
def hit_flag(spark, sf):
    return order_like(spark, sf).select(
        "l_orderkey", "l_linenumber", rows.hit_flag("replicate1", "replicate2", "clean").alias("hit")
    )


@query("activity_tiers", f"WITH {ORDERED_SQL} SELECT l_orderkey, l_linenumber, {TIER_SQL} AS tier FROM order_like")
def activity_tiers(spark, sf):
    return order_like(spark, sf).select(
        "l_orderkey", "l_linenumber", rows.activity_tier("replicate1", "replicate2", "clean").alias("tier")
    )


@query(
    "inhibition_from_control",
    """SELECT user_id, round(100 - m, 6) AS inhibition, CAST(100 - m >= 50 AS INTEGER) AS hit
       FROM (SELECT user_id, median(value) AS m FROM events GROUP BY user_id)""",
)
def inhibition_from_control(spark, sf):
    medians = clean.grouped_median(table(spark, sf, "events").select("user_id", "value"), "value", ["user_id"])
    inhibition = rows.to_inhibition("median")
    return medians.select(
        "user_id", F.round(inhibition, 6).alias("inhibition"), (inhibition >= 50).cast("int").alias("hit")
    )


@query(
    "assert_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def assert_unique(spark, sf):
    return checks.violations_of_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "assert_shape",
    """WITH f AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS f FROM orders)
       SELECT count(*) AS rows_in_parts, CAST(sum(f) AS BIGINT) AS flags_in_parts,
              count(*) AS rows_in_table, CAST(sum(f) AS BIGINT) AS flags_in_table FROM f""",
)
def assert_shape(spark, sf):
    df = table(spark, sf, "orders").withColumn("f", (F.col("o_orderstatus") == "F").cast("int"))
    return checks.conservation(df, "o_orderpriority", "f")


@query(
    "assert_no_fanout",
    """SELECT (SELECT count(*) FROM lineitem) AS right_rows, count(*) AS joined_rows,
              CAST(count(*) <> (SELECT count(*) FROM lineitem) AS INTEGER) AS fans_out
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def assert_no_fanout(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    right = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return checks.fanout(left, right, ["key"])


@query(
    "quarantine_invalid",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN 'digit run'
                           WHEN contains(text, '@') THEN 'address' ELSE 'valid' END AS status FROM documents""",
)
def quarantine_invalid(spark, sf):
    error = F.when(F.col("text").rlike("[0-9]{4,}"), "digit run").when(F.col("text").contains("@"), "address")
    valid, rejected = checks.split_valid(table(spark, sf, "documents").select("doc_id", "text"), error)
    return valid.select("doc_id", F.lit("valid").alias("status")).union(rejected.select("doc_id", "error"))
