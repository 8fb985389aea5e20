"""Ranks, top-k and set comparisons."""

from pyspark.sql import functions as F

from queries.aggregates import METRICS_SQL, metric_records
from queries.base import RANKED_SQL, SCORES_SQL, query, ranked, table, two_scores
from tamis.operators import clean, ranking
from tamis.operators.joins import join_scores, max_vote
from tamis.sources.readers import concat_tables


def _catalog(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"), F.col("p_retailprice").alias("score")
    )


CATALOG_SQL = "catalog_ AS (SELECT p_partkey AS id, p_brand AS cluster, p_retailprice AS score FROM part)"


@query("rank_first", f"WITH {CATALOG_SQL} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM catalog_")
def rank_first(spark, sf):
    return ranking.rank_by(_catalog(spark, sf), "score", "id").select("id", "rank")


@query(
    "best_per_cluster",
    f"""WITH {CATALOG_SQL} SELECT cluster, id, score FROM catalog_
        QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id) = 1""",
)
def best_per_cluster(spark, sf):
    return ranking.best_per(_catalog(spark, sf), "cluster", "score", "id")


@query(
    "best_per_model_class",
    f"""WITH {METRICS_SQL}, m AS (SELECT model, setting, max(nef) AS nef FROM metrics GROUP BY ALL)
        SELECT model, setting, nef FROM m QUALIFY row_number() OVER (PARTITION BY model ORDER BY nef DESC, setting) = 1""",
)
def best_per_model_class(spark, sf):
    best = metric_records(spark, sf).groupBy("model", "setting").agg(F.max("nef").alias("nef"))
    return ranking.best_per(best, "model", "nef", "setting")


@query(
    "number_duplicates",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS duplicate_id FROM events",
)
def number_duplicates(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id")
    return ranking.number_rows(df, ["user_id"], ["event_id"], "duplicate_id")


@query(
    "number_replicates",
    """SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS replicate
       FROM events""",
)
def number_replicates(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ranking.number_rows(df, ["event_type", "user_id"], ["event_id"], "replicate", start=1)


@query("dense_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS index_id FROM orders")
def dense_index(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ranking.index_rows(df, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "expand_by_count",
    """SELECT l_returnflag, CAST(i AS INTEGER) AS repeat, count(*) AS n FROM (SELECT l_returnflag, l_linenumber FROM lineitem)
       JOIN range(1, 100) t(i) ON i <= l_linenumber GROUP BY ALL""",
)
def expand_by_count(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber")
    return ranking.expand(df, "l_linenumber").groupBy("l_returnflag", "repeat").agg(F.count("*").alias("n"))


@query(
    "class_weight_column",
    """SELECT doc_id, round(CASE WHEN quality = 0 THEN 1e0
         ELSE (SELECT count(*) FILTER (WHERE quality = 0) * 1e0 / count(*) FILTER (WHERE quality = 1) FROM labels) END, 9)
         AS class_weight FROM labels""",
)
def class_weight_column(spark, sf):
    out = clean.class_weights(table(spark, sf, "labels"), "quality")
    return out.select("doc_id", F.round("class_weight", 9).alias("class_weight"))


@query(
    "sample_weight_column",
    """SELECT l_orderkey, l_linenumber, round(count(*) OVER () * 1e0
         / count(*) OVER (PARTITION BY trunc(l_extendedprice / 1000)), 6) AS sample_weight FROM lineitem""",
)
def sample_weight_column(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("label")
    )
    out = clean.sample_weights(df, "label")
    return out.select("l_orderkey", "l_linenumber", F.round("sample_weight", 6).alias("sample_weight"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.top_k(df, "o_totalprice", "o_orderkey", 100)


@query(
    "top_k_with_payload",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""",
)
def top_k_with_payload(spark, sf):
    orders = table(spark, sf, "orders")
    payload = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    scores = orders.select("o_orderkey", "o_totalprice")
    return ranking.top_k_with_payload(scores, payload, "o_totalprice", "o_orderkey", 500)


@query(
    "top_fraction",
    """SELECT doc_id, n_chars, rank FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank,
         count(*) OVER () AS n FROM documents) WHERE rank <= floor(n * 0.1e0)""",
)
def top_fraction(spark, sf):
    return ranking.top_fraction(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 0.1)


@query(
    "top_hyperparams",
    f"""WITH {METRICS_SQL}, m AS (SELECT model, setting, round(avg(nullif(nef, -1)), 6) AS ef FROM metrics WHERE run <= 3 GROUP BY ALL)
        SELECT model, setting, ef, CAST(row_number() OVER (PARTITION BY model ORDER BY ef DESC NULLS LAST, setting) AS INTEGER) AS rank
        FROM m QUALIFY rank <= 21""",
)
def top_hyperparams(spark, sf):
    used = metric_records(spark, sf).filter("run <= 3")
    mean = used.groupBy("model", "setting").agg(F.round(F.avg(F.nullif("nef", F.lit(-1.0))), 6).alias("ef"))
    return ranking.top_models(mean, "model", "setting", "ef", 21)


@query(
    "take_n_per_model",
    """SELECT r_name AS model, CAST(place - 1 AS INTEGER) AS place, n_nationkey AS item FROM (
         SELECT r_name, r_regionkey, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS place
         FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE place <= r_regionkey + 1""",
)
def take_n_per_model(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    region = table(spark, sf, "region")
    recipes = (
        nation.join(region, "r_regionkey")
        .groupBy(F.col("r_name").alias("model"))
        .agg(F.sort_array(F.collect_list("n_nationkey")).alias("items"))  # an ordered list per model
    )
    n = region.select(F.col("r_name").alias("model"), (F.col("r_regionkey") + 1).alias("n"))
    return ranking.take_n(recipes, "model", n, "items", "n")


KS = [10, 50, 100, 500, 1000]
KS_SQL = ", ".join(f"({k})" for k in KS)


@query(
    "overlap_at_k",
    f"""WITH {SCORES_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY score_a DESC, id) AS ra,
          row_number() OVER (ORDER BY score_b DESC, id) AS rb FROM two_scores)
        SELECT CAST(k AS BIGINT) AS k, count(id) AS n_shared, round(100e0 * count(id) / k, 2) AS percent
        FROM (VALUES {KS_SQL}) t(k) LEFT JOIN r ON greatest(ra, rb) <= k GROUP BY k""",
)
def overlap_at_k(spark, sf):
    return ranking.overlap_at_k(two_scores(spark, sf), "score_a", "score_b", "id", "id", KS)


@query(
    "hits_in_top_k",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
          h AS (SELECT rank FROM r WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
        SELECT CAST(k AS BIGINT) AS k, count(rank) AS n_shared, round(100e0 * count(rank) / k, 2) AS percent
        FROM (VALUES {KS_SQL}) t(k) LEFT JOIN h ON rank <= k GROUP BY k""",
)
def hits_in_top_k(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    hits = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return ranking.hits_in_top_k(docs, hits, "n_chars", "doc_id", "doc_id", KS)


MODELS = {"a": "score", "b": "score % 1000", "c": "2000 - abs(score - 2000)"}


@query(
    "coverage_gain",
    f"""WITH {RANKED_SQL}, s AS (SELECT id, label, {', '.join(f'{e} AS {m}' for m, e in MODELS.items())} FROM ranked),
          v AS (SELECT *, greatest(a, b, c) AS v FROM s),
          r AS (SELECT id, label, {', '.join(f'row_number() OVER (ORDER BY {m} DESC, id) <= 50 AS in_{m}' for m in 'abcv')} FROM v),
          f AS (SELECT * FROM r WHERE label = 1) """
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS model, count(*) FILTER (WHERE in_{m}) AS actives,
             count(*) FILTER (WHERE (in_a OR in_b OR in_c) AND NOT in_{m}) AS union_minus_model,
             count(*) FILTER (WHERE in_v AND NOT in_{m}) AS vote_minus_model,
             count(*) FILTER (WHERE in_{m} AND NOT in_v) AS model_minus_vote FROM f"""
        for m in MODELS
    ),
)
def coverage_gain(spark, sf):
    df = ranked(spark, sf).select("id", "label", *[F.expr(e).alias(m) for m, e in MODELS.items()])
    return ranking.coverage(df, list(MODELS), "label", "id", 50)


@query(
    "concat_tables",
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def concat(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return concat_tables(customers, suppliers)


@query(
    "distinct_on",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def distinct_on(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.distinct_on(df, "o_custkey", "o_orderkey")


@query(
    "random_sample",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey LIMIT 200",
)
def random_sample(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.sample_n(df, "o_orderkey", 200, seed=7)


@query(
    "score_pair_table",
    f"WITH {SCORES_SQL} SELECT id, score_a, score_b FROM two_scores",
)
def score_pair_table(spark, sf):
    scores = two_scores(spark, sf)
    joined = join_scores(scores.select("id", "score_a"), scores.select("id", "score_b"), "id")
    return joined.orderBy(F.col("score_b").desc(), "id")


@query(
    "max_vote",
    f"WITH {SCORES_SQL} SELECT id, greatest(score_a / 1000, score_b) AS score FROM two_scores",
)
def vote(spark, sf):
    scores = two_scores(spark, sf).withColumn("score_a", F.col("score_a") / 1000)
    return scores.select("id", max_vote(["score_a", "score_b"]).alias("score"))
