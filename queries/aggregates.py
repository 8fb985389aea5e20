"""Aggregations."""

from pyspark.sql import functions as F

from queries.base import (
    FOLDED_SQL, HIT_SQL, ORDERED_SQL, READINGS_SQL, TIER_SQL,
    compounds, order_like, query, readings, table,
)
from queries.joins import CLUSTERED_SQL, clustered
from tamis.functions.rows import activity_tier, hit_flag, round_percent
from tamis.operators import aggregates as agg
from tamis.operators import clean
from tamis.operators.order import exact_quantiles
from tamis.operators.splits import stratified_folds


@query(
    "primary_median",
    f"""WITH {READINGS_SQL} SELECT molecule, arg_min(props, event_id) AS props,
          string_agg(DISTINCT library, ', ' ORDER BY library) AS library_ids, round(median(inhibition), 6) AS primary_median
        FROM readings WHERE is_retest = 0 GROUP BY molecule""",
)
def primary_median(spark, sf):
    primary = readings(spark, sf).filter("is_retest = 0")
    out = clean.collapse_primary(
        primary, "molecule", "event_id", "inhibition", {"library_ids": "library"}, ["props"]
    )
    return out.withColumn("primary_median", F.round("primary_median", 6))


ALERT_LEVEL = 300.0
LABELS_SQL = f"""labels_ AS (
  SELECT molecule, median(inhibition) FILTER (WHERE is_retest = 0) AS p, median(inhibition) FILTER (WHERE is_retest = 1) AS r,
         CAST(max(inhibition) > {ALERT_LEVEL} AS INTEGER) AS alert FROM readings GROUP BY molecule)"""


@query(
    "activity_label",
    f"""WITH {READINGS_SQL}, {LABELS_SQL}
        SELECT e.event_id, e.molecule, CAST(coalesce(p >= 35, false) AS INTEGER) AS primary_filter,
               CAST(coalesce(r >= 35, false) AS INTEGER) AS retest_filter, 1 - alert AS alert_filter,
               CAST(coalesce(p >= 35, false) AND coalesce(r >= 35, false) AND alert = 0 AS INTEGER) AS activity
        FROM readings e JOIN labels_ l ON e.molecule = l.molecule""",
)
def activity_label(spark, sf):
    alert = (F.col("inhibition") > ALERT_LEVEL).cast("int")
    out = clean.label_activity(readings(spark, sf), "molecule", "inhibition", "is_retest", alert)
    return out.select("event_id", "molecule", "primary_filter", "retest_filter", "alert_filter", "activity")


@query(
    "median_at_dose",
    """SELECT event_id, round(median(value) OVER (PARTITION BY user_id, event_type), 6) AS median FROM events""",
)
def median_at_dose(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    out = clean.median_over(df, "value", ["user_id", "event_type"])
    return out.select("event_id", F.round("median", 6).alias("median"))


@query(
    "count_by_label_triple",
    """SELECT lang, quality, toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""",
)
def count_by_label_triple(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return agg.count_groups(df, ["lang", "quality", "toxic"])


@query(
    "fold_counts",
    f"""WITH {FOLDED_SQL} SELECT fold_id, count(*) AS total, count(*) FILTER (WHERE active = 1) AS active,
          count(*) FILTER (WHERE active = 0) AS inactive FROM folded GROUP BY ROLLUP (fold_id)""",
)
def fold_counts(spark, sf):
    df = stratified_folds(compounds(spark, sf).select("id", "active"), "id", "active")
    return agg.fold_counts(df, "fold_id", "active")


def tiered(spark, sf):
    replicates = ("replicate1", "replicate2", "clean")
    return order_like(spark, sf).select(
        "*", hit_flag(*replicates).alias("hit"), activity_tier(*replicates).alias("tier")
    )


SETS = {  # fixed values: selections and the flags that belong to them
    "A + B": "true",
    "A": "selection IN ('R', 'N')",
    "B": "selection IN ('A', 'N')",
    "A AND B": "selection = 'N'",
    "A - B": "selection = 'R'",
    "B - A": "selection = 'A'",
}


@query(
    "overlapping_groups",
    f"WITH {ORDERED_SQL}, t AS (SELECT *, {HIT_SQL} AS hit, {TIER_SQL} AS tier FROM order_like) "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS selection, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits,
             count(*) FILTER (WHERE tier = 'strong') AS strong, count(*) FILTER (WHERE tier = 'normal') AS normal,
             count(*) FILTER (WHERE tier = 'weak') AS weak, CAST(count(*) - sum(hit) AS BIGINT) AS misses,
             round(100e0 * sum(hit) / count(*), 6) AS hit_rate FROM t WHERE {cond}"""
        for name, cond in SETS.items()
    ),
)
def overlapping_groups(spark, sf):
    sets = {name: F.expr(cond) for name, cond in SETS.items()}
    return agg.summarize_sets(tiered(spark, sf), sets, "hit", "tier")


PART_TIERS_SQL = f"""parts AS (
  SELECT p_brand AS cluster, p_size * 2e0 AS replicate1, p_retailprice / 16e0 AS replicate2,
         CAST(p_type <> 'PROMO' AS INTEGER) AS clean FROM part),
  tiers AS (SELECT cluster, count(*) FILTER (WHERE tier = 'strong') AS strong, count(*) FILTER (WHERE tier = 'normal') AS normal,
         count(*) FILTER (WHERE tier = 'weak') AS weak, count(*) FILTER (WHERE tier <> 'none') AS total
       FROM (SELECT cluster, {TIER_SQL} AS tier FROM parts) GROUP BY cluster HAVING count(*) FILTER (WHERE tier <> 'none') > 0)"""


def part_tiers(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_brand").alias("cluster"),
        (F.col("p_size") * 2.0).alias("replicate1"),
        (F.col("p_retailprice") / 16.0).alias("replicate2"),
        (F.col("p_type") != "PROMO").cast("int").alias("clean"),
    )
    return df.select("cluster", activity_tier("replicate1", "replicate2", "clean").alias("tier"))


@query(
    "cluster_tier_pivot",
    f"""WITH {PART_TIERS_SQL} SELECT * FROM tiers UNION ALL
        SELECT 'Total', CAST(sum(strong) AS BIGINT), CAST(sum(normal) AS BIGINT), CAST(sum(weak) AS BIGINT),
               CAST(sum(total) AS BIGINT) FROM tiers""",
)
def cluster_tier_pivot(spark, sf):
    return agg.tiers_by_cluster(part_tiers(spark, sf), "cluster", "tier")


@query(
    "active_cluster_fractions",
    f"""WITH {PART_TIERS_SQL} SELECT count(*) AS active_clusters,
          round(count(*) FILTER (WHERE strong > 0) * 1e0 / count(*), 6) AS with_strong,
          round(count(*) FILTER (WHERE normal > 0) * 1e0 / count(*), 6) AS with_normal,
          round(count(*) FILTER (WHERE weak > 0) * 1e0 / count(*), 6) AS with_weak,
          round(count(*) FILTER (WHERE strong > 0 OR normal > 0) * 1e0 / count(*), 6) AS with_strong_or_normal FROM tiers""",
)
def active_cluster_fractions(spark, sf):
    return agg.cluster_fractions(part_tiers(spark, sf), "cluster", "tier")


@query(
    "hit_rate",
    """SELECT toxic, CAST(sum(quality) AS BIGINT) AS hits, count(*) AS n,
         round(100e0 * sum(quality) / count(*), 2) AS hit_rate FROM labels GROUP BY toxic""",
)
def hit_rate(spark, sf):
    return agg.hit_rate(table(spark, sf, "labels"), "quality", ["toxic"])


@query(
    "round_percent",
    """SELECT event_type, round(100e0 * count(*) FILTER (WHERE value > 50) / count(*), 2) AS percent
       FROM events GROUP BY event_type""",
)
def percent_over(spark, sf):
    share = round_percent(F.count_if(F.col("value") > 50), F.count("*"))
    return table(spark, sf, "events").groupBy("event_type").agg(share.alias("percent"))


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "describe_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
             min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
             round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"""
        for c in DESCRIBED
    ),
)
def describe_columns(spark, sf):
    return agg.describe(table(spark, sf, "lineitem"), DESCRIBED)


@query(
    "quantile_marks",
    """SELECT round(quantile_cont(value, 0.4), 6) AS q40, round(quantile_cont(value, 0.5), 6) AS q50,
         round(quantile_cont(value, 0.9), 6) AS q90 FROM events""",
)
def quantile_marks(spark, sf):
    marks = exact_quantiles(table(spark, sf, "events").select("value"), "value", {"q40": 0.4, "q50": 0.5, "q90": 0.9})
    return marks.select(*[F.round(c, 6).alias(c) for c in marks.columns])


@query(
    "score_histogram",
    """WITH s AS (SELECT value / 250e0 AS s FROM events), b AS (SELECT range AS bin FROM range(100))
       SELECT bin, bin / 100e0 AS low, (bin + 1) / 100e0 AS high, count(s) AS n
       FROM b LEFT JOIN s ON s >= bin / 100e0 AND s < (bin + 1) / 100e0 GROUP BY bin""",
)
def score_histogram(spark, sf):
    df = table(spark, sf, "events").select((F.col("value") / 250.0).alias("score"))
    return agg.score_histogram(df, "score", 100)


@query(
    "price_summary",
    """SELECT p_type, count(*) AS n, round(avg(p_retailprice), 6) AS price_mean, round(sum(p_retailprice), 2) AS price_sum,
         min(p_retailprice) AS price_min, max(p_retailprice) AS price_max, CAST(sum(p_size) AS BIGINT) AS amount_sum,
         count(DISTINCT p_size) AS distinct_amounts FROM part GROUP BY p_type""",
)
def price_summary(spark, sf):
    return agg.price_summary(table(spark, sf, "part"), "p_retailprice", "p_size", ["p_type"])


# Events as metric records: model, setting, run 0-5 and a value; over 200 means no log.
METRICS_SQL = """metrics AS (
  SELECT event_type AS model, user_id AS setting, CAST(floor(minute(ts) / 10e0) AS INTEGER) AS run,
         max(CASE WHEN value > 200 THEN -1e0 ELSE value END) AS nef,
         max(CASE WHEN value > 200 THEN -1e0 ELSE value / 2e0 END) AS roc
  FROM events GROUP BY ALL)"""


def metric_records(spark, sf):
    value = F.when(F.col("value") > 200, -1.0)
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("event_type").alias("model"),
            F.col("user_id").alias("setting"),
            F.floor(F.minute("ts") / 10.0).cast("int").alias("run"),
        )
        .agg(
            F.max(value.otherwise(F.col("value"))).alias("nef"),
            F.max(value.otherwise(F.col("value") / 2.0)).alias("roc"),
        )
    )


@query(
    "mean_over_folds",
    f"""WITH {METRICS_SQL} SELECT model, setting, round(avg(nullif(nef, -1)), 6) AS mean_nef, round(avg(nullif(roc, -1)), 6) AS mean_roc
        FROM metrics WHERE run <= 3 GROUP BY model, setting""",
)
def mean_over_folds(spark, sf):
    out = agg.mean_cv(metric_records(spark, sf), ["model", "setting"], ["nef", "roc"], "run")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_nef", "mean_roc")})


@query(
    "model_selection_table",
    f"""WITH {METRICS_SQL}, f AS (SELECT model, min(setting) AS setting FROM metrics GROUP BY model
                                  UNION SELECT model, max(setting) + 1 FROM metrics GROUP BY model)
        SELECT f.model, f.setting, round(coalesce(m.roc, -1), 3) AS roc, round(coalesce(m.nef, -1), 3) AS nef
        FROM f LEFT JOIN metrics m ON f.model = m.model AND f.setting = m.setting AND m.run = 4""",
)
def model_selection_table(spark, sf):
    metrics = metric_records(spark, sf)
    ends = metrics.groupBy("model").agg(F.min("setting").alias("lo"), (F.max("setting") + 1).alias("hi"))
    finalists = ends.select("model", F.explode(F.array("lo", "hi")).alias("setting"))
    return agg.selection_table(metrics, finalists, ["model", "setting"], ["roc", "nef"], "run")


@query(
    "distinct_values_per_file",
    """SELECT user_id AS file, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes,
         count(DISTINCT event_type) AS n_codes FROM events GROUP BY user_id""",
)
def distinct_values_per_file(spark, sf):
    df = table(spark, sf, "events").select(F.col("user_id").alias("file"), "event_type")
    return agg.distinct_codes(df, "event_type", "file")


TIMES_SQL = "times AS (SELECT event_type AS part, max(value) AS minutes, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type)"


@query(
    "append_mean_std",
    f"""WITH {TIMES_SQL} SELECT part, round(minutes, 2) AS minutes, round(n, 2) AS n FROM times
        UNION ALL SELECT 'mean', round(avg(minutes), 2), round(avg(n), 2) FROM times
        UNION ALL SELECT 'std', round(stddev_samp(minutes), 2), round(stddev_samp(n), 2) FROM times""",
)
def append_mean_std(spark, sf):
    times = table(spark, sf, "events").groupBy(F.col("event_type").alias("part")).agg(
        F.max("value").alias("minutes"), F.count("*").alias("n")
    )
    return agg.with_mean_std(times, "part", ["minutes", "n"])


@query(
    "count_over_threshold",
    """SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE value > 100) AS n_over FROM events GROUP BY event_type""",
)
def count_over_threshold(spark, sf):
    return agg.over_threshold(table(spark, sf, "events"), "event_type", "value", 100.0)


FOLD_CLUSTERS_SQL = "c AS (SELECT event_type AS fold, CAST(floor(value * 100) AS BIGINT) AS cluster FROM events)"


def _fold_clusters(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("fold"), F.floor(F.col("value") * 100).alias("cluster")
    )


@query(
    "fold_unique_clusters",
    f"""WITH {FOLD_CLUSTERS_SQL}, p AS (SELECT fold, cluster, count(*) AS n FROM c GROUP BY ALL),
          s AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS folds FROM p)
        SELECT fold, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_clusters,
               count(*) FILTER (WHERE folds = 1) AS n_unique_clusters FROM s GROUP BY fold
        UNION ALL SELECT 'all', count(*), count(DISTINCT cluster), 0 FROM c""",
)
def fold_unique_clusters(spark, sf):
    return agg.fold_cluster_overlap(_fold_clusters(spark, sf), "fold", "cluster")


@query(
    "active_clusters",
    f"WITH {CLUSTERED_SQL} SELECT cluster, CAST(sum(hit) AS BIGINT) AS hits FROM clustered GROUP BY cluster HAVING sum(hit) > 0",
)
def active_clusters(spark, sf):
    return agg.active_clusters(clustered(spark, sf), "cluster", "hit")


@query("class_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def class_counts(spark, sf):
    return clean.class_counts(table(spark, sf, "labels"), "quality")


@query(
    "union_distinct_across",
    f"""WITH {FOLD_CLUSTERS_SQL} SELECT cluster, min(fold) AS fold FROM c GROUP BY cluster HAVING count(DISTINCT fold) = 1""",
)
def union_distinct_across(spark, sf):
    return agg.clusters_of_one_fold(_fold_clusters(spark, sf), "fold", "cluster")
