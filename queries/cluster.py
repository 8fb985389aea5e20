"""Clusters, diverse picks, statistics and dose response."""

from pyspark.sql import functions as F

from queries.aggregates import PART_TIERS_SQL, part_tiers
from queries.base import COMPOUNDS_SQL, N_BITS, TANIMOTO_SQL, compounds, query, table
from tamis.functions.bits import tanimoto
from tamis.operators import neighbors, stats
from tamis.operators.aggregates import cluster_tiers
from tamis.operators.checks import differences
from tamis.plans.screen import order_list


@query(
    "leader_clusters",
    f"""WITH RECURSIVE {COMPOUNDS_SQL}, d AS (SELECT bits, min(id) AS id, count(*) AS n FROM compounds GROUP BY bits),
          near AS (SELECT a.id, list(b.id) AS ids, sum(b.n) AS n FROM d a JOIN d b ON a.id <> b.id
                   AND 1 - {TANIMOTO_SQL} <= 0.45 + 1e-9 GROUP BY a.id),
          o AS (SELECT d.id, d.bits, coalesce(near.ids, []) AS ids,
                  row_number() OVER (ORDER BY coalesce(near.n, 0) + d.n - 1 DESC, d.id) AS i FROM d LEFT JOIN near ON d.id = near.id),
          st(i, heads) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
            SELECT o.i, CASE WHEN len(list_intersect(o.ids, st.heads)) = 0 THEN list_append(st.heads, o.id) ELSE st.heads END
            FROM st JOIN o ON o.i = st.i + 1),
          heads AS (SELECT unnest(heads) AS leader_id, unnest(range(len(heads))) AS cluster_id FROM (
            SELECT heads FROM st ORDER BY i DESC LIMIT 1))
        SELECT c.id, arg_min(leader_id, cluster_id) AS leader_id, min(cluster_id) AS cluster_id
        FROM compounds c JOIN o ON c.bits = o.bits JOIN heads ON list_contains(o.ids, leader_id) OR o.id = leader_id GROUP BY c.id""",
)
def leader_clusters(spark, sf):
    df = compounds(spark, sf).select("id", "fp")
    return neighbors.leader_clusters(df, "fp", "id", N_BITS, 0.45)


def scored(spark, sf):
    """Compounds scored by the sum of their floats, rounded, so ties occur."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    scores = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(total, 2).alias("score"))
    return compounds(spark, sf).join(scores, "id")


SCORED_SQL = (
    COMPOUNDS_SQL
    + """, scored AS (SELECT c.*, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 2) AS score
      FROM compounds c JOIN embeddings e ON c.id = e.vec_id)"""
)
PICKS = 8


def _picks_sql(n: int) -> str:
    """Greedy picks among the rows of ``cand``."""
    return f"""d AS MATERIALIZED (SELECT a.id, a.score, b.id AS other, 1 - {TANIMOTO_SQL} AS dist FROM cand a, cand b),
        pick(i, chosen) AS (
          SELECT 1, [(SELECT id FROM cand ORDER BY score DESC, id LIMIT 1)]
          UNION ALL
          SELECT i + 1, list_append(any_value(chosen), arg_max(id, (mean, score, -id))) FROM (
            SELECT p.i, any_value(p.chosen) AS chosen, d.id, d.score, round(avg(d.dist), 12) AS mean
            FROM pick p JOIN d ON list_contains(p.chosen, d.other) AND NOT list_contains(p.chosen, d.id)
            WHERE p.i < {n} GROUP BY p.i, d.id, d.score) GROUP BY i),
        picks AS (SELECT id, CAST(place - 1 AS INTEGER) AS pick_order FROM (
          SELECT unnest(chosen) AS id, unnest(range(1, {n + 1})) AS place FROM pick WHERE i = {n}))"""


@query(
    "diverse_pick",
    f"WITH RECURSIVE {SCORED_SQL}, cand AS (SELECT * FROM scored), {_picks_sql(PICKS)} SELECT id, pick_order FROM picks",
)
def diverse_pick(spark, sf):
    picks = neighbors.pick_diverse(scored(spark, sf), "fp", "id", "score", N_BITS, PICKS)
    return picks.select("id", "pick_order")


@query(
    "final_order_list",
    f"""WITH RECURSIVE {SCORED_SQL}, cand AS (SELECT * FROM (
          SELECT id, bits, score, substr(bits, 1, 5) AS cluster,
                 row_number() OVER (PARTITION BY substr(bits, 1, 5) ORDER BY score DESC, id) AS place
          FROM scored WHERE active = 0 AND score > -1) WHERE place = 1), {_picks_sql(6)}
        SELECT id, score, cluster, pick_order FROM picks JOIN cand USING (id)""",
)
def final_order_list(spark, sf):
    df = scored(spark, sf).withColumn("cluster", F.substring("bits", 1, 5))
    stages = [("inactive", F.col("active") == 0), ("scored", F.col("score") > -1)]
    out = order_list(df, stages, "cluster", "score", "id", "fp", N_BITS, 6)
    return out.select("id", "score", "cluster", "pick_order")


@query(
    "chi2_independence",
    """WITH o AS (SELECT lang, quality, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL),
         m AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS r, sum(n) OVER (PARTITION BY quality) AS c, sum(n) OVER () AS t FROM o)
       SELECT round(sum(n * n * 1e0 * t / (r * c)) - max(t), 6) AS statistic,
              CAST((count(DISTINCT lang) - 1) * (count(DISTINCT quality) - 1) AS INTEGER) AS dof FROM m""",
)
def chi2_independence(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    out = stats.chi2_table(df, "lang", "quality")
    return out.select(F.round("statistic", 6).alias("statistic"), "dof")


@query(
    "chi2_uniform",
    f"WITH {PART_TIERS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS "column", round(sum({t} * {t}) * 1e0 * count(*) / sum({t}) - sum({t}), 6) AS statistic,
             CAST(count(*) - 1 AS INTEGER) AS dof FROM tiers"""
        for t in ("strong", "normal", "weak")
    ),
)
def chi2_uniform(spark, sf):
    counts = cluster_tiers(part_tiers(spark, sf), "cluster", "tier")
    out = stats.chi2_uniform(counts, ["strong", "normal", "weak"])
    return out.select("column", F.round("statistic", 6).alias("statistic"), "dof")


@query(
    "permutation_independence",
    """WITH o AS (SELECT lang, quality, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL),
         t AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS k, count(*) FILTER (WHERE quality = 1) AS q,
                 count(*) FILTER (WHERE toxic = 1) AS x, count(*) AS n FROM labels),
         f AS (SELECT k, q, x, n, unnest(range(greatest(0, q + x - n), least(q, x) + 1)) AS i FROM t),
         p AS (SELECT i = k AS seen, -(lgamma(i + 1) + lgamma(q - i + 1) + lgamma(x - i + 1) + lgamma(n - q - x + i + 1)) AS s,
                 lgamma(q + 1) + lgamma(n - q + 1) + lgamma(x + 1) + lgamma(n - x + 1) - lgamma(n + 1) AS c FROM f),
         e AS (SELECT sum(exp(s + c)) AS p FROM p WHERE s <= (SELECT s FROM p WHERE seen) + 1e-7 * abs((SELECT s FROM p WHERE seen)))
       SELECT 'lang, quality' AS pair, round(-sum(lgamma(n + 1)), 6) AS statistic, CAST(500 AS BIGINT) AS replicates, true AS p_in_range,
              CAST(NULL AS BOOLEAN) AS dependent FROM o
       UNION ALL SELECT 'quality, toxic', (SELECT round(s, 6) FROM p WHERE seen), 500, true, p <= 0.05 FROM e""",
)
def permutation_independence(spark, sf):
    """Language against quality, and two flags, where SQL knows the exact p-value and so the answer at 5 %."""
    labels = table(spark, sf, "labels")
    df = table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id")
    langs = stats.perm_test(df, "lang", "quality", replicates=500).select(F.lit("lang, quality").alias("pair"), "*", F.lit(None).cast("boolean").alias("dependent"))
    flags = stats.perm_test(labels, "quality", "toxic", replicates=500).select(F.lit("quality, toxic").alias("pair"), "*", (F.col("p_value") <= 0.05).alias("dependent"))
    in_range = (F.col("p_value") >= 1 / 501) & (F.col("p_value") <= 1)
    return langs.union(flags).select("pair", F.round("statistic", 6).alias("statistic"), "replicates", in_range.alias("p_in_range"), "dependent")


# Doses by event type and the grid of the curve.
DOSES = {"click": 66.0, "error": 33.0, "purchase": 16.5, "signup": 8.25, "view": 4.125}
MIDPOINTS = [0.5 * 2**i for i in range(12)]
SLOPES = [0.25 * i for i in range(1, 13)]


@query(
    "dose_response_fit",
    f"""WITH d AS (SELECT user_id, CASE event_type {' '.join(f"WHEN '{t}' THEN {v}e0" for t, v in DOSES.items())} END AS d, value AS y FROM events),
          p AS (SELECT user_id, d, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM d GROUP BY ALL),
          g AS (SELECT * FROM (VALUES {', '.join(f'({m}e0)' for m in MIDPOINTS)}) a(m), (VALUES {', '.join(f'({h}e0)' for h in SLOPES)}) b(h)),
          e AS (SELECT user_id, m, h, sum(n) AS n, round(sum(q - 2 * f * s + n * f * f), 6) AS sse FROM (
                  SELECT p.*, m, h, 180e0 / (1 + pow(d / m, h)) AS f FROM p, g) GROUP BY user_id, m, h)
        SELECT user_id, arg_min(m, (sse, m, h)) AS midpoint, arg_min(h, (sse, m, h)) AS slope, round(min(sse), 3) AS sse,
               CAST(max(n) AS BIGINT) AS n FROM e GROUP BY user_id""",
)
def dose_response_fit(spark, sf):
    dose = F.expr("CASE event_type " + " ".join(f"WHEN '{t}' THEN {v}D" for t, v in DOSES.items()) + " END")
    df = table(spark, sf, "events").select("user_id", dose.alias("dose"), "value")
    out = stats.fit_hill(df, "user_id", "dose", "value", MIDPOINTS, SLOPES)
    return out.withColumn("sse", F.round("sse", 3))


CHECKED = 0.4  # similarity from which every pair is found a second way


@query(
    "fast_vs_exact_check",
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differences FROM embeddings WHERE label <> 1",
)
def fast_vs_exact_check(spark, sf):
    """The blocked search against native word arithmetic: every similarity it names, and
    every pair of ``CHECKED`` or more that a similarity join finds."""
    df = compounds(spark, sf).select("id", "fp", "active")
    refs = df.filter("active = 1").select(F.col("id").alias("ref_id"), F.col("fp").alias("ref_fp"))
    rows = df.filter("active = 0").select("id", "fp")
    fast = neighbors.nearest(rows, refs, "fp", "id", N_BITS)
    named = fast.join(refs, fast["nearest_id"] == refs["ref_id"], "left")
    native = F.coalesce(F.round(tanimoto("fp", "ref_fp", N_BITS // 64), 9), F.lit(-1.0))
    wrong = named.filter(native != F.coalesce(F.round("nearest_similarity", 9), F.lit(-1.0))).select("id")
    best = neighbors.best_above(rows, refs, "fp", "id", N_BITS, CHECKED)
    high = fast.filter(F.round("nearest_similarity", 9) >= CHECKED).select("id", "nearest_id")
    missed = differences(high, best, ["id"], ["nearest_id"]).select("id")
    bad = wrong.union(missed)
    return rows.agg(F.count("*").alias("n_rows")).select(
        "n_rows", bad.agg(F.count("*").alias("n")).scalar().alias("n_differences")
    )
