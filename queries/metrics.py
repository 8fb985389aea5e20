"""Ranking metrics and splits."""

from pyspark.sql import functions as F

from queries.base import COMPOUNDS_SQL, FOLDED_SQL, RANKED_SQL, compounds, query, ranked, table
from tamis.operators import metrics, splits

AUC_SQL = """(sum(pos * below + 0.5e0 * pos * (n - pos)) / nullif(max(np) * max(nn), 0))"""
# Per group g: rows and actives of each score, the same from the top, and totals.
CURVE_SQL = """cells AS (SELECT {g} AS g, score, count(*) AS n, CAST(sum(label) AS DOUBLE) AS pos FROM ranked GROUP BY ALL),
  curve AS (SELECT *, sum(n) OVER w AS upto, sum(pos) OVER w AS pos_upto, sum(pos) OVER (PARTITION BY g) AS np,
              sum(n - pos) OVER (PARTITION BY g) AS nn,
              sum(n - pos) OVER (PARTITION BY g) - sum(n - pos) OVER w AS below
            FROM cells WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
AP_SQL = "(sum(pos * pos_upto / upto) / nullif(max(np), 0))"


@query("roc_auc", f"WITH {RANKED_SQL}, {CURVE_SQL.format(g=0)} SELECT round({AUC_SQL}, 9) AS roc_auc FROM curve")
def roc_auc(spark, sf):
    return metrics.roc_auc(ranked(spark, sf), "score", "label").select(F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "average_precision",
    f"WITH {RANKED_SQL}, {CURVE_SQL.format(g=0)} SELECT round({AP_SQL}, 9) AS average_precision FROM curve",
)
def average_precision(spark, sf):
    out = metrics.avg_precision(ranked(spark, sf), "score", "label")
    return out.select(F.round("average_precision", 9).alias("average_precision"))


ORDER_SQL = "o AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS n FROM ranked)"


@query(
    "hits_at_n",
    f"""WITH {RANKED_SQL}, {ORDER_SQL} SELECT CAST(40 AS BIGINT) AS n, CAST(sum(label) FILTER (WHERE rank <= 40) AS BIGINT) AS hits FROM o""",
)
def hits_at_n(spark, sf):
    return metrics.hits_at_n(ranked(spark, sf), "score", "label", "id", 40)


@query(
    "hits_at_ratio",
    f"""WITH {RANKED_SQL}, {ORDER_SQL} SELECT CAST(floor(max(n) * 0.05e0) AS BIGINT) AS n,
          CAST(coalesce(sum(label) FILTER (WHERE rank <= floor(n * 0.05e0)), 0) AS BIGINT) AS hits FROM o""",
)
def hits_at_ratio(spark, sf):
    return metrics.hits_at_ratio(ranked(spark, sf), "score", "label", "id", 0.05)


RATIOS = [0.01, 0.02, 0.1, 0.15, 0.2]
EF_SQL = f"""{RANKED_SQL}, {ORDER_SQL}, e AS (
  SELECT r AS ratio, CAST(floor(max(n) * r) AS BIGINT) AS k, CAST(sum(label) AS BIGINT) AS actives,
         CAST(coalesce(sum(label) FILTER (WHERE rank <= floor(n * r)), 0) AS BIGINT) AS hits
  FROM o, (VALUES {', '.join(f'({r}e0)' for r in RATIOS)}) t(r) GROUP BY r),
  f AS (SELECT *, hits * 1e0 / nullif(actives, 0) / ratio AS ef, least(k, actives) / nullif(actives * ratio, 0) AS ef_max FROM e)"""


@query(
    "enrichment_factor",
    f"WITH {EF_SQL} SELECT ratio, k, actives, hits, round(ef, 9) AS ef, round(ef_max, 9) AS ef_max FROM f",
)
def enrichment_factor(spark, sf):
    out = metrics.ef(ranked(spark, sf), "score", "label", "id", RATIOS)
    return out.withColumns({c: F.round(c, 9) for c in ("ef", "ef_max")})


@query("normalized_ef", f"WITH {EF_SQL} SELECT ratio, round(ef / nullif(ef_max, 0), 9) AS nef FROM f")
def normalized_ef(spark, sf):
    return metrics.nef(ranked(spark, sf), "score", "label", "id", RATIOS).withColumn("nef", F.round("nef", 9))


SPLIT = "CASE lang WHEN 'en' THEN 'test' WHEN 'fr' THEN 'val' ELSE 'train' END"
REPORT_RATIOS = [0.05, 0.2]


def _at(r: float) -> str:
    return f"coalesce(sum(label) FILTER (WHERE rank <= floor(n * {r}e0)), 0)"


def _ef_lines() -> str:
    out = []
    for i, r in enumerate(REPORT_RATIOS):
        value = f"h{i} / nullif(actives, 0) / {r}e0"
        top = f"least(floor(n * {r}e0), actives) / nullif(actives * {r}e0, 0)"
        for metric, e in (("EF", value), ("NEF", f"{value} / nullif({top}, 0)")):
            out.append(f"SELECT split, '{metric}', {r}e0, {e} FROM t WHERE split = 'test'")
    return " UNION ALL ".join(out)


REPORT_SQL = f"""{RANKED_SQL}, {CURVE_SQL.format(g=SPLIT)},
  o AS (SELECT {SPLIT} AS split, label * 1e0 AS label, row_number() OVER (PARTITION BY {SPLIT} ORDER BY score DESC, id) AS rank,
          count(*) OVER (PARTITION BY {SPLIT}) AS n FROM ranked),
  t AS (SELECT split, max(n) AS n, sum(label) AS actives, {_at(0.01)} AS h,
          {', '.join(f'{_at(r)} AS h{i}' for i, r in enumerate(REPORT_RATIOS))} FROM o GROUP BY split),
  lines(split, metric, ratio, value) AS (
    SELECT g, 'precision', CAST(NULL AS DOUBLE), {AP_SQL} FROM curve GROUP BY g
    UNION ALL SELECT g, 'roc', NULL, {AUC_SQL} FROM curve GROUP BY g
    UNION ALL SELECT split, 'hits', 0.01e0, h FROM t UNION ALL SELECT split, 'actives', NULL, actives FROM t
    UNION ALL {_ef_lines()})"""


def _report(spark, sf):
    df = ranked(spark, sf).withColumn("split", F.expr(SPLIT))
    return metrics.evaluation_report(df, "split", "score", "label", "id", REPORT_RATIOS)


@query(
    "evaluation_report",
    f"WITH {REPORT_SQL} SELECT split, metric, ratio, round(CAST(value AS DOUBLE), 9) AS value FROM lines",
)
def evaluation_report(spark, sf):
    return _report(spark, sf).withColumn("value", F.round("value", 9))


@query(
    "metric_parity",
    f"""WITH {REPORT_SQL} SELECT DISTINCT split, 0e0 AS diff_roc, 0e0 AS diff_precision, 1 AS "within" FROM lines""",
)
def metric_parity(spark, sf):
    """The report recomputed by the single-metric operators."""
    df = ranked(spark, sf).withColumn("split", F.expr(SPLIT))
    again = metrics.roc_auc(df, "score", "label", ["split"]).join(
        metrics.avg_precision(df, "score", "label", ["split"]), "split"
    )
    recorded = _report(spark, sf).groupBy("split").pivot("metric", ["roc", "precision"]).agg(F.max("value"))
    out = metrics.diff_metrics(
        again.toDF("split", "roc", "precision"), recorded, ["split"], ["roc", "precision"]
    )
    return out.withColumns({c: F.round(c, 6) for c in ("diff_roc", "diff_precision")})


# Splits.


@query("stratified_folds", f"WITH {FOLDED_SQL} SELECT id, active, fold_id FROM folded")
def stratified_folds(spark, sf):
    return splits.stratified_folds(compounds(spark, sf).select("id", "active"), "id", "active")


PARTS_SQL = "p AS (SELECT p_partkey AS id, p_type AS library, CAST(p_size >= 40 AS INTEGER) AS active FROM part)"
ORDER_OF_FOLDS = "list_sort(list_transform(range(10), lambda f: {'c': counts[CAST(f AS INTEGER) + 1], 'f': f}))"


@query(
    "group_stratified_folds",
    f"""WITH RECURSIVE {PARTS_SQL}, libs AS (
          SELECT library, sum(active) AS a, row_number() OVER (ORDER BY library) AS i FROM p GROUP BY library),
        st(i, library, ord, counts) AS (
          SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS BIGINT[]), list_transform(range(10), lambda z: CAST(0 AS BIGINT))
          UNION ALL
          SELECT n.i, n.library, n.ord, list_transform(range(10), lambda f: n.counts[CAST(f AS INTEGER) + 1]
                   + n.a // 10 + CAST(list_position(n.ord, f) - 1 < n.a % 10 AS BIGINT))
          FROM (SELECT l.i, l.library, CAST(l.a AS BIGINT) AS a, st.counts,
                       list_transform({ORDER_OF_FOLDS}, lambda s: s.f) AS ord
                FROM st JOIN libs l ON l.i = st.i + 1) n),
        placed AS (SELECT *, ntile(10) OVER (PARTITION BY library, active ORDER BY md5(CAST(id AS VARCHAR)), id) AS part FROM p)
        SELECT id, placed.library, active, CAST(st.ord[CAST(part AS INTEGER)] AS INTEGER) AS fold_id
        FROM placed JOIN st ON st.library = placed.library""",
)
def group_stratified_folds(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("library"), (F.col("p_size") >= 40).cast("int").alias("active")
    )
    return splits.library_folds(df, "id", "library", "active")


TRIPLE = "concat_ws('|', lang, coalesce(CAST(quality AS VARCHAR), 'null'), coalesce(CAST(toxic AS VARCHAR), 'null'))"


@query(
    "multi_label_folds",
    f"""WITH d AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
        SELECT doc_id, CAST((ntile(10) OVER (PARTITION BY lang, quality, toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1
          + CAST('0x' || substr(md5({TRIPLE}), 1, 8) AS BIGINT) % 10) % 10 AS INTEGER) AS fold_id FROM d""",
)
def multi_label_folds(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    out = splits.multi_label_folds(df, "doc_id", ["lang", "quality", "toxic"])
    return out.select("doc_id", "fold_id")


def _rotation_sql(run: int, use_val: bool) -> str:
    parts = " ".join(
        f"WHEN fold_id IN ({', '.join(map(str, folds))}) THEN '{name}'"
        for name, folds in splits.rotation(run, use_val).items()
        if folds
    )
    return f"""SELECT {run} AS run, {int(use_val)} AS use_val, split, count(*) AS n, CAST(sum(active) AS BIGINT) AS active
               FROM (SELECT active, CASE {parts} END AS split FROM folded) WHERE split IS NOT NULL GROUP BY split"""


RUNS = [(run, val) for run in range(6) for val in (True, False)]


@query("cv_rotation", f"WITH {FOLDED_SQL} " + " UNION ALL ".join(_rotation_sql(*r) for r in RUNS))
def cv_rotation(spark, sf):
    """All runs in one pass: a row is repeated for each run it takes part in."""
    df = splits.stratified_folds(compounds(spark, sf).select("id", "active"), "id", "active")
    table_ = [
        (fold, run, int(val), split)
        for run, val in RUNS
        for split, folds in splits.rotation(run, val).items()
        for fold in folds
    ]
    plan = spark.createDataFrame(table_, "fold_id int, run int, use_val int, split string")
    return (
        df.join(F.broadcast(plan), "fold_id")  # ten folds, twelve runs
        .groupBy("run", "use_val", "split")
        .agg(F.count("*").alias("n"), F.sum("active").alias("active"))
    )


@query(
    "leave_one_fold_out",
    f"WITH {FOLDED_SQL} SELECT id, CASE WHEN fold_id = 3 THEN 'test' ELSE 'train' END AS split FROM folded",
)
def leave_one_fold_out(spark, sf):
    df = splits.stratified_folds(compounds(spark, sf).select("id", "active"), "id", "active")
    return splits.loo_fold(df, 3).select("id", "split")


@query(
    "stratified_holdout",
    f"""WITH {COMPOUNDS_SQL} SELECT id, CASE WHEN row_number() OVER (PARTITION BY active ORDER BY md5(id || ':1'), id)
          <= round(0.8e0 * count(*) OVER (PARTITION BY active)) THEN 'train' ELSE 'val' END AS split FROM compounds""",
)
def stratified_holdout(spark, sf):
    df = compounds(spark, sf).select("id", "active")
    return splits.holdout(df, "id", "active", 0.8, seed=1).select("id", "split")
