"""Rankers, ensembles, cross-validation and catalog scoring."""

from pyspark.sql import functions as F

from queries.base import FOLDED_SQL, N_BITS, TANIMOTO_SQL, compounds, query, table
from queries.scalar import hash_fp_sql
from tamis.functions.bits import bits_to_vector
from tamis.models import ensembles, rankers
from tamis.operators.metrics import evaluation_report
from tamis.operators.splits import cv_split, stratified_folds
from tamis.plans.crossval import run_cv
from tamis.plans.screen import featurize, score_catalog, with_words
from tamis.session import materialize, spread

TREES = {"n_estimators": 10, "max_depth": 4}


METRICS = [("precision", None), ("roc", None), ("hits", 0.01), ("actives", None)]
TEST_METRICS = [("EF", 0.01), ("NEF", 0.01), ("EF", 0.1), ("NEF", 0.1)]


def checked(report, to_label=True):
    """What another library's fit has in common: the report's lines, the actives, values in their range.

    A missing value is in no range. A classifier ranks the rows it was fitted
    to better than chance, a regressor of another value at least otherwise than
    chance; one that gives every row the same score does neither.
    """
    value = F.col("value")
    upper = F.col("metric").isin("hits", "actives", "EF") | (value <= 1 + 1e-9)
    return report.withColumns(
        {
            "actives": F.when(F.col("metric") == "actives", value),
            "in_range": F.coalesce((value >= 0) & upper & ~F.isnan(value), F.lit(False)),
            "told_apart": F.when((F.col("metric") == "roc") & (F.col("split") == "train"), F.coalesce(value > 0.5 if to_label else value != 0.5, F.lit(False))),
        }
    ).drop("value")


def _split_sql(folds):
    return " ".join(f"WHEN fold_id IN ({', '.join(map(str, f))}) THEN '{s}'" for s, f in folds.items())


def checked_sql(train=range(8), val=(), test=(9,), test_metrics=TEST_METRICS):
    """Twin of a checked report over the folds of a run."""
    folds = {s: f for s, f in (("train", train), ("val", val), ("test", test)) if f}
    lines = [(m, r, False) for m, r in METRICS] + [(m, r, True) for m, r in test_metrics]
    values = ", ".join(f"('{m}', {'NULL' if r is None else f'{r}e0'}, {t})" for m, r, t in lines)
    return f"""WITH {FOLDED_SQL}, s AS (SELECT CASE {_split_sql(folds)} END AS split, active FROM folded),
          t AS (SELECT split, CAST(sum(active) AS DOUBLE) AS n, count(*) AS size FROM s WHERE split IS NOT NULL GROUP BY split),
          m(metric, ratio, test_only) AS (VALUES {values})
        SELECT split, metric, CAST(ratio AS DOUBLE) AS ratio, CASE WHEN metric = 'actives' THEN n END AS actives,
               metric IN ('hits', 'actives') OR (n > 0 AND n < size AND NOT (metric = 'NEF' AND floor(size * ratio) = 0)) AS in_range,
               CASE WHEN metric = 'roc' AND split = 'train' THEN true END AS told_apart FROM t, m WHERE NOT test_only OR split = 'test'"""


def training(spark, sf):
    """Folded compounds with ML features, a binary and a continuous label."""
    df = stratified_folds(compounds(spark, sf), "id", "active")
    return materialize(
        df.select(
            "id",
            "fold_id",
            "fp",
            "cluster",
            bits_to_vector("bits").alias("features"),
            F.col("active").cast("double").alias("label"),
            F.col("cluster").cast("double").alias("value"),
        ),
        "training",
    )


def _report(spark, sf, make, use_val=False, run=4):
    rows = cv_split(training(spark, sf), run, use_val)
    part = lambda name: rows.filter(F.col("split") == name)
    fitted = make.fit(part("train"), part("val") if use_val else None)
    scored = fitted.score(rows).select("id", "split", "score", "label")
    return checked(evaluation_report(scored, "split", "score", "label", "id", [0.01, 0.1]))


@query(
    "similarity_ranker",
    f"""WITH {FOLDED_SQL}, s AS (SELECT a.id, b.id AS ref, {TANIMOTO_SQL} AS sim FROM folded a, folded b
          WHERE a.fold_id = 9 AND b.fold_id < 8 AND b.active = 1)
        SELECT id, arg_min(ref, (-sim, ref)) AS nearest_active_id, round(max(sim), 6) AS score FROM s GROUP BY id""",
)
def similarity_ranker(spark, sf):
    rows = cv_split(training(spark, sf), 4, use_val=False)
    model = rankers.SimilarityRanker("fp", "id", "label", N_BITS).fit(rows.filter("split = 'train'"))
    out = model.transform(rows.filter("split = 'test'").select("id", "fp"))
    return out.select("id", "nearest_active_id", F.round("score", 6).alias("score"))


@query("rf_classifier", checked_sql())
def rf_classifier(spark, sf):
    return _report(spark, sf, rankers.RankerRF(TREES))


@query("rf_regressor", checked_sql())
def rf_regressor(spark, sf):
    df = training(spark, sf)
    rows = cv_split(df, 4, use_val=False)
    fitted = rankers.RankerRFReg(TREES, label="value").fit(rows.filter("split = 'train'"))
    scored = fitted.score(rows).select("id", "split", "score", "label")
    return checked(evaluation_report(scored, "split", "score", "label", "id", [0.01, 0.1]), to_label=False)


@query("boosted_classifier", checked_sql(val=(8,)))
def boosted_classifier(spark, sf):
    return _report(spark, sf, rankers.RankerGBT({"n_estimators": 8, "max_depth": 3, "metric": "precision"}), use_val=True)


@query("boosted_regressor", checked_sql(val=(8,)))
def boosted_regressor(spark, sf):
    rows = cv_split(training(spark, sf), 4)
    make = rankers.RankerGBTReg({"n_estimators": 8, "max_depth": 3, "metric": "roc"}, label="value", binary_label="label")
    fitted = make.fit(rows.filter("split = 'train'"), rows.filter("split = 'val'"))
    scored = fitted.score(rows).select("id", "split", "score", "label")
    return checked(evaluation_report(scored, "split", "score", "label", "id", [0.01, 0.1]), to_label=False)


@query("linear_booster", checked_sql())
def linear_booster(spark, sf):
    return _report(spark, sf, rankers.RankerLinear({"reg_lambda": 0.1, "n_estimators": 30}))


@query("mlp_classifier", checked_sql(val=(8,)))
def mlp_classifier(spark, sf):
    return _report(spark, sf, rankers.RankerMLP({"layers": [16], "epochs": [10, 30]}), use_val=True)


# Outputs of twelve rounds that SQL knows too: hexadecimal digits of a hash of the id, as
# numbers, and in some rounds a pull towards the actives or away from them.
PULL = [0.0, 2.0, 2.0, 4.0, 0.0, 8.0, -2.0, -4.0, -1.0, -8.0, 1.0, 90.0]
PATIENCE = 3


@query(
    "select_iteration",
    f"""WITH {FOLDED_SQL}, r AS (SELECT unnest(range({len(PULL)})) AS r, unnest({PULL}) AS pull),
          s AS (SELECT id, active, r + 1 AS n_trees,
                  sum(strpos('0123456789abcdef', substr(md5(CAST(id AS VARCHAR)), CAST(r + 1 AS INTEGER), 1)) - 1 + pull * active)
                    OVER (PARTITION BY id ORDER BY r) AS score
                FROM folded, r WHERE fold_id >= 5),
          k AS (SELECT *, rank() OVER (PARTITION BY n_trees ORDER BY score) + (count(*) OVER (PARTITION BY n_trees, score) - 1) / 2e0 AS place FROM s),
          v AS (SELECT n_trees, round((sum(place) FILTER (WHERE active = 1) - sum(active) * (sum(active) + 1) / 2e0)
                  / (sum(active) * (count(*) - sum(active))), 9) AS value FROM k GROUP BY n_trees),
          m AS (SELECT *, value >= coalesce(max(value) OVER (ORDER BY n_trees ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM v),
          l AS (SELECT *, max(CASE WHEN best THEN n_trees END) OVER (ORDER BY n_trees) AS last FROM m),
          e AS (SELECT coalesce(min(n_trees) FILTER (WHERE n_trees - last > {PATIENCE}), 1000) AS n FROM l)
        SELECT CAST(n_trees AS INTEGER) AS n_trees, value,
               CAST(n_trees = (SELECT max(last) FROM l, e WHERE n_trees < e.n) AS INTEGER) AS kept FROM l""",
)
def select_iteration(spark, sf):
    """Validation metric of every round of known outputs and the round kept; round 12 comes too late."""
    folded = stratified_folds(compounds(spark, sf), "id", "active").filter("fold_id >= 5")
    digit = lambda r: F.conv(F.substring(F.md5(F.col("id").cast("string")), r + 1, 1), 16, 10).cast("double")
    steps = F.array(*[digit(r) + F.lit(pull) * F.col("active") for r, pull in enumerate(PULL)])
    margins = folded.select("active", steps.alias("steps")).withColumn("margins", rankers.running("steps"))
    values = rankers.judge_margins(margins, "active", "margins", "roc").withColumn("value", F.round("value", 9))
    values = materialize(values, "iterations")
    listed = [(r.n_trees, r.value) for r in values.orderBy("n_trees").collect()]  # one row per round
    return values.withColumn("kept", (F.col("n_trees") == rankers.best_iteration(listed, PATIENCE)).cast("int"))


@query("boosted_early_stop")
def boosted_early_stop(spark, sf):
    """Up to 300 trees with patience of 10: the metric of every round that was fitted, and the round kept."""
    rows = cv_split(training(spark, sf), 4)
    conf = {"n_estimators": 300, "patience": 10, "max_depth": 3, "colsample_bylevel": 0.5, "min_child_weight": 1.0, "metric": "roc"}
    fitted = rankers.RankerGBT(conf).fit(rows.filter("split = 'train'"), rows.filter("split = 'val'"))
    return fitted.rounds(spark)


@query("stacking_ensemble", checked_sql())
def stacking_ensemble(spark, sf):
    rows = cv_split(training(spark, sf), 4, use_val=False)
    train = rows.filter("split = 'train'")
    models = {
        "forest": rankers.RankerRF(TREES).fit(train),
        "linear": rankers.RankerLinear({"n_estimators": 30}).fit(train),
    }
    stack = ensembles.Stacking(models).fit(train)
    scored = stack.score(rows).select("id", "split", "score", "label")
    return checked(evaluation_report(scored, "split", "score", "label", "id", [0.01, 0.1]))


def _cv_sql():
    """Each run trains on the folds it does not test, among the first eight for the inner runs."""
    parts = []
    for run in range(6):
        test = 2 * run + 1 if run < 4 else 9
        train = [f for f in range(9 if run == 5 else 8) if f != test]
        one = checked_sql(train, (), (test,), [("EF", 0.1), ("NEF", 0.1)])
        parts.append(f"SELECT {run} AS run, * FROM ({one})")
    runs = " UNION ALL ".join(parts)
    return f"""SELECT model, CAST(setting AS INTEGER) AS setting, CAST(run AS INTEGER) AS run, split, metric, ratio, actives, in_range, told_apart
        FROM (VALUES ('forest', 0), ('forest', 1), ('linear', 0)) f(model, setting), ({runs})"""


@query("cv_run", _cv_sql())
def cv_run(spark, sf):
    makers = {"forest": rankers.RankerRF, "linear": rankers.RankerLinear}
    grids = {
        "forest": {"n_estimators": [5, 10], "max_depth": [4]},
        "linear": {"n_estimators": [20], "reg_lambda": [0.1]},
    }
    return checked(run_cv(training(spark, sf), makers, grids, list(range(6)), "id", "label", (0.1,), use_val=False))


@query(
    "prospective_score",
    f"""WITH {FOLDED_SQL}, s AS (SELECT a.id, a.fold_id, {TANIMOTO_SQL} AS sim FROM folded a, folded b
          WHERE b.active = 1), m AS (SELECT id, fold_id, max(sim) AS sim FROM s GROUP BY ALL)
        SELECT fold_id, count(*) AS n_rows, count(*) FILTER (WHERE sim > 0.5e0) AS n_over FROM m GROUP BY fold_id""",
)
def prospective_score(spark, sf):
    df = training(spark, sf)
    model = rankers.SimilarityRanker("fp", "id", "label", N_BITS).fit(df)
    _, counts = score_catalog(df, model, "fold_id", 0.5)
    return counts


@query(
    "catalog_score_job",
    f"""WITH {hash_fp_sql(1024, 1)}, sizes AS (SELECT doc_id, count(*) AS n FROM ones GROUP BY doc_id),
          actives AS (SELECT * FROM sizes WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1)),
          shared AS (SELECT a.doc_id, r.doc_id AS ref, count(*) AS n FROM ones a JOIN ones r ON a.bit = r.bit
                     WHERE r.doc_id IN (SELECT doc_id FROM actives) GROUP BY ALL),
          s AS (SELECT a.doc_id, r.doc_id AS ref, coalesce(c.n, 0) * 1e0 / (a.n + r.n - coalesce(c.n, 0)) AS sim
                FROM sizes a CROSS JOIN actives r LEFT JOIN shared c ON c.doc_id = a.doc_id AND c.ref = r.doc_id)
        SELECT doc_id, round(max(sim), 6) AS score, arg_min(ref, (-sim, ref)) AS nearest_active_id FROM s GROUP BY doc_id""",
)
def catalog_score_job(spark, sf):
    """Raw text to canonical text, fingerprint and similarity to the actives, in one pass."""
    raw = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    docs = with_words(featurize(raw, "text", 1, 1024), 1024)
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") * F.col("toxic")).alias("active"))
    docs = materialize(docs.select("doc_id", "fp"), "prints")  # read for the actives and the scores
    model = rankers.SimilarityRanker("fp", "doc_id", "active", 1024).fit(docs.join(labels, "doc_id"))
    out = model.transform(docs)
    return out.select("doc_id", F.round("score", 6).alias("score"), "nearest_active_id")
