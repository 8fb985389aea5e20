"""Readers and writers, by round trips through files in the shared work folder."""

from pyspark.sql import functions as F

from queries.base import COMPOUNDS_SQL, FOLDED_SQL, N_BITS, TANIMOTO_SQL, compounds, query, table
from tamis.models.rankers import SimilarityRanker
from tamis.operators.splits import stratified_folds
from tamis.plans.screen import score_to
from tamis.session import work_path
from tamis.sources import model_store, readers, writers
from tamis.operators.ranking import row_range


@query("union_files", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def union_files(spark, sf):
    path = work_path(spark, "union_files")
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
    table(spark, sf, "lineitem").select(*cols).write.partitionBy("l_returnflag").csv(path, header=True)
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    paths = [f"{path}/l_returnflag={f}" for f in "ANR"]
    return readers.read_merged(spark, paths, schema, ["l_orderkey", "l_linenumber", "l_quantity"])


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "union_selected",
    "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase', 'view')",
)
def union_selected(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return readers.merge_parts([events.filter(F.col("event_type") == t) for t in TYPES], [0, 2, 4])


@query("csv_gzip_io", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_gzip_io(spark, sf):
    path = work_path(spark, "csv_gzip")
    df = table(spark, sf, "orders").drop("o_orderdate")
    writers.write_table(df, path)
    return readers.read_screen(spark, path, df.schema)


@query("csv_text_io", "SELECT doc_id, text, source, n_chars FROM documents")
def csv_text_io(spark, sf):
    """Texts with quotes, separators and line breaks."""
    path = work_path(spark, "csv_text")
    df = table(spark, sf, "documents").drop("lang")
    writers.write_table(df, path)
    return readers.read_screen(spark, path, df.schema)


@query(
    "scored_tsv_io",
    """SELECT d.text AS old_smiles, d.lang AS smiles, CAST(d.doc_id AS VARCHAR) AS id, CAST(l.quality AS DOUBLE) AS score
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def scored_tsv_io(spark, sf):
    path = work_path(spark, "scored_tsv")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    id_, score = F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("double").alias("score")
    writers.write_scored(rows.select(F.col("text").alias("old_smiles"), F.col("lang").alias("smiles"), id_, score), path)
    return readers.read_scored(spark, path)


@query(
    "smi_lines",
    r"""SELECT f[1] AS structure, f[2] AS id FROM (
          SELECT string_split(regexp_replace(line, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g'), ' ') AS f
          FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))""",
)
def smi_lines(spark, sf):
    path = work_path(spark, "smi")
    table(spark, sf, "documents").select(F.explode(F.split("text", "\n"))).write.text(path, lineSep="\n")
    return readers.read_smi(spark, path)


@query("tsv_first_column", "SELECT p_name AS structure FROM part")
def tsv_first_column(spark, sf):
    path = work_path(spark, "tsv")
    table(spark, sf, "part").select("p_name", "p_brand", "p_type", "p_size").write.csv(path, sep="\t", header=True)
    return readers.read_catalog(spark, path)


@query(
    "keep_empty_strings",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS control FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def keep_empty_strings(spark, sf):
    path = work_path(spark, "empty")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("control"))
    df = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    writers.write_table(df, path, sep="\t")
    return readers.read_tsv(spark, path, df.schema)


@query(
    "row_range_slice",
    """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
       WHERE r BETWEEN 3001 AND 4000""",
)
def row_range_slice(spark, sf):
    return row_range(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 3, 1000, ["o_orderkey"])


@query(
    "split_into_parts",
    "SELECT p_partkey, CAST(ntile(50) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS part FROM part",
)
def split_into_parts(spark, sf):
    path = work_path(spark, "parts")
    parts = writers.to_parts(table(spark, sf, "part").select("p_partkey"), 50, ["p_partkey"])
    writers.write_parts(parts, path)
    return spark.read.csv(path, header=True, schema="p_partkey long, part int")


@query("write_folds", f"WITH {FOLDED_SQL} SELECT id, bits, fold_id FROM folded")
def write_folds(spark, sf):
    path = work_path(spark, "folds")
    df = stratified_folds(compounds(spark, sf).select("id", "bits", "active"), "id", "active")
    writers.write_folds(df.select("id", "bits", "fold_id"), path)
    return spark.read.csv(path, header=True, schema="id long, bits string, fold_id int")


@query("export_tsv", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def export_tsv(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderdate")
    return writers.export(df, work_path(spark, "export"), drop=["o_orderstatus", "o_orderpriority"], columns=5)


# Events as lines of run logs: a log per user and day, lines in event order.
LOGS_SQL = """lines AS (
  SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS file, event_id, event_type, value,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def _log_lines(spark, sf):
    value = F.col("value").cast("string")
    k = F.get_json_object("props", "$.k")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("test precision: "), value))
        .when(F.col("event_type") == "view", F.concat(F.lit("test roc: "), value))
        .when(F.col("event_type") == "error", F.concat(F.lit("ratio: 0.01, NEF: "), value))
        .when(F.col("event_type") == "signup", F.concat(F.lit("ratio: 0.01, EF: "), value, F.lit(",\tactive: "), k))
        .otherwise(F.concat(F.lit("Total time: "), value, F.lit(" minutes for "), k, F.lit(" compounds")))
    )
    file = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return table(spark, sf, "events").select(file.alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


@query(
    "parse_metric_logs",
    f"WITH {LOGS_SQL} SELECT file, "
    + ", ".join(
        f"coalesce(arg_max(value, event_id) FILTER (WHERE event_type = '{t}'), -1e0) AS {m}"
        for t, m in (("click", "test_precision"), ("view", "test_roc"), ("error", "test_nef"), ("signup", "test_ef"))
    )
    + " FROM lines GROUP BY file",
)
def parse_metric_logs(spark, sf):
    return readers.metrics_of_lines(_log_lines(spark, sf))


@query(
    "parse_timing_logs",
    f"""WITH {LOGS_SQL} SELECT file, arg_max(value, event_id) AS minutes, arg_max(k, event_id) AS rows,
          round(arg_max(value, event_id) / 60e0, 6) AS hours FROM lines WHERE event_type = 'purchase' GROUP BY file""",
)
def parse_timing_logs(spark, sf):
    return readers.timing_of_lines(_log_lines(spark, sf)).withColumn("hours", F.round("hours", 6))


@query(
    "file_row_counts",
    """SELECT event_type AS file, count(*) AS n_rows, count(*) FILTER (WHERE value <= 100) AS n_scored FROM events GROUP BY event_type""",
)
def file_row_counts(spark, sf):
    path = work_path(spark, "counted")
    score = F.when(F.col("value") <= 100, F.col("value")).alias("score")
    table(spark, sf, "events").select("event_type", "event_id", score).write.partitionBy("event_type").parquet(path)
    folder = F.regexp_extract("_metadata.file_path", "event_type=([^/]+)/", 1)
    return readers.file_counts(spark.read.parquet(path), "score", folder)


ACTIVE_SIMILARITY_SQL = f"""s AS (SELECT a.id, b.id AS ref, {TANIMOTO_SQL} AS sim FROM compounds a, compounds b WHERE b.active = 1)"""


def _similarity(spark, sf):
    df = compounds(spark, sf).select("id", "bits", "fp", "active")
    return df, SimilarityRanker("fp", "id", "active", N_BITS).fit(df)


@query(
    "write_scored_part",
    f"""WITH {COMPOUNDS_SQL}, {ACTIVE_SIMILARITY_SQL} SELECT bits AS structure, round(m.sim, 6) AS score
        FROM compounds c JOIN (SELECT id, max(sim) AS sim FROM s GROUP BY id) m ON c.id = m.id""",
)
def write_scored_part(spark, sf):
    df, model = _similarity(spark, sf)
    path = work_path(spark, "scored")
    score_to(model.transform(df), path, ["bits", "score"])
    back = readers.read_merged(spark, path, "bits string, score double")
    return back.select(F.col("bits").alias("structure"), F.round("score", 6).alias("score"))


@query(
    "model_store",
    f"""WITH {COMPOUNDS_SQL}, {ACTIVE_SIMILARITY_SQL} SELECT id, round(max(sim), 6) AS score FROM s GROUP BY id""",
)
def model_store_(spark, sf):
    df, model = _similarity(spark, sf)
    path = work_path(spark, "model")
    model_store.save(spark, model, path)
    return model_store.load(spark, path).transform(df).select("id", F.round("score", 6).alias("score"))
