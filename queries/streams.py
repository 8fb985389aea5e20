"""Streaming twins of batch queries, over the given tables as arriving files."""

from pyspark.sql import functions as F

from queries.base import query, table
from tamis.session import work_path
from tamis.streaming import running


def _arriving(spark, df, by: str) -> str:
    path = work_path(spark, "arriving")
    df.write.partitionBy(by).parquet(path)
    return path


@query("running_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def running_top_k(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = _arriving(spark, df, "o_orderpriority")
    schema = df.select("o_orderkey", "o_totalprice").schema
    stream = running.stream_parts(spark, path, schema, files_per_trigger=2).drop("file", "o_orderpriority")
    out, marks = work_path(spark, "top"), work_path(spark, "marks")
    running.running_top_k(stream, "o_totalprice", "o_orderkey", 100, out, marks).awaitTermination()
    return running.current_top_k(spark, out, schema, "o_totalprice", "o_orderkey", 100)


@query(
    "part_counters",
    "SELECT event_type AS part, count(*) AS n_rows, count(*) FILTER (WHERE value > 100) AS n_over FROM events GROUP BY event_type",
)
def part_counters(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    path = _arriving(spark, df, "event_type")
    stream = running.stream_parts(spark, path, df.select("event_id", "value").schema, files_per_trigger=2)
    part = F.regexp_extract("file", "event_type=([^/]+)/", 1)
    out, marks = work_path(spark, "counts"), work_path(spark, "marks")
    running.part_counters(stream.withColumn("file", part), "value", 100.0, out, marks).awaitTermination()
    return running.current_counters(spark, out).withColumnRenamed("file", "part")
