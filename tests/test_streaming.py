import math
import os
import random

from pyspark.sql import functions as F

from tamis.operators.aggregates import over_threshold
from tamis.operators.ranking import top_k
from tamis.session import work_folder, work_path
from tamis.streaming import running

SCHEMA = "id long, score double"


def test_stream_equals_batch_and_goes_on(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(30)) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = work_path(spark, "files")
    top, marks, counts, cmarks = (work_path(spark, n) for n in ("top", "marks", "counts", "cmarks"))

    def arrive(lo, hi):
        df.filter(F.col("id").between(lo, hi - 1)).repartition(3).write.mode("append").parquet(path)
        stream = running.stream_parts(spark, path, df.schema, files_per_trigger=2)
        running.running_top_k(stream.drop("file"), "score", "id", 10, top, marks).awaitTermination()
        running.part_counters(stream, "score", 20.0, counts, cmarks).awaitTermination()

    for lo, hi in ((0, 250), (250, 400)):
        arrive(lo, hi)
        seen = df.filter(F.col("id") < hi)
        now = running.current_top_k(spark, top, df.schema, "score", "id", 10).collect()
        assert now == top_k(seen, "score", "id", 10).collect()
    batch = spark.read.schema(SCHEMA).parquet(path)
    want = over_threshold(batch.withColumn("file", F.col("_metadata.file_path")), "file", "score", 20.0)
    assert sorted(map(tuple, running.current_counters(spark, counts).collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_meets_k_rows_and_leaves_k(spark):
    """Ten batches, one file each: two tables of k rows are left, nothing else."""
    rng = random.Random(6)
    values = [None, math.nan, math.inf, 3.0, 3.0, *[rng.random() for _ in range(395)]]
    rng.shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), SCHEMA)
    path, top, marks = (work_path(spark, n) for n in ("files", "top", "marks"))
    df.repartition(10).write.parquet(path)
    before = set(os.listdir(work_folder(spark)))
    stream = running.stream_parts(spark, path, df.schema, files_per_trigger=1).drop("file")
    running.running_top_k(stream, "score", "id", 7, top, marks).awaitTermination()
    assert running.written_batches(spark, top) == [8, 9]
    assert [spark.read.parquet(f"{top}/batch-{i:012d}").count() for i in (8, 9)] == [7, 7]
    now = running.current_top_k(spark, top, df.schema, "score", "id", 7).collect()
    assert now == top_k(df, "score", "id", 7).collect()
    left = {n.split("-")[0] for n in set(os.listdir(work_folder(spark))) - before}
    assert left <= {"top", "marks", "ordered"}  # ordered: the two calls above, outside the stream


def test_a_batch_run_again_replaces_its_table(spark):
    path, top = work_path(spark, "files"), work_path(spark, "top")
    counts = work_path(spark, "counts")
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], SCHEMA)
    df.repartition(3).write.parquet(path)
    for _ in range(2):  # new checkpoints: every batch comes again
        stream = running.stream_parts(spark, path, df.schema, files_per_trigger=1)
        running.running_top_k(stream.drop("file"), "score", "id", 4, top, work_path(spark, "marks")).awaitTermination()
        running.part_counters(stream, "score", 9.0, counts, work_path(spark, "marks")).awaitTermination()
    assert [r.id for r in running.current_top_k(spark, top, df.schema, "score", "id", 4).collect()] == [29, 28, 27, 26]
    totals = running.current_counters(spark, counts).agg(F.sum("n_rows"), F.sum("n_over")).first()
    assert tuple(totals) == (30, 20)


def test_streams_that_saw_nothing(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    assert running.current_top_k(spark, work_path(spark, "none"), schema, "score", "id", 3).count() == 0
    assert running.current_counters(spark, work_path(spark, "none")).count() == 0


def test_nan_is_counted_as_in_the_batch_twin(spark):
    path, counts = work_path(spark, "files"), work_path(spark, "counts")
    df = spark.createDataFrame([(1, math.nan), (2, None), (3, 0.5), (4, 0.05)], SCHEMA)
    df.coalesce(1).write.parquet(path)
    stream = running.stream_parts(spark, path, df.schema)
    running.part_counters(stream, "score", 0.1, counts, work_path(spark, "marks")).awaitTermination()
    assert [(r.n_rows, r.n_over) for r in running.current_counters(spark, counts).collect()] == [(4, 1)]
