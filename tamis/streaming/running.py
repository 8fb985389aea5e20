"""Part files that arrive over time: a running top-k and counters per part.

A micro-batch writes one table named after its id, so a batch that is run again
replaces what it wrote. Nothing grows with the rows of the stream: the k best are
kept as k rows from batch to batch, counters as one row per part file. The
folder of the tables belongs to its checkpoint; use both together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tamis.operators.aggregates import over_threshold
from tamis.operators.ranking import top_k
from tamis.session import hadoop_path, passing_work

COUNTERS = "file string, n_rows long, n_over long"


def stream_parts(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000, fmt: str = "parquet"
) -> DataFrame:
    """Files as they appear, with the name of the file each row came from."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def _table(path: str, batch: int) -> str:
    return f"{path}/batch-{batch:012d}"


def written_batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches whose table is complete, ascending."""
    folder, files = hadoop_path(spark, path)
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    ids = [int(n.removeprefix("batch-")) for n in names if n.startswith("batch-")]
    return sorted(i for i in ids if files.exists(hadoop_path(spark, f"{_table(path, i)}/_SUCCESS")[0]))


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_top_k(stream: DataFrame, score: str, id_col: str, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Start keeping the k best; ends when the files present are done.

    A batch meets the k rows that the batch before it left and leaves k rows. The
    table before stays until the next batch, because this one may be run again;
    older ones go. A missing score is never among the best, nor is NaN.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [i for i in written_batches(spark, path) if i < number]
        rows = batch
        if earlier:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(_table(path, earlier[-1])))
        with passing_work(spark):
            top_k(rows, score, id_col, k).write.mode("overwrite").parquet(_table(path, number))
        for old in earlier[:-1]:
            folder, files = hadoop_path(spark, _table(path, old))
            files.delete(folder, True)

    return _start(stream, keep, checkpoint)


def current_top_k(spark: SparkSession, path: str, schema: StructType, score: str, id_col: str, k: int) -> DataFrame:
    """The k best of everything seen so far; k is at most the one they were kept with."""
    batches = written_batches(spark, path)
    if not batches:
        return spark.createDataFrame([], schema)
    return top_k(spark.read.schema(schema).parquet(_table(path, batches[-1])), score, id_col, k)


def part_counters(stream: DataFrame, score: str, threshold: float, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing row counts per part file; ends when the files present are done.

    A batch counts as its twin over tables does: NaN is not over the threshold.
    """

    def count(batch: DataFrame, number: int) -> None:
        over_threshold(batch, "file", score, threshold).write.mode("overwrite").parquet(_table(path, number))

    return _start(stream.select("file", score), count, checkpoint)


def current_counters(spark: SparkSession, path: str) -> DataFrame:
    """Rows and rows over the threshold per part, over everything seen so far."""
    batches = written_batches(spark, path)
    if not batches:
        return spark.createDataFrame([], COUNTERS)
    counts = spark.read.schema(COUNTERS).parquet(*[_table(path, i) for i in batches])
    return counts.groupBy("file").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_over").alias("n_over"))
