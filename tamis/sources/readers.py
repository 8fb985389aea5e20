"""Readers: merged CSV parts, plain-text catalogs, metric and timing logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from tamis.sources.schemas import PROSPECTIVE_SCORES

# A quote inside a quoted cell is doubled; an empty cell is NULL, a quoted empty one is
# the empty text (no cell can hold the null character that stands for "no value").
CSV_READ = {"quote": '"', "escape": '"', "nullValue": "\0", "emptyValue": ""}

MISSING = -1.0  # a log or a line that is absent

# What a run writes, and how the value follows it.
METRIC_PATTERNS = {
    "test_precision": r"test precision:\s*(\S+)",
    "test_roc": r"test roc:\s*(\S+)",
    "test_nef": r"ratio: 0\.01, NEF:\s*([^\s,]+)",
    "test_ef": r"ratio: 0\.01, EF:\s*([^\s,]+)",
}
TIMING_PATTERN = r"Total time:?\s+([0-9.]+)"
TIMING_COUNT_PATTERN = r"([0-9]+)\s+\S+\s*$"


def read_merged(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType | str,
    cols: Sequence[str] | None = None,
    sep: str = ",",
    keep_empty: bool = False,
    check_header: bool = True,
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Many files of one header as one table; gzip is recognised by name.

    Cells may hold quotes, separators and line breaks. Files known to have no
    line breaks in cells can be read with ``multi_line`` off, which lets Spark
    split large ones.

    With ``keep_empty`` an empty cell is the empty string, not NULL. A header
    that differs from the schema is an error, unless ``check_header`` is off and
    the schema names the columns by their place.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    check = header and check_header
    df = spark.read.options(**CSV_READ).csv(
        paths, schema=schema, header=header, sep=sep, enforceSchema=not check, multiLine=multi_line
    )
    if cols is not None:
        df = df.select(*cols)
    return empty_strings(df) if keep_empty else df


def read_screen(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return read_merged(spark, path, schema)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, keep_empty: bool = True) -> DataFrame:
    return read_merged(spark, path, schema, sep="\t", keep_empty=keep_empty)


def read_scored(spark: SparkSession, path: str | Sequence[str], schema: StructType | str = PROSPECTIVE_SCORES) -> DataFrame:
    """Scored rows as ``write_scored`` leaves them: tab-separated, no header, columns by place."""
    return read_merged(spark, path, schema, sep="\t", header=False)


def empty_strings(df: DataFrame) -> DataFrame:
    """NULL text to the empty text, other types untouched."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.fillna("", subset=names) if names else df


def merge_parts(parts: Sequence[DataFrame], idx: Sequence[int]) -> DataFrame:
    """Append a chosen subset of tables, columns matched by name."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts[i] for i in idx]
    )


def concat_tables(*parts: DataFrame) -> DataFrame:
    return merge_parts(parts, range(len(parts)))


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``structure id`` without header."""
    return smi_fields(spark.read.text(path, lineSep="\n"), "value")


def smi_fields(df: DataFrame, line: str, *keep: str) -> DataFrame:
    """First and second field of a stripped line; the second may be missing."""
    stripped = F.regexp_replace(F.col(line), r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")
    parts = F.split(stripped, " ")
    return df.select(*keep, F.get(parts, F.lit(0)).alias("structure"), F.get(parts, F.lit(1)).alias("id"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """First column of a TSV with one header row; the others are never parsed."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.select(F.col(f"`{df.columns[0]}`").alias("structure"))


def log_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, line_no, line`` of run logs; a log is one small file, read whole."""
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")))
        .withColumnsRenamed({"pos": "line_no", "col": "line"})
    )


def _last(column: Column, order: str) -> Column:
    return F.max_by(column, F.when(column.isNotNull(), F.col(order)))


def metrics_of_lines(lines: DataFrame, file: str = "file", line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Last value of each metric per log, ``-1`` where the line is absent."""
    found = {
        name: F.regexp_extract(line, pattern, 1) for name, pattern in METRIC_PATTERNS.items()
    }
    return lines.groupBy(file).agg(
        *[
            F.coalesce(
                _last(F.when(text != "", text).try_cast("double"), line_no), F.lit(MISSING)
            ).alias(name)
            for name, text in found.items()
        ]
    )


def read_metric_logs(spark: SparkSession, paths: str | Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """One row of metrics per log; ``expected`` lists files that must appear."""
    metrics = metrics_of_lines(log_lines(spark, paths))
    if expected is None:
        return metrics
    names = list(METRIC_PATTERNS)
    return expected.join(metrics, "file", "left").fillna(MISSING, subset=names)


def timing_of_lines(lines: DataFrame, file: str = "file", line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Minutes, hours and rows handled, from the last timing line of each log."""
    timed = lines.filter(F.col(line).rlike(TIMING_PATTERN))
    return timed.groupBy(file).agg(
        F.max_by(F.regexp_extract(line, TIMING_PATTERN, 1).cast("double"), line_no).alias("minutes"),
        F.max_by(F.regexp_extract(line, TIMING_COUNT_PATTERN, 1).cast("long"), line_no).alias("rows"),
    ).withColumn("hours", F.col("minutes") / 60.0)


def read_timing_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return timing_of_lines(log_lines(spark, paths))


def file_counts(df: DataFrame, score: str, file: str | Column | None = None) -> DataFrame:
    """Rows and scored rows of every part file."""
    file = F.col("_metadata.file_path") if file is None else (F.col(file) if isinstance(file, str) else file)
    return df.groupBy(file.alias("file")).agg(
        F.count("*").alias("n_rows"), F.count(score).alias("n_scored")
    )
