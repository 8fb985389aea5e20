"""Sinks: gzip CSV, parts, folds, checked TSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.checks import expect
from tamis.operators.order import part_of, positions
from tamis.sources.readers import read_merged


# The dialect of ``readers.CSV_READ``; white space around a cell is part of it.
CSV_WRITE = {
    "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """gzip CSV with header, no index column."""
    df.write.options(**CSV_WRITE).csv(path, header=True, sep=sep, compression="gzip")


def write_scored(df: DataFrame, path: str, cols: Sequence[str] = ("old_smiles", "smiles", "id", "score")) -> None:
    """Scored rows as tasks produce them: tab-separated, no header."""
    df.select(*cols).write.options(**CSV_WRITE).csv(path, header=False, sep="\t")


def to_parts(df: DataFrame, k: int, order: Sequence[str | Column], name: str = "part") -> DataFrame:
    """Cut in ``k`` nearly equal consecutive parts; the first ``n mod k`` get one more."""
    placed = positions(df, order, name="__position", size="__size")
    return placed.withColumn(name, part_of(F.col("__position"), F.col("__size"), k)).drop(
        "__position", "__size"
    )


def write_parts(df: DataFrame, path: str, part: str = "part") -> None:
    """One folder per part; a part may hold several files, so no task writes it alone."""
    df.write.options(**CSV_WRITE).partitionBy(part).csv(path, header=True, compression="gzip")


def write_folds(df: DataFrame, path: str, fold: str = "fold_id") -> None:
    write_parts(df, path, fold)


def export(
    df: DataFrame,
    path: str,
    drop: Sequence[str] = (),
    sep: str = "\t",
    rows: int | None = None,
    columns: int | None = None,
) -> DataFrame:
    """Drop columns and write; the shape is asserted before and after.

    Returns what was written, read back.
    """
    before = expect(df, rows=rows, columns=columns)
    slim = df.drop(*drop)
    write_table(slim, path, sep)
    back = read_merged(df.sparkSession, path, slim.schema, sep=sep)
    expect(back, rows=before["rows"], columns=len(df.columns) - len(drop))
    return back
