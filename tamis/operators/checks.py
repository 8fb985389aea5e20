"""Expectations on tables: shape, uniqueness, fan-out, equality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def expect(
    df: DataFrame,
    rows: int | None = None,
    columns: int | None = None,
    distinct: dict[str, int] | None = None,
) -> dict[str, int]:
    """Count rows and distinct values in one pass and fail on a mismatch."""
    wanted = distinct or {}
    found = df.agg(
        F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in wanted]
    ).first().asDict()
    found["columns"] = len(df.columns)
    asked = {"rows": rows, "columns": columns, **{f"distinct_{c}": n for c, n in wanted.items()}}
    wrong = {k: (n, found[k]) for k, n in asked.items() if n is not None and found[k] != n}
    if wrong:
        raise AssertionError(f"expected and found differ: {wrong}")
    return found


def violations_of_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value combinations that occur more than once; NULL equals NULL."""
    return df.groupBy(*cols).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    bad = violations_of_unique(df, cols).take(1)
    if bad:
        raise AssertionError(f"rows repeat on {list(cols)}, for example {bad[0]}")
    return df


def conservation(df: DataFrame, part: str, flag: str) -> DataFrame:
    """Row and flag totals over the parts beside those of the whole table."""
    parts = df.groupBy(part).agg(F.count("*").alias("n"), F.sum(flag).alias("f"))
    summed = parts.agg(F.sum("n").alias("rows_in_parts"), F.sum("f").alias("flags_in_parts"))
    whole = df.agg(F.count("*").alias("n"), F.sum(flag).alias("f"))
    return summed.select(
        "rows_in_parts",
        "flags_in_parts",
        whole.select("n").scalar().alias("rows_in_table"),
        whole.select("f").scalar().alias("flags_in_table"),
    )


def fanout(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the right side, rows of the join, counted without joining rows."""
    lefts = left.groupBy(*on).agg(F.count("*").alias("__l"))
    rights = right.groupBy(*on).agg(F.count("*").alias("__r"))
    joined = rights.join(lefts, list(on), "left")
    return joined.agg(
        F.sum("__r").alias("right_rows"),
        F.coalesce(F.sum(F.col("__r") * F.col("__l")), F.lit(0)).alias("joined_rows"),
    ).withColumn("fans_out", (F.col("right_rows") != F.col("joined_rows")).cast("int"))


def expect_no_fanout(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    row = fanout(left, right, on).first()
    if row.fans_out:
        raise AssertionError(f"join has {row.joined_rows} rows, right side {row.right_rows}")


def differences(a: DataFrame, b: DataFrame, on: Sequence[str], values: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Keys on which two results differ: missing on one side or beyond ``tol``."""
    left = a.select(*on, F.struct(*values).alias("__a"))
    right = b.select(*on, F.struct(*values).alias("__b"))
    both = left.join(right, list(on), "full")
    far = F.lit(False)
    for v in values:
        x, y = F.col(f"__a.{v}"), F.col(f"__b.{v}")
        far = far | ((F.abs(x - y) > tol) if tol else ~x.eqNullSafe(y)) | (x.isNull() != y.isNull())
    return both.filter(F.col("__a").isNull() | F.col("__b").isNull() | F.coalesce(far, F.lit(True)))


def assert_same(a: DataFrame, b: DataFrame, on: Sequence[str], values: Sequence[str], tol: float = 0.0) -> None:
    bad = differences(a, b, on, values, tol).take(1)
    if bad:
        raise AssertionError(f"results differ, for example {bad[0]}")


def split_valid(df: DataFrame, error: Column, name: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the rejected rows with theirs."""
    marked = df.withColumn(name, error)
    return marked.filter(F.col(name).isNull()).drop(name), marked.filter(F.col(name).isNotNull())


def split_valid_by(df: DataFrame, convert: Callable, schema: str, name: str = "error") -> tuple[DataFrame, DataFrame]:
    """Same with a batch function ``Iterator[pandas] -> Iterator[pandas]`` that fills ``name``."""
    marked = df.mapInPandas(convert, schema)
    return marked.filter(F.col(name).isNull()).drop(name), marked.filter(F.col(name).isNotNull())
