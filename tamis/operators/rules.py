"""Alert catalogs: patterns with an allowed number of matches.

A catalog is a parameter, not data, so it becomes one expression per row:
no join, no shuffle, and texts are read whole and in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

OK, INVALID, INVALID_VALUE = "OK", "INVALID", -999  # fixed values


def enabled_rules(rules: DataFrame, switches: str, prefix: str = "Rule_") -> DataFrame:
    """Rules of the sets a JSON text switches on; incomplete rules are dropped.

    The JSON also holds ranges (arrays); only ``Rule_*`` entries are read here.
    """
    spark = rules.sparkSession
    names = (
        spark.createDataFrame([(switches,)], "j string")
        .select(F.explode(F.from_json("j", "map<string,string>")))
        .filter(F.col("key").startswith(prefix) & (F.col("value") == "true"))
        .select(F.substr("key", F.lit(len(prefix) + 1)).alias("rule_set_name"))
    )
    return rules.na.drop("any").join(names, "rule_set_name", "left_semi")


def ranges_of(spark, switches: str) -> dict[str, tuple[float, float]]:
    """The numeric ranges of the same JSON."""
    rows = (
        spark.createDataFrame([(switches,)], "j string")
        .select(F.explode(F.from_json("j", "map<string,string>")))
        .select("key", F.from_json("value", "array<double>").alias("r"))
        .filter(F.size("r") == 2)
        .collect()
    )
    return {r.key: (r.r[0], r.r[1]) for r in rows}


def _listed(rules: DataFrame) -> list:
    return rules.select("rule_id", "pattern", "max", "description").orderBy("rule_id").collect()


def first_alert(text: Column, rules: DataFrame, valid: Column | None = None) -> Column:
    """First rule in catalog order with more matches than allowed, else ``OK``."""
    result = F
    if valid is not None:
        result = result.when(~F.coalesce(valid, F.lit(False)), INVALID)
    else:
        result = result.when(text.isNull(), INVALID)
    for r in _listed(rules):
        result = result.when(F.regexp_count(text, F.lit(r.pattern)) > r.max, f"{r.description} > {r.max}")
    return result.otherwise(OK)


def apply_rules(
    df: DataFrame, text: str, rules: DataFrame, valid: Column | None = None, descriptors: Sequence[str] = (), name: str = "alert"
) -> DataFrame:
    """Alert text per row; an unreadable row is INVALID and its descriptors become -999."""
    marked = df.withColumn(name, first_alert(F.col(text), rules, valid))
    return marked.withColumns(
        {
            c: F.when(F.col(name) == INVALID, F.lit(INVALID_VALUE).cast(df.schema[c].dataType)).otherwise(F.col(c))
            for c in descriptors
        }
    )


def any_match(text: str | Column, patterns: Sequence[str]) -> Column:
    """1 when any pattern occurs."""
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike("|".join(f"(?:{p})" for p in patterns)).cast("int")
