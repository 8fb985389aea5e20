"""Catalog scoring and the order list."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.bits import pack_positions
from tamis.functions.text import canonical, hash_fp
from tamis.operators.aggregates import over_threshold
from tamis.operators.clean import passing
from tamis.operators.neighbors import pick_diverse
from tamis.operators.ranking import best_per
from tamis.sources.writers import CSV_WRITE


def featurize(df: DataFrame, text: str, radius: int, n_bits: int) -> DataFrame:
    """Canonical text, hashed fingerprint positions and packed words of raw lines."""
    keyed = df.withColumn("canonical", canonical(text))
    return keyed.withColumn("ones", hash_fp(F.split("canonical", " "), radius, n_bits))


def with_words(df: DataFrame, n_bits: int, ones: str = "ones", fp: str = "fp") -> DataFrame:
    return df.withColumn(fp, pack_positions(ones, n_bits))


def featurize_by(df: DataFrame, featurizer: Callable, schema: str) -> DataFrame:
    """Same with a user's batch function ``Iterator[pandas] -> Iterator[pandas]``."""
    return df.mapInPandas(featurizer, schema)


def score_catalog(df: DataFrame, model, part: str | Column, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Scored rows, and rows over the threshold per part."""
    scored = model.score(df) if hasattr(model, "score") else model.transform(df)
    return scored, over_threshold(scored, part, "score", threshold)


def score_to(scored: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Write ``structure, score`` rows as tasks produce them, in the readers' dialect."""
    scored.select(*cols).write.options(**CSV_WRITE).csv(path, header=True)


def order_list(
    df: DataFrame,
    stages: Sequence[tuple[str, Column]],
    cluster: str,
    score: str,
    id_col: str,
    fp: str,
    n_bits: int,
    n: int,
) -> DataFrame:
    """Filter, keep the best row per cluster, pick a diverse list, best score first."""
    kept = best_per(passing(df, stages), cluster, score, id_col)
    picks = pick_diverse(kept, fp, id_col, score, n_bits, n)
    return picks.orderBy(F.col(score).desc(), F.col(id_col))
