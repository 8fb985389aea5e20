"""Raw readings to labelled, folded training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.bits import pack_positions
from tamis.functions.text import canonical, hash_fp, strip_parts
from tamis.operators.checks import violations_of_unique
from tamis.operators.clean import clean_readings, collapse_primary, flag_retest, label_activity
from tamis.operators.identity import group_identities
from tamis.operators.splits import stratified_folds
from tamis.session import materialize, passing_shuffles, passing_table


def fingerprint(structure: str, radius: int, n_bits: int) -> Column:
    """Packed fingerprint of a canonical structure, as searches and rankers take it."""
    return pack_positions(hash_fp(F.split(structure, " "), radius, n_bits), n_bits)


def master_table(
    raw: DataFrame,
    alert: Column,
    unique_on: list[str] | None = None,
    threshold: float = 35.0,
    lower: float = -100.0,
    salts: Sequence[str] = (),
    radius: int = 2,
    n_bits: int = 1024,
) -> DataFrame:
    """Clean, name molecules, number duplicates, label and fingerprint: one row per reading.

    ``raw`` has the raw screen schema; ``alert`` is 1 for a structure that raised
    one. ``salts`` are components that do not count as part of a structure. The
    fingerprint ``fp`` is made last, from the structure's text, so that no
    shuffle moves it. The cleaned readings are written until their molecules are
    known; named rows stay, and are numbered when they are read.
    """
    parent = strip_parts("structure", salts) if salts else F.col("structure")
    rows = clean_readings(raw, "inhibition", "structure", lower).withColumn("canonical", canonical(parent))
    unique_on = unique_on or ["sample_id", "plate_name", "plate_well", "run_date", "inhibition"]
    with passing_table(flag_retest(rows, "plate_name"), "readings", "zstd") as rows:  # read by every step on identities
        with passing_shuffles(raw.sparkSession):
            bad = violations_of_unique(rows, unique_on).take(1)
        if bad:
            raise AssertionError(f"readings repeat, for example {bad[0]}")
        named = group_identities(rows, "sample_id", "canonical", unique_on)
    labelled = label_activity(named, "molecule_id", "inhibition", "is_retest", alert, threshold)
    return labelled.withColumn("fp", fingerprint("canonical", radius, n_bits))


def training_table(master: DataFrame, k: int = 10, radius: int = 2, n_bits: int = 1024) -> DataFrame:
    """One row per molecule from its primary readings, with its fingerprint and a fold.

    The structure, and with it ``fp``, is that of the primary reading with the lowest number.
    """
    primary = master.filter("is_retest = 0")
    rows = collapse_primary(
        primary,
        "molecule_id",
        "duplicate_id",
        "inhibition",
        {"sample_ids": "sample_id", "library_ids": "library_id"},
        ["canonical", "activity", "primary_filter", "retest_filter", "alert_filter"],
        "inhibition_primary_median",
    )
    # Written, or both steps of the folds would collapse the readings again.
    folded = stratified_folds(materialize(rows, "molecules", codec="zstd"), "molecule_id", "activity", k)
    return folded.withColumn("fp", fingerprint("canonical", radius, n_bits))


def fold_totals(training: DataFrame) -> DataFrame:
    return training.groupBy("fold_id").agg(
        F.count("*").alias("total"), F.sum("activity").alias("active")
    )
