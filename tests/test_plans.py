import os
import time

import pytest
from pyspark.sql import functions as F

from tamis.functions.text import canonical
from tamis.plans import prepare, screen
from tamis.session import work_folder
from tamis.sources import schemas


def reading(sample, structure, plate, well, value, lib="L1"):
    return (sample, structure, "b", lib, plate, well, "2018", value)


def test_raw_readings_to_training_rows(spark):
    rows = [
        reading("a", "X y", "P1", "w1", 60.0),
        reading("a", "x  Y", "P2", "w2", 50.0, "L2"),
        reading("b", "x y", "CP1", "w1", 70.0),
        reading("c", "z", "P1", "w3", 80.0),
        reading("d", "bad@", "P1", "w4", 90.0),
        reading("d", "bad@", "CP1", "w5", 90.0),
        reading("e", "q", "P1", "w6", -100.0),
    ]
    raw = spark.createDataFrame(rows, schemas.RAW_SCREEN)
    master = prepare.master_table(raw, F.col("canonical").contains("@").cast("int"))
    got = {(r.sample_id, r.plate_name): (r.molecule_id, r.activity) for r in master.collect()}
    assert got[("a", "P1")] == ("a", 1) == got[("b", "CP1")]
    assert got[("c", "P1")] == ("c", 0) and got[("d", "P1")] == ("d", 0) and ("e", "P1") not in got
    training = {r.molecule_id: r for r in prepare.training_table(master).collect()}
    assert set(training) == {"a", "c", "d"}
    assert (training["a"].library_ids, training["a"].inhibition_primary_median) == ("L1, L2", 55.0)
    with pytest.raises(AssertionError):
        prepare.master_table(raw.union(raw), F.lit(0))


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}


def test_preparation_leaves_little_on_disk(spark):
    """Readings, links and shuffles go as soon as the tables behind them are written."""
    rows = [reading(f"s{i % 40}", f"x{i % 30} y", "CP1" if i % 3 else "P1", f"w{i}", float(i % 90)) for i in range(300)]
    raw = spark.createDataFrame(rows, schemas.RAW_SCREEN)
    folder = work_folder(spark)
    os.makedirs(folder, exist_ok=True)
    tables, files = set(os.listdir(folder)), shuffle_files(spark)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    master = prepare.master_table(raw, F.lit(0))
    training = prepare.training_table(master)
    assert spark.conf.get(setting, None) == before
    left = {t.rsplit("-", 1)[0] for t in set(os.listdir(folder)) - tables if not t.startswith(".")}
    assert left <= {"named", "labels", "medians", "molecules", "large"}
    until = time.time() + 30  # the files are removed in the background
    while (more := shuffle_files(spark) - files) and time.time() < until:
        time.sleep(0.2)
    assert not more
    # What is left is enough to read the results, more than once.
    assert master.count() == 300 and training.count() == training.count() == 10


def test_training_rows_feed_the_rankers(spark):
    from tamis.models.rankers import SimilarityRanker

    words = ["red round box", "red round lid", "blue flat box", "blue flat lid", "green tall jar", "green tall cup"]
    rows = [reading(f"m{i}", f"{w}.HCl" if i % 2 else w, f"{p}{i}", "w", 90.0 if i < 2 else 5.0) for i, w in enumerate(words) for p in ("P", "CP")]
    raw = spark.createDataFrame([*rows, reading("m9", "Red  round BOX.HCl", "P9", "w", 90.0)], schemas.RAW_SCREEN)
    master = prepare.master_table(raw, F.lit(0), salts=["HCl"], radius=1, n_bits=128)
    assert master.filter("fp IS NULL OR size(fp) <> 2").isEmpty()
    training = prepare.training_table(master, 3, radius=1, n_bits=128)
    found = {r.molecule_id: r for r in training.collect()}
    assert set(found) == {f"m{i}" for i in range(6)} and found["m0"].sample_ids == "m0, m9"
    model = SimilarityRanker("fp", "molecule_id", "activity", 128).fit(training)
    scored = {r.molecule_id: r.score for r in model.transform(training).collect()}
    assert scored["m0"] == scored["m1"] == 1.0 and max(scored[f"m{i}"] for i in (4, 5)) < 0.2
    # Fingerprints are the same on readings and molecules.
    prints = {(r.canonical, tuple(r.fp)) for r in master.collect()}
    assert {(r.canonical, tuple(r.fp)) for r in found.values()} <= prints


def test_order_list_and_featurizer(spark):
    from tamis.functions.bits import pack_bits

    df = spark.createDataFrame(
        [(i, f"c{i % 3}", float(i), format(1 << i, "064b")) for i in range(9)], "id long, c string, s double, bits string"
    ).withColumn("fp", pack_bits("bits", 64))
    out = screen.order_list(df, [("low", F.col("s") < 8)], "c", "s", "id", "fp", 64, 2).collect()
    assert [r.id for r in out] == [7, 6]
    text = spark.createDataFrame([("A b",), ("a  B",)], "t string")
    prints = screen.with_words(screen.featurize(text, "t", 1, 128), 128).collect()
    assert prints[0].fp == prints[1].fp and len(prints[0].fp) == 2

    def upper(batches):
        for b in batches:
            yield b.assign(t=b["t"].str.upper())

    assert {r.t for r in screen.featurize_by(text, upper, "t string").collect()} == {"A B", "A  B"}
    assert text.select(canonical("t").alias("k")).distinct().count() == 1
