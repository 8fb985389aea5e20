import gzip

import pytest
from pyspark.sql import functions as F

from tamis.session import materialize, work_folder
from tamis.sources import readers, schemas, writers


def test_work_folder_is_the_named_one(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) is None or work_folder(spark).startswith(
        spark.conf.get("spark.checkpoint.dir")
    )
    df = materialize(spark.range(3).withColumn("v", F.lit("a")), "t")
    assert df.schema == spark.range(3).withColumn("v", F.lit("a")).schema or df.count() == 3


def test_merged_gzip_files_and_columns(spark, tmp_path):
    for i in range(3):
        with gzip.open(tmp_path / f"fold_{i}.csv.gz", "wt") as f:
            f.write("smiles,score\n" + "".join(f"c{i}{j},{j / 4}\n" for j in range(4)))
    paths = [str(tmp_path / f"fold_{i}.csv.gz") for i in (0, 2)]
    df = readers.read_merged(spark, paths, schemas.PREDICTIONS, ["score"])
    assert df.columns == ["score"] and df.count() == 8
    counts = readers.file_counts(readers.read_merged(spark, paths, schemas.PREDICTIONS), "score").collect()
    assert [(r.n_rows, r.n_scored) for r in counts] == [(4, 4), (4, 4)]


def test_smi_and_catalog(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO id1\n  CN id2 \nlonely\n")
    assert [tuple(r) for r in readers.read_smi(spark, str(tmp_path / "a.smi")).collect()] == [
        ("CCO", "id1"),
        ("CN", "id2"),
        ("lonely", None),
    ]
    (tmp_path / "v.tsv").write_text("smiles\tid\nCCO\t1\nCN\t2\n")
    assert [r.structure for r in readers.read_catalog(spark, str(tmp_path / "v.tsv")).collect()] == ["CCO", "CN"]


def test_empty_cells_stay_empty(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("name\tcontrol\tdose\nm1\t\t33\nm2\tDMSO\t33\nm3\t\t\n")
    df = readers.read_tsv(spark, str(tmp_path / "d.tsv"), "name string, control string, dose string")
    from tamis.operators.clean import at_dose

    assert [r.control for r in df.collect()] == ["", "DMSO", ""]
    assert [r.name for r in at_dose(df, "control", "dose").collect()] == ["m1"]


def test_metric_logs(spark, tmp_path):
    (tmp_path / "m_1_4.out").write_text(
        "test precision: 0.1\ntest roc: 0.5\nratio: 0.01, EF: 9.5,\tactive: 55.0\n\ntest roc: 0.75\nratio: 0.1, NEF: 0.3\n"
    )
    logs = readers.read_metric_logs(spark, str(tmp_path / "*.out"))
    row = logs.first()
    assert (row.test_precision, row.test_roc, row.test_nef, row.test_ef) == (0.1, 0.75, -1.0, 9.5)
    expected = logs.select("file").union(spark.createDataFrame([("absent",)], "file string"))
    rows = {r.file: r for r in readers.read_metric_logs(spark, str(tmp_path / "*.out"), expected).collect()}
    assert rows["absent"].test_roc == -1.0 and len(rows) == 2


def test_timing_logs(spark, tmp_path):
    (tmp_path / "a.out").write_text("start\nTotal time: 90.0 minutes for 524288 compounds\n")
    row = readers.read_timing_logs(spark, str(tmp_path / "*.out")).first()
    assert (row.minutes, row.rows, row.hours) == (90.0, 524288, 1.5)


def test_parts_and_export(spark, tmp_path):
    df = spark.range(103).withColumn("v", F.col("id") * 2)
    parts = writers.to_parts(df, 10, ["id"])
    writers.write_parts(parts, str(tmp_path / "parts"))
    sizes = [r["count"] for r in parts.groupBy("part").count().orderBy("part").collect()]
    assert sizes == [11, 11, 11] + [10] * 7
    assert len(list((tmp_path / "parts").glob("part=*"))) == 10
    out = writers.export(df, str(tmp_path / "x"), drop=["v"], rows=103, columns=2)
    assert out.columns == ["id"] and out.count() == 103
    with pytest.raises(AssertionError):
        writers.export(df, str(tmp_path / "y"), rows=5)


def test_schemas_parse(spark):
    for name in ("RAW_SCREEN", "MASTER", "TRAINING", "CATALOG_PART", "ORDER_RESULTS", "CLUSTERS", "COSTS", "DOSE_RESPONSE", "ALERT_RULES", "PROSPECTIVE_SCORES"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_cells_with_quotes_breaks_and_blanks(spark, tmp_path):
    import pandas as pd

    rows = [(1, 'say "x", y'), (2, "two\nlines"), (3, ""), (4, None), (5, " blanks "), (6, "back\\slash\\"), (7, '"')]
    df = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "ours")
    writers.write_table(df, path)
    back = readers.read_merged(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == rows
    seen = pd.concat(pd.read_csv(f, keep_default_na=False) for f in (tmp_path / "ours").glob("part-*.csv.gz"))
    assert sorted(zip(seen["id"], seen["text"])) == [(i, t or "") for i, t in rows]
    pd.DataFrame(rows, columns=["id", "text"]).to_csv(tmp_path / "theirs.csv", index=False)
    theirs = readers.read_merged(spark, str(tmp_path / "theirs.csv"), df.schema)
    assert sorted((r.id, r.text or "") for r in theirs.collect()) == [(i, t or "") for i, t in rows]
