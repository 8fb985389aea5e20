import pytest
from pyspark.sql import functions as F

from tamis.functions import rows, text
from tamis.operators import rules

RULES = [(1, "A", "[0-9]{3,}", 0, "digits"), (2, "A", "@", 0, "at sign"), (3, "B", "x", 1, "ex"), (4, None, "y", 0, "half")]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(RULES, "rule_id int, rule_set_name string, pattern string, max int, description string")


def test_first_failing_rule_wins(spark, catalog):
    df = spark.createDataFrame([("a@b 1234", 1), ("a@b", 2), ("x x", 3), ("x", 4), (None, 5)], "t string, d int")
    out = rules.apply_rules(df, "t", catalog, descriptors=["d"]).collect()
    assert [r.alert for r in out] == ["digits > 0", "at sign > 0", "ex > 1", "OK", "INVALID"]
    assert [r.d for r in out] == [1, 2, 3, 4, -999]


def test_switches_choose_rule_sets(spark, catalog):
    switches = '{"MW": [0, 500], "Rule_A": false, "Rule_B": true}'
    assert [r.rule_id for r in rules.enabled_rules(catalog, switches).collect()] == [3]
    assert rules.ranges_of(spark, switches) == {"MW": (0.0, 500.0)}


def test_any_match(spark):
    df = spark.createDataFrame([("A License",), ("plain",)], "t string")
    assert [r[0] for r in df.select(rules.any_match("t", ["(?i)license", "@"])).collect()] == [1, 0]


def test_text_functions(spark):
    df = spark.createDataFrame([("  A \n b\tC ", "salt.main.salt.other")], "t string, p string")
    row = df.select(text.canonical("t").alias("c"), text.strip_parts("p", ["salt"]).alias("p")).first()
    assert (row.c, row.p) == ("a b c", "main.other")


def test_encode_and_pad(spark):
    df = spark.createDataFrame([("abc",), ("a",)], "s string")
    codes = text.encode_chars("s", {"a": 1, "b": 2, "c": 3})
    got = df.select(text.pad_left(codes, 2).alias("n"), text.pad_left(codes, 4).alias("w")).collect()
    assert [(r.n, r.w) for r in got] == [([2, 3], [0, 1, 2, 3]), ([0, 1], [0, 0, 0, 1])]
    with pytest.raises(Exception, match="unknown character"):
        df.select(text.encode_chars("s", {"a": 1})).collect()


def test_hash_fp_of_short_and_long_texts(spark):
    import hashlib

    df = spark.createDataFrame([("one",), ("one two three two",)], "s string")
    got = [r[0] for r in df.select(text.hash_fp(F.split("s", " "), 1, 256)).collect()]
    code = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 256
    words = "one two three two".split()
    runs = words + [" ".join(p) for p in zip(words, words[1:])]
    assert got == [[code("one")], sorted({code(s) for s in runs})]


def test_tensor_is_flattened_column_major(spark):
    import numpy as np

    cube = np.arange(24, dtype=float).reshape(3, 4, 2)
    df = spark.createDataFrame([(cube.tolist(),)], "t array<array<array<double>>>")
    got = df.select(rows.flatten_tensor("t", 2).alias("a"), rows.flatten_tensor("t", 2, True).alias("b")).first()
    assert got.a == cube[:2].reshape(-1, order="F").tolist()
    assert got.b == cube[:2].sum(-1).reshape(-1, order="F").tolist()


def test_recode_needs_every_position(spark):
    from tamis.functions.bits import recode_bits

    df = spark.createDataFrame([("10",)], "b string")
    mapping = spark.createDataFrame([(0, 0.5, 1.5), (1, -1.0, 1.0)], "position int, zero double, one double")
    assert recode_bits(df, "b", mapping).first().recoded == [1.5, -1.0]
    with pytest.raises(ValueError):
        recode_bits(df, "b", mapping.filter("position = 1"))
