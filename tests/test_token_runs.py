"""Runs hashed in numpy against hashlib, packed bits against plain Python."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tamis.functions import bits, text, token_runs


def expected(tokens, radius, n_bits):
    found = set()
    for length in range(1, radius + 2):
        for i in range(len(tokens or []) - length + 1):
            run = " ".join(t for t in tokens[i : i + length] if t is not None)
            found.add(int(hashlib.md5(run.encode()).hexdigest()[:8], 16) % n_bits)
    return sorted(found)


def rows():
    rng = random.Random(7)
    words = ["", None, "a", "ä", "日本語" * 9, "y" * 53, "y" * 54, "y" * 55, "y" * 56, "y" * 64, "y" * 200]
    some = [[rng.choice(words) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    return [None, [], [""], [None], *some, [str(i) for i in range(token_runs.CHUNK_TOKENS + 5)]]


def test_runs_are_hashed_as_hashlib_does():
    tokens = pa.array(rows(), pa.list_(pa.string()))
    for radius, n_bits in ((0, 64), (1, 1000), (2, 1024)):
        got = token_runs.run_bits(tokens, radius, n_bits).to_pylist()
        assert got == [expected(t, radius, n_bits) for t in rows()]
    assert token_runs.run_bits(tokens.slice(3, 9), 2, 128).to_pylist() == [expected(t, 2, 128) for t in rows()[3:12]]
    assert token_runs.run_bits(tokens[:0], 2, 128).to_pylist() == []


def test_words_are_packed_and_read_back():
    places = [[], [0], [63, 64], [5, 127], list(range(128))]
    words = token_runs.pack(pa.array(places, pa.list_(pa.int32())), 128)
    value = lambda p, w: int("".join("1" if w * 64 + i in p else "0" for i in range(64)), 2)
    assert [[x % 2**64 for x in r] for r in words.to_pylist()] == [[value(p, 0), value(p, 1)] for p in places]
    assert token_runs.unpack(words, 2).to_pylist() == places
    odd = pa.array([None, [None, 1], [1]], pa.list_(pa.int64()))
    assert token_runs.unpack(odd, 2).to_pylist() == [[], [127], [63]]


def test_fingerprints_are_made_a_batch_at_a_time(spark, capsys):
    """Interpreted lambdas, a call per run, took three times as long."""
    df = spark.createDataFrame([("b a b",), (None,)], "s string")
    out = df.select(bits.pack_positions(text.hash_fp(F.split("s", " "), 1, 128), 128).alias("w"))
    out = out.select("w", bits.ones("w", 2).alias("p"))
    out.explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan
    assert [r.p for r in out.collect()] == [expected("b a b".split(), 1, 128), []]
