"""Bit fingerprints: strings of 0/1 at rest, 64-bit words for bit algebra.

Word arithmetic is unrolled over the fixed word count, so it stays inside
whole-stage code generation; array lambdas would not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.text import once
from tamis.functions.token_runs import pack, unpack

WORD = 64


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def sign_bits(vector: str | Column) -> Column:
    """Float array to a bit string, 1 where the value is positive."""
    return F.array_join(F.transform(_col(vector), lambda x: F.when(x > 0, "1").otherwise("0")), "")


def pack_bits(bits: str | Column, n_bits: int) -> Column:
    """Bit string to an array of signed 64-bit words, first bit highest."""
    if n_bits % WORD:
        raise ValueError("n_bits must be a multiple of 64")
    word = lambda b, i: F.conv(F.substring(b, i + 1, WORD), 2, -10).cast("long")
    return once(_col(bits), lambda b: F.array(*[word(b, i) for i in range(0, n_bits, WORD)]))


def pack_positions(positions: str | Column, n_bits: int) -> Column:
    """Sorted positions of ones to packed words."""
    if n_bits % WORD:
        raise ValueError("n_bits must be a multiple of 64")
    return F.arrow_udf(lambda p: pack(p, n_bits), "array<bigint>")(_col(positions))


def ones(words: str | Column, n_words: int) -> Column:
    """Positions of the ones of packed words, ascending."""
    return F.arrow_udf(lambda w: unpack(w, n_words), "array<int>")(_col(words))


def bits_to_array(bits: str | Column) -> Column:
    return F.transform(F.split(_col(bits), ""), lambda b: b.cast("double"))


def bits_to_vector(bits: str | Column) -> Column:
    """Bit string to an ML vector."""
    return array_to_vector(bits_to_array(bits))


def set_bits(bits: str | Column) -> Column:
    """Bit string to the sorted positions of its ones."""
    chars = F.transform(F.split(_col(bits), ""), lambda b, i: F.when(b == "1", i))
    return F.array_compact(chars)


def positions_to_bits(positions: str | Column, n_bits: int) -> Column:
    """Sorted positions of ones to a bit string."""
    def runs(p: Column) -> Column:
        gap = lambda x, i: x - F.coalesce(F.get(p, i - 1), F.lit(-1)) - 1
        ones = F.transform(p, lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.lit("1")))
        return F.rpad(F.array_join(ones, ""), n_bits, "0")

    return once(_col(positions), runs)


def popcount(words: str | Column, n_words: int) -> Column:
    return _sum([F.bit_count(_col(words)[i]) for i in range(n_words)])


def tanimoto(a: str | Column, b: str | Column, n_words: int) -> Column:
    """Shared ones over ones in either; NULL when both are empty."""
    a, b = _col(a), _col(b)
    both = _sum([F.bit_count(a[i].bitwiseAND(b[i])) for i in range(n_words)])
    either = _sum([F.bit_count(a[i].bitwiseOR(b[i])) for i in range(n_words)])
    return F.when(either > 0, both.cast("double") / either)


def jaccard(a: str | Column, b: str | Column, n_words: int) -> Column:
    """Distance twin of ``tanimoto``."""
    return F.lit(1.0) - tanimoto(a, b, n_words)


def recode_bits(df: DataFrame, bits: str, mapping: DataFrame, out: str = "recoded") -> DataFrame:
    """Replace the bit at each position by the learned number for its value.

    ``mapping`` has one row per position: ``position, zero, one``. It is as long
    as a fingerprint, checked here, and travels to the rows as two arrays.
    """
    rows = mapping.select("position", "zero", "one").orderBy("position").collect()
    if [r.position for r in rows] != list(range(len(rows))):
        raise ValueError("mapping needs one row per position, 0..n-1")
    tables = {0: [r.zero for r in rows], 1: [r.one for r in rows]}
    zero, one = (F.array(*[F.lit(float(x)) for x in tables[v]]) for v in (0, 1))
    values = F.transform(
        F.split(F.col(bits), ""),
        lambda b, i: F.when(b == "1", F.get(one, i)).when(b == "0", F.get(zero, i)),
    )
    return df.withColumn(out, values)
