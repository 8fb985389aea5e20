"""Text keys, token fingerprints and character codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from tamis.functions.token_runs import run_bits


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(text: str | Column) -> Column:
    """Join key of a structure: lower case, single spaces, no outer spaces."""
    # Single spaces, the most frequent by far, are not rewritten.
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[ \t\r\n]{2,}|[\t\r\n]", " "))


def strip_parts(text: str | Column, parts: Sequence[str], separator: str = ".") -> Column:
    """Remove the listed components of a multi-part text, keep the others."""
    pieces = F.split(_col(text), "\\Q" + separator + "\\E")
    return F.array_join(F.filter(pieces, lambda p: ~p.isin(list(parts))), separator)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, although used many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_fp(tokens: str | Column, radius: int, n_bits: int) -> Column:
    """Fold the hashed neighbourhoods up to ``radius`` into ``n_bits`` positions.

    Returns the sorted positions of the ones; no tokens have none.
    """
    return F.arrow_udf(lambda t: run_bits(t, radius, n_bits), "array<int>")(_col(tokens))


def encode_chars(text: str | Column, codes: Mapping[str, int]) -> Column:
    """Characters to dictionary numbers; a character outside the dictionary is an error."""
    table = F.create_map(*[F.lit(x) for x in chain(*codes.items())])

    def code(c: Column) -> Column:
        found = F.try_element_at(table, c)
        unknown = F.raise_error(F.concat(F.lit("unknown character: "), c)).cast("int")
        return F.coalesce(found, unknown)

    return F.transform(F.split(F.trim(_col(text)), ""), code)


def pad_left(sequence: str | Column, length: int) -> Column:
    """Fixed length: zeros in front of a short sequence, front of a long one cut."""
    sequence = _col(sequence)
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(sequence))
    kept = F.slice(sequence, F.greatest(F.lit(1), F.size(sequence) - (length - 1)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0), missing), kept)


def standardize(code: str | Column, table: Mapping[str, str], keep_unknown: bool = False) -> Column:
    """Replace codes by the dictionary's; an unknown one fails unless kept."""
    code = _col(code)
    lookup = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    other = code if keep_unknown else F.raise_error(F.concat(F.lit("unknown code: "), code)).cast("string")
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(lookup, code), other))
