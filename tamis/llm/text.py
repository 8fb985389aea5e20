"""Expressions and task helpers shared by the text operators.

A word is a run of characters other than the six ASCII white-space characters,
which is what ``bytes.split`` returns in a task; A-Z alone are lower-cased,
which is what ``bytes.lower`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPACES = " \t\n\x0b\f\r"
_BREAK = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Array of words; empty for null and for white space only."""
    trimmed = F.trim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, _BREAK)).otherwise(none)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def in_chunks(batches: Iterable[pa.RecordBatch], column: str, chunk_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the binary ``column`` holds about ``chunk_bytes`` in each.

    A single longer value is a chunk of its own; nothing is cut inside a row.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > chunk_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a binary array of texts, one after the other, and each word's text."""
    import pyarrow.compute as pc

    texts = texts.view(pa.string())  # the kernels look at ASCII bytes only
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def byte_strings(array: pa.Array) -> list[bytes]:
    """The values of a string or binary array without nulls."""
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    data = array.buffers()[2].to_pybytes() if len(array) and array.buffers()[2] is not None else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def arrow_map(
    df: DataFrame,
    each: Callable[[pa.RecordBatch], dict],
    fields: str,
    chunk_on: str,
    keep: Iterable[str] = (),
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """Per chunk of rows, the columns ``keep`` as they are and what ``each`` makes of the chunk.

    ``chunk_on`` is a binary column; ``each`` returns an array or a list
    per name in ``fields``.
    """
    keep = list(keep)
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[k] for k in keep] + list(new))
    kinds = {f.name: _arrow_type(f.dataType) for f in new}

    def run(batches):
        import pyarrow.compute  # noqa: F401  loaded in the task

        for chunk in in_chunks(batches, chunk_on, chunk_bytes):
            made = each(chunk)
            arrays = [chunk.column(k) for k in keep]
            arrays += [v if isinstance(v := made[n], pa.Array) else pa.array(v, t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *kinds])

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def utf8(text: Column) -> Column:
    """The text's bytes as they are stored; null is empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def named(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
