"""Byte-level BPE encoding and decoding with a local rank file.

The tokenizer library works per match of the split pattern, so a long text can
be cut wherever no match reaches across: before a single space between two
letters or digits. Pieces are encoded one after the other and their ids joined,
which bounds what the library holds at once and changes no id. Decoding gives
the raw bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tamis.llm.text import utf8

PIECE = 1 << 16  # characters from which a text is cut
_SAFE_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def encoding(path: str, pattern: str):
    """Encoder for a file of ``base64-bytes rank`` lines; no special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Parts of ``text``, at least ``size`` characters each but the last, cut at safe places."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode_text(encoder, text: str) -> list[int]:
    if len(text) <= PIECE:
        return encoder.encode_ordinary(text)
    return [i for piece in pieces(text) for i in encoder.encode_ordinary(piece)]


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` without its text, with the token ids of the whole text (``array<int>``).

    ``ranks`` is the rank file's path on every executor. A null text is empty
    and gives no ids; bytes that are no UTF-8 become U+FFFD first. Rows are
    independent, so repeated rows repeat their result; an empty table stays
    empty. A column called like ``name`` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, name)]
    held = []  # the task's encoder

    def each(body: bytes) -> array:
        if not held:
            held.append(encoding(ranks, pattern))
        return array("i", encode_text(held[0], body.decode("utf-8", "replace")))

    return docs.select(*keep, _row_wise(each, "array<int>")(utf8(F.col(text_col))).alias(name))


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", name: str = "bytes") -> DataFrame:
    """``encoded`` with the raw bytes that its ids stand for; null ids stand for none."""
    keep = [c for c in encoded.columns if c != name]
    held = []  # the task's decoder

    def each(ids: list[int] | None) -> bytes:
        if not held:
            held.append(encoding(ranks, pattern))
        return held[0].decode_bytes(ids) if ids else b""

    return encoded.select(*keep, _row_wise(each, "binary")(F.col(ids_col)).alias(name))


def _row_wise(each: Callable, kind: str) -> Callable[..., Column]:
    """``each`` as a function of columns, evaluated once a row however often its result is named.

    Rows reach the task's Python by the hundred. An Arrow batch has ten thousand,
    tens of MB of texts or ids, in the JVM and in Python, for the encoder and for
    the decoder of every task.
    """
    return F.udf(each, kind, useArrow=False).asNondeterministic()


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
