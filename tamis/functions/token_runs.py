"""Hashed token runs and packed bits of whole Arrow batches, in numpy.

The text of a run is a slice of the joined tokens, so runs are hashed where they
lie, thousands at a time, instead of being built one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = 64
BLOCK = 8192  # messages hashed at once
CHUNK_TOKENS, CHUNK_BITS = 1 << 16, 1 << 22  # of the rows worked on at once
ONE_BLOCK = 55  # bytes that fit one block of MD5 with their padding

SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "u4")  # by bytes of a word inside the message
CLOSING = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], "u4")  # the byte after the message


def _first_word(words: list[np.ndarray]) -> np.ndarray:
    """First word of the MD5 of messages of one block, ``words`` being its 16 words (RFC 1321)."""
    a, b, c, d = (np.full(len(words[0]), x, "u4") for x in START)
    f, low = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, SINES[i], out=a)
        np.add(a, words[g], out=a)
        turn = TURNS[i // 16][i % 4]
        np.right_shift(a, np.uint32(32 - turn), out=low)
        np.left_shift(a, np.uint32(turn), out=a)
        np.bitwise_or(a, low, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a + START[0]


def md5_heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First four bytes of the MD5 of slices of ``data`` (uint8), as big-endian numbers.

    ``data`` must go on for 64 bytes after the last slice.
    """
    shifted = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))  # the word at every byte
    out = np.empty(len(starts), "u4")
    for at in range(0, len(starts), BLOCK):
        start, size = starts[at : at + BLOCK], sizes[at : at + BLOCK]
        short = np.minimum(size, ONE_BLOCK)
        words = [np.zeros(len(start), "u4")] * 16
        for j in range(int(short.max()) // 4 + 1):
            left = short - 4 * j
            words[j] = shifted[start + 4 * j] & KEPT[np.clip(left, 0, 4)] | CLOSING[np.clip(left, -1, 4) + 1]
        words[14] = (short * 8).astype("u4")
        out[at : at + BLOCK] = _first_word(words).byteswap()
        for i in np.flatnonzero(size > ONE_BLOCK):
            message = data[start[i] : start[i] + size[i]].tobytes()
            out[at + i] = int.from_bytes(hashlib.md5(message).digest()[:4], "big")
    return out


def _pieces(offsets: np.ndarray, n_bits: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of tokens and bits, one row at least."""
    rows, low = max(1, CHUNK_BITS // n_bits), 0
    while low < len(offsets) - 1:
        full = int(np.searchsorted(offsets, offsets[low] + CHUNK_TOKENS, "right")) - 1
        high = min(max(full, low + 1), low + rows, len(offsets) - 1)
        yield low, high
        low = high


def _lists(bits: np.ndarray) -> pa.Array:
    """Positions of the ones of each row."""
    row, at = np.nonzero(bits)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(bits)))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(at.astype("i4")))


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def run_bits(tokens: pa.Array, radius: int, n_bits: int) -> pa.Array:
    """Positions of the hashes of all runs of 1 to ``radius`` + 1 tokens, ascending and distinct.

    A run's text has its tokens joined by one space; null tokens are left out of it.
    """
    offsets, strings = np.asarray(tokens.offsets).astype("i8"), tokens.values
    wide = "i8" if pa.types.is_large_string(strings.type) else "i4"
    edges = np.frombuffer(strings.buffers()[1] or bytes(8), wide)[strings.offset : strings.offset + len(strings) + 1]
    source = np.frombuffer(strings.buffers()[2] or b"", "u1")
    there = np.asarray(strings.is_valid()) if strings.null_count else np.ones(len(strings), bool)
    parts = []
    for low, high in _pieces(offsets, n_bits):
        first, last = offsets[low], offsets[high]
        edge, valid = edges[first : last + 1].astype("i8"), there[first:last]
        size = np.diff(edge)
        ends = np.cumsum(np.where(valid, size + 1, 0))
        begin = ends - np.where(valid, size + 1, 0)
        end = np.where(valid, begin + size, begin - 1)
        total = int(ends[-1]) if len(ends) else 0
        text = np.full(total + WORD, ord(" "), "u1")
        letters = np.ones(total, bool)
        letters[end[valid]] = False
        text[:total][letters] = source[edge[0] : edge[-1]]
        row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        bits = np.zeros((high - low, n_bits), bool)
        for more in range(min(radius + 1, len(row))):
            i = np.flatnonzero(row[: len(row) - more] == row[more:])
            heads = md5_heads(text, begin[i], np.maximum(end[i + more] - begin[i], 0))
            bits[row[i], heads % np.uint32(n_bits)] = True
        parts.append(_lists(bits))
    return _joined(parts)


def pack(positions: pa.Array, n_bits: int) -> pa.Array:
    """Lists of positions to lists of signed 64-bit words, first bit highest."""
    offsets, places = np.asarray(positions.offsets).astype("i8"), np.asarray(positions.values)
    parts = [np.empty(0, "i8")]
    for low, high in _pieces(offsets, n_bits):
        row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        bits = np.zeros((high - low, n_bits), bool)
        bits[row, places[offsets[low] : offsets[high]]] = True
        parts.append(np.packbits(bits, axis=1).view(">i8").astype("i8").ravel())
    words = np.concatenate(parts)
    ends = np.arange(0, len(words) + 1, n_bits // WORD, dtype="i4")
    missing = np.repeat(np.asarray(positions.is_null()), n_bits // WORD)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(words, mask=missing))


def unpack(words: pa.Array, n_words: int) -> pa.Array:
    """Positions of the ones of lists of words, ascending; a missing word has none."""
    rows = max(1, CHUNK_BITS // (n_words * WORD))
    parts = []
    for low in range(0, len(words), rows):
        some = words.slice(low, rows)
        offsets, flat = np.asarray(some.offsets).astype("i8"), some.values.fill_null(0)
        flat, sizes = np.asarray(flat), np.diff(offsets)
        table = np.zeros((len(some), n_words), "i8")
        row = np.repeat(np.arange(len(some)), sizes)
        at = np.arange(offsets[0], offsets[-1])
        column = at - np.repeat(offsets[:-1], sizes)
        inside = column < n_words
        table[row[inside], column[inside]] = flat[at[inside]]
        bits = np.unpackbits(table.astype(">i8").view("u1").reshape(len(some), -1), axis=1)
        parts.append(_lists(bits))
    return _joined(parts)
