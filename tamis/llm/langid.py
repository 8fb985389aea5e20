"""Language identification with bit-sliced Bloom filters of n-grams.

One table of slots serves all languages: a slot holds a bit per language, so
the ``probes`` slots of an n-gram, combined by AND, give the mask of all
languages that (seem to) contain it. A text's n-grams are counted per language;
what a language's filter would answer by chance is taken off, and the largest
share decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tamis.llm.text import arrow_map, named, utf8

UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed odd multiplier (golden ratio)
# Bytes that are no letter become a space; bytes of multi-byte characters stay.
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def grams(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams of the lower-cased texts, and where each text's begin.

    Runs of non-letters count as one space; a text has a space before and after.
    """
    parts = [b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()) + b" " for t in texts]
    sizes = np.fromiter((max(0, len(p) - length + 1) for p in parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts) + b"\0" * length, np.uint8)
    total = len(raw) - length
    codes = np.zeros(total, np.uint64)
    for i in range(length):
        codes = (codes << np.uint64(8)) | raw[i : i + total]
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(total, bool)  # n-grams that reach into the next text do not count
    for back in range(1, length):
        at = ends - back
        inside[at[at >= 0]] = False
    return codes[inside], np.concatenate(([0], np.cumsum(sizes)))


def slots(codes: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    """The slots of each n-gram, from two halves of one hash."""
    h = codes * _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)  # fixed odd multiplier (splitmix64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    shift = np.uint64(64 - bits)
    return [((h + np.uint64(i) * step * _ODD) >> shift).astype(np.int64) for i in range(probes)]


class LanguageFilters:
    """Languages, the slot table in slices of up to 64 languages, and each filter's load."""

    def __init__(self, languages: list[str], slices: list[np.ndarray], bits: int, probes: int, length: int):
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(k).itemsize), np.uint64)
        self.languages, self.slices = languages, [s.astype(kind) for s in slices]
        self.bits, self.probes, self.length = bits, probes, length
        self.chance = np.array(
            [np.mean((slices[i // 64].astype(np.uint64) >> np.uint64(i % 64)) & np.uint64(1)) ** probes for i in range(len(languages))]
        )

    def hits(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per text and language, the n-grams that the filter contains."""
        at = slots(codes, self.bits, self.probes)
        out = np.zeros((len(starts) - 1, len(self.languages)), np.int64)
        for s, table in enumerate(self.slices):
            mask = table[at[0]]
            for more in at[1:]:
                mask &= table[more]
            for i in range(s * 64, min(len(self.languages), s * 64 + 64)):
                ones = np.concatenate(([0], np.cumsum((mask >> table.dtype.type(i % 64)) & table.dtype.type(1), dtype=np.int64)))
                out[:, i] = ones[starts[1:]] - ones[starts[:-1]]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (its share of all languages' corrected hits) of each text."""
        known = [t if t is not None and any(map(str.isalpha, t)) else "" for t in texts]
        codes, starts = grams(known, self.length)
        n = np.diff(starts)
        share = self.hits(codes, starts) / np.maximum(n, 1)[:, None]
        right = np.clip((share - self.chance) / np.maximum(1.0 - self.chance, 1e-9), 0.0, None)
        total = right.sum(axis=1)
        best = right.argmax(axis=1) if self.languages else np.zeros(len(texts), np.int64)
        names = [self.languages[b] if t and self.languages else UNKNOWN for t, b in zip(known, best, strict=True)]
        top = right[np.arange(len(texts)), best] if self.languages else np.zeros(len(texts))
        scores = np.where([name != UNKNOWN for name in names], top / np.where(total > 0, total, 1.0), 0.0)
        return names, np.clip(scores, 0.0, 1.0)


def fit_filters(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    length: int = 4,
    bits: int = 18,
    probes: int = 3,
    rows_per_language: int = 1000,
    least_share: float = 2e-5,
) -> LanguageFilters:
    """Filters from at most ``rows_per_language`` labelled rows of each language.

    A count per language sets the share of its rows to take; rows whose hash
    falls below it are taken, so that a rerun takes the same and only these rows
    are moved. An n-gram belongs to a language if it makes up ``least_share`` of the
    sample's n-grams there. Rows without text or language teach nothing. The
    table has ``2**bits`` slots, whatever the corpus.
    """
    rank = F.shiftrightunsigned(F.xxhash64(*[labelled[c] for c in labelled.columns]), 11) / F.lit(float(1 << 53))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), rank.alias("rank"))
    rows = rows.filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return LanguageFilters([], [np.zeros(1 << bits, np.uint64)], bits, probes, length)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, 1.1 * rows_per_language / r["count"])])
    near = rows.filter(F.col("rank") < F.element_at(shares, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("rank", "text")
    chosen = near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= rows_per_language)

    def count(key, table):
        codes, _ = grams(table["text"].to_pylist(), length)
        values, n = np.unique(codes, return_counts=True)
        often = n >= max(2.0, least_share * len(codes))
        packed = [values[often].tobytes()]
        return pa.table({"lang": [key[0].as_py()], "grams": pa.array(packed, pa.binary())})

    found = chosen.select("lang", "text").groupBy("lang").applyInArrow(count, "lang string, grams binary").collect()
    languages = sorted(r.lang for r in found)
    by = {r.lang: np.frombuffer(r.grams, np.uint64) for r in found}
    slices = []
    for s in range(0, max(1, len(languages)), 64):
        table = np.zeros(1 << bits, np.uint64)
        for i, lang in enumerate(languages[s : s + 64]):
            for at in slots(by[lang], bits, probes):
                table[at] |= np.uint64(1 << i)
        slices.append(table)
    return LanguageFilters(languages, slices, bits, probes, length)


def identify(
    docs: DataFrame, filters: LanguageFilters, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score"
) -> DataFrame:
    """``docs`` without its text, with the predicted language and a score from 0 to 1.

    The whole text is read and nothing else. A null text or one without a letter
    is ``und`` with score 0; so is every text if no language was learned. Ties
    go to the language that sorts first. Repeated rows repeat their result, an
    empty table stays empty.
    """
    plain = (filters.languages, filters.slices, filters.bits, filters.probes, filters.length)
    sent = docs.sparkSession.sparkContext.broadcast(plain)
    held = []  # the task's filters
    body = named(docs, "__body")
    keep = [c for c in docs.columns if c not in (text_col, lang_name, score_name)]

    def each(chunk) -> dict:
        if not held:
            held.append(LanguageFilters(*sent.value))
        names, scores = held[0].predict([t.decode("utf-8", "replace") for t in chunk.column(body).to_pylist()])
        return {lang_name: names, score_name: pa.array(scores)}

    rows = docs.select(*keep, utf8(F.col(text_col)).alias(body))
    return arrow_map(rows, each, f"`{lang_name}` string, `{score_name}` double", body, keep)


def fold(id_col: Column, folds: int = 5) -> Column:
    """Fold of a row by the CRC-32 of its id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(folds))
