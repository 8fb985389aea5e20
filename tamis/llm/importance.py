"""Draw documents that look like a target, by importance weights over hashed n-grams.

A text is brought to words with single spaces between them; ``finditer`` with
overlapping matches, between look-arounds for the words' edges, gives every run
of n words as one span, whose CRC32 is its bucket. Each task counts the buckets
of its texts; the totals of corpus and target give every bucket its gain, and a
document's weight is the mean gain of its n-grams. Noise drawn from the id turns
the weights into a sample without replacement: the highest scores are drawn.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamis.llm.text import arrow_map, in_chunks, named, utf8
from tamis.operators.order import positions
from tamis.session import materialize

BUCKETS = 10_000
MOST_KNOWN = 1 << 17  # n-grams that a task counts or remembers before it starts anew
LONGEST = 64  # bytes of an n-gram that is remembered


class Buckets(dict):
    """Bucket of each n-gram, remembered up to a bound."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, gram: bytes) -> int:
        found = crc32(gram) % self.buckets
        if len(gram) <= LONGEST:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[gram] = found
        return found


class Scanner:
    """The n-grams of a text, for n from 1 to ``order``, and their buckets."""

    def __init__(self, order: int, buckets: int):
        import regex

        self.bucket = Buckets(buckets)
        apart = [c for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha())]
        self.shown = bytes(32 if c in apart else c for c in range(256)).lower()
        self.gaps = regex.compile(rb" {2,}")
        word = rb"[^ ]++"
        self.runs = [regex.compile(rb"(?<![^ ])" + b" ".join([word] * n) + rb"(?![^ ])") for n in range(1, order + 1)]

    def joined(self, raw: bytes) -> bytes:
        """Words in lower case with one space between them."""
        return self.gaps.sub(b" ", raw.translate(self.shown)).strip(b" ")

    def spans(self, body: bytes, n: int) -> Iterator[bytes]:
        """All runs of ``n`` words of a text that ``joined`` has brought into shape."""
        return map(itemgetter(0), self.runs[n - 1].finditer(body, overlapped=True))

    def counts(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Buckets with their counts, each n-gram apart, and the number of words."""
        body, found, words = self.joined(raw), Counter(), 0
        for n in range(1, len(self.runs) + 1):
            found.update(self.spans(body, n))
            words = words or found.total()
        size = len(found)
        return np.fromiter(map(self.bucket.__getitem__, found), np.int64, size), np.fromiter(found.values(), np.int64, size), words


def bucket_counts(texts: DataFrame, text_col: str, order: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts. A row per bucket and task is shuffled."""

    def run(batches):
        scanner, total, found = Scanner(order, buckets), np.zeros(buckets, np.int64), Counter()

        def fold():
            for gram, n in found.items():
                total[scanner.bucket[gram]] += n
            found.clear()

        for chunk in in_chunks(batches, "body"):
            for raw in chunk.column("body").to_pylist():
                body = scanner.joined(raw)
                for n in range(1, order + 1):
                    found.update(scanner.spans(body, n))
                if len(found) > MOST_KNOWN:
                    fold()
        fold()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(utf8(F.col(text_col)).alias("body")).mapInArrow(run, "bucket long, n long")
    totals = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        totals[r.bucket] = r.n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, how much more the target holds of it: 1000 times the log ratio, floored."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = [
        (float(t) + 1.0) * float(s_all + buckets) / ((float(s) + 1.0) * float(t_all + buckets))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text_col: str = "text", order: int = 1) -> DataFrame:
    """``docs`` without its text, with ``n_words, n_features, weight``: the floored mean gain, 0 without n-grams."""
    body = named(docs, "body")
    own = [c for c in docs.columns if c not in (text_col, "n_words", "n_features", "weight")]
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    held = []

    def each(chunk) -> dict:
        if not held:
            held.append(Scanner(order, len(sent.value)))
        out = {"n_words": [], "n_features": [], "weight": []}
        for raw in chunk.column(body).to_pylist():
            at, n, words = held[0].counts(raw)
            size = int(n.sum())
            out["n_words"].append(words)
            out["n_features"].append(size)
            out["weight"].append(int(sent.value[at] @ n) // size if size else 0)
        return out

    rows = docs.select(*own, utf8(F.col(text_col)).alias(body))
    return arrow_map(rows, each, "n_words bigint, n_features bigint, weight bigint", body, own)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from 32 bits of a hash of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    order: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_features, weight, score, rank``, all but the id long.

    Of the N rows with ``least_words`` words or more, ``floor(percent * N / 100)``
    are drawn and ranked by score, ties by the smaller id (null first); ``rank``
    is null for the rest. A null text has no words and weighs 0. Rows that share
    an id share the noise; repeated rows have ranks of their own. An empty
    target leaves every bucket its share of the corpus, an empty ``docs`` gives
    an empty table. Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(texts, "text", order, buckets), bucket_counts(target, target_col, order, buckets))
    scored = weights(texts, gain, "text", order).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    out = F.when(F.col("n_words") >= least_words, 0).otherwise(1)
    scored = materialize(scored.withColumn("out", out), "weights")
    drawn = percent * scored.filter("out = 0").count() // 100
    placed = positions(scored, ["out", F.desc("score"), F.col("id").asc_nulls_first()], name="place")
    rank = F.when((F.col("out") == 0) & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))
