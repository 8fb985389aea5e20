"""Scores of an n-gram language model kept in a log-frequency Bloom filter.

Counts of the training n-grams are gathered over the whole corpus: each task
folds its own, sends them as sorted runs of 64-bit keys per bucket, and a
bucket's runs are merged. A count is quantised to a level on a logarithmic
scale, and the pairs (n-gram, level) up to it are put into the bucket's segment
of one Bloom filter, which grows with the corpus: no n-gram is left out. Workers
get the filter by broadcast, in groups of segments of ``GROUP_BYTES`` at most;
the driver and a task hold one group at a time. Probing level after level until
one is missing gives an n-gram's count, and counts of each order are smoothed by
those of the order below.

The base score needs exact counts of words. Those of the ``table_size`` most
frequent words are broadcast; the other words of a text meet their counts in a
join, where no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamis.llm.text import arrow_map, byte_strings, in_chunks, named, split_words, utf8
from tamis.session import materialize

START, END = b" ", b"\n"  # no words
ROOT = 2.0  # a level's counts are this many times those of the level below
PROBES = 3
BITS_PER_PAIR = 8  # with 3 probes, about 3 % of absent pairs seem present
LONGEST = 64  # bytes of a word in the broadcast table
CHUNK = 1 << 20  # bytes of text that a task works on at once
GROUP_BYTES = 32 << 20  # of the filter, in one broadcast
GRAMS_PER_BUCKET = 1 << 19  # tokens of the corpus for each bucket
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B185EBCA87)  # fixed odd multipliers (XXH64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def hashes_of(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Tokens(NamedTuple):
    """Texts as token numbers, each ``START``, words, ``END``; and the distinct tokens by number."""

    numbers: np.ndarray
    place: np.ndarray  # of a token in its text
    sizes: np.ndarray
    distinct: list[bytes]
    hashes: np.ndarray  # of each distinct token

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        words, owner = split_words(texts, lower=True)
        coded = words.dictionary_encode()
        size = np.bincount(owner, minlength=len(texts)) + 2
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        last = place == np.repeat(size, size) - 1
        numbers = np.zeros(len(place), np.int32)
        numbers[last] = 1
        numbers[(place > 0) & ~last] = coded.indices.to_numpy() + 2
        distinct = [START, END, *byte_strings(coded.dictionary)]
        return cls(numbers, place, size, distinct, hashes_of(distinct))

    def grams(self, order: int) -> Iterator[np.ndarray]:
        """Keys of the n-grams that end at each token, for n = 1 to ``order``.

        Where a text has fewer tokens before, the key means nothing; see ``place``.
        """
        h = key = self.hashes[self.numbers]
        yield mix(h)
        for _ in range(order - 1):
            key = mix(np.concatenate((key[:1], key[:-1])) * _A + h)
            yield key


class Levels(NamedTuple):
    """Per order, the least level kept, the mean count of each level, and the share of the mass kept."""

    least: list[int]
    mean: list[np.ndarray]
    kept: list[float]


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for every factor of ``ROOT``."""
    return np.floor(np.log2(counts) / math.log2(ROOT) + 1e-9).astype(np.int64) + 1


def word_counts(docs: DataFrame, text_col: str, most_held: int = 1 << 18) -> DataFrame:
    """``word, n`` over all tokens, each text's end included."""

    def run(batches):
        held: list[pa.Table] = []

        def fold() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for chunk in in_chunks(batches, "body", CHUNK):
            words, _ = split_words(chunk.column("body"), lower=True)
            found = words.view(pa.binary()).value_counts()
            ends = pa.table({"word": pa.array([END], pa.binary()), "n": [chunk.num_rows]})
            held += [pa.table({"word": found.field(0), "n": found.field(1)}), ends]
            if sum(t.num_rows for t in held) > most_held:
                held[:] = [fold()]
                if held[0].num_rows > most_held // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from fold().to_batches()

    folded = docs.select(utf8(F.col(text_col)).alias("body")).mapInArrow(run, "word binary, n long")
    return folded.groupBy("word").agg(F.sum("n").alias("n"))


def _runs(keys: np.ndarray, counts: np.ndarray, order: int, buckets: int) -> pa.RecordBatch:
    """Sorted keys and their counts as a row per bucket."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    cuts = np.searchsorted(keys >> shift, np.arange(buckets + 1)) if buckets > 1 else np.array([0, len(keys)])
    some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some, pa.int32()),
            pa.array([order] * len(some), pa.int32()),
            pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()),
            pa.array([counts[cuts[b] : cuts[b + 1]].astype(np.int64).tobytes() for b in some], pa.binary()),
        ],
        names=["bucket", "order", "keys", "counts"],
    )


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    at = np.argsort(k, kind="stable")
    k, n = k[at], n[at]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(n, first) if len(first) else n)


def gram_runs(docs: DataFrame, text_col: str, order: int, buckets: int, most_held: int = 1 << 19) -> DataFrame:
    """Counted n-grams of two or more tokens, as runs per task, bucket and order."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {o: ([], []) for o in range(2, order + 1)}

        def flush(o: int):
            keys, counts = _merged(*held[o])
            held[o] = ([], [])
            return _runs(keys, counts, o, buckets)

        for chunk in in_chunks(batches, "body", CHUNK):
            tokens = Tokens.of(chunk.column("body"))
            for o, keys in enumerate(tokens.grams(order), 1):
                if o == 1:
                    continue
                found, n = np.unique(keys[tokens.place >= o - 1], return_counts=True)
                held[o][0].append(found)
                held[o][1].append(n.astype(np.int32))
            del tokens, keys
            for o, (keys_held, _) in held.items():
                if sum(map(len, keys_held)) > most_held:
                    yield flush(o)
        for o in held:
            if held[o][0]:
                yield flush(o)

    rows = docs.select(utf8(F.col(text_col)).alias("body"))
    return rows.mapInArrow(run, "bucket int, order int, keys binary, counts binary")


def word_runs(vocabulary: DataFrame, buckets: int) -> DataFrame:
    """The words of the vocabulary in the form of ``gram_runs``, as order 1."""

    def run(batches):
        for batch in batches:
            h = hashes_of(byte_strings(batch.column("word")))
            yield _runs(*_merged([mix(h)], [batch.column("n").to_numpy()]), 1, buckets)

    return vocabulary.mapInArrow(run, "bucket int, order int, keys binary, counts binary")


def merge_runs(runs: DataFrame, least_count: list[int]) -> DataFrame:
    """Per bucket and order: keys with their levels from ``least_count[order - 1]`` on, and sums per level."""

    def run(key, group):
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
        counts = [np.frombuffer(c, np.int64) for c in group["counts"].to_pylist()]
        found, n = _merged(keys, counts)
        levels = level_of(n)
        kept = n >= least_count[key[1].as_py() - 1]
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int32()),
                "order": pa.array([key[1].as_py()], pa.int32()),
                "keys": pa.array([found[kept].tobytes()], pa.binary()),
                "levels": pa.array([levels[kept].astype(np.uint8).tobytes()], pa.binary()),
                "grams": pa.array([np.bincount(levels).tolist()], pa.list_(pa.int64())),
                "mass": pa.array([np.bincount(levels, n).astype(np.int64).tolist()], pa.list_(pa.int64())),
            }
        )

    fields = "bucket int, order int, keys binary, levels binary, grams array<long>, mass array<long>"
    return runs.groupBy("bucket", "order").applyInArrow(run, fields)


def choose_levels(merged: DataFrame, order: int, least_count: list[int]) -> tuple[Levels, int]:
    """Levels of all n-grams seen as often as ``least_count`` says for their order, and the number of pairs."""
    sums = merged.select("order", F.posexplode(F.arrays_zip("grams", "mass")).alias("level", "at"))
    rows = sums.groupBy("order", "level").agg(F.sum("at.grams").alias("grams"), F.sum("at.mass").alias("mass")).collect()
    top = max([r.level for r in rows], default=0) + 1
    grams, mass = np.zeros((order, top + 1)), np.zeros((order, top + 1))
    for r in rows:
        grams[r.order - 1, r.level], mass[r.order - 1, r.level] = r.grams, r.mass
    least = [int(level_of(np.array([c]))[0]) for c in least_count]
    pairs = sum(int(grams[o, level]) * (level - least[o] + 1) for o in range(order) for level in range(least[o], top + 1))
    mean = [mass[o] / np.maximum(grams[o], 1.0) for o in range(order)]
    kept = [mass[o, least[o] :].sum() / max(mass[o].sum(), 1.0) for o in range(order)]
    return Levels(least, mean, kept), pairs


class Filter:
    """A Bloom filter in one segment per bucket, or some of its segments from bucket ``first`` on."""

    def __init__(self, bits: np.ndarray, buckets: int, segment: int, first: int = 0):
        self.bits, self.buckets, self.segment, self.first = bits, buckets, segment, first  # segment: bits of a bucket

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        if self.buckets == 1:
            return np.zeros(len(keys), np.int64)
        return (keys >> np.uint64(64 - (self.buckets.bit_length() - 1))).astype(np.int64)

    def probes(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """State of the key's first probe and the step to the next."""
        h = mix(keys + np.uint64(level * int(_A) % (1 << 64)))
        return h, mix(h + _A) | np.uint64(1)

    def spots(self, h: np.ndarray) -> np.ndarray:
        """Places inside a segment: the state's upper half as a share of the segment's length."""
        return (((h >> np.uint64(32)) * np.uint64(self.segment)) >> np.uint64(32)).astype(np.int64)

    def contains(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Indices of the keys that are found at the level; most that are absent fail the first probe."""
        alive = np.arange(len(keys))
        h, step = self.probes(keys, level)
        base = (self.bucket(keys) - self.first) * self.segment
        for _ in range(PROBES):
            at = base + self.spots(h)
            set_ = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            alive, base, h, step = alive[set_], base[set_], h[set_], step[set_]
            h = h + step
        return alive

    def counts(self, keys: np.ndarray, order: int, levels: Levels) -> np.ndarray:
        """Estimated counts: the mean of the last level that each key is found at, 0 if none."""
        out = np.zeros(len(keys))
        alive = np.arange(len(keys))
        mean = levels.mean[order - 1]
        for level in range(levels.least[order - 1], len(mean)):
            if not len(alive):
                break
            alive = alive[self.contains(keys[alive], level)]
            out[alive] = mean[level]
        return out


class Filters:
    """The whole filter as broadcast groups of ``per_group`` segments; a task holds one of them at a time."""

    def __init__(self, sent: list, buckets: int, segment: int, per_group: int, levels: Levels):
        self.sent, self.buckets, self.segment, self.per_group, self.levels = sent, buckets, segment, per_group, levels

    def counts(self, asked: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
        """Estimated counts of each array of keys, whose order is given with it."""
        out = [np.zeros(len(keys)) for keys, _ in asked]
        for g, broadcast in enumerate(self.sent):
            own = Filter(broadcast.value, self.buckets, self.segment, g * self.per_group)
            for (keys, order), found in zip(asked, out, strict=True):
                here = np.flatnonzero(own.bucket(keys) // self.per_group == g) if len(self.sent) > 1 else slice(None)
                found[here] = own.counts(keys[here], order, self.levels)
            if len(self.sent) > 1:
                vars(broadcast).pop("_value", None)  # read again for the next chunk instead of kept
        return out


def send_groups(bits: DataFrame, buckets: int, segment: int, group_bytes: int) -> tuple[list, int]:
    """Broadcasts of the written segments, and the number of segments in each."""
    spark = bits.sparkSession
    per_group = max(1, group_bytes // (segment // 8))
    sent = []
    for first in range(0, buckets, per_group):
        own = np.zeros((min(per_group, buckets - first), segment // 8), np.uint8)
        rows = bits.filter((F.col("bucket") >= first) & (F.col("bucket") < first + per_group))
        for part in rows.toArrow().to_batches():
            for bucket, raw in zip(part["bucket"].to_pylist(), part["bits"], strict=True):
                own[bucket - first] = np.frombuffer(raw.as_buffer(), np.uint8)
        sent.append(spark.sparkContext.broadcast(own.reshape(-1)))
    return sent, per_group


def segments(merged: DataFrame, least: list[int], segment: int) -> DataFrame:
    """``bucket, bits``: the filter's segment of each bucket."""

    def run(key, group):
        bits = np.zeros(segment, np.uint8)
        own = Filter(bits, 1, segment)
        for o, raw_keys, raw_levels in zip(*(group[c].to_pylist() for c in ("order", "keys", "levels")), strict=True):
            keys, levels = np.frombuffer(raw_keys, np.uint64), np.frombuffer(raw_levels, np.uint8)
            for level in range(least[o - 1], int(levels.max(initial=0)) + 1):
                h, step = own.probes(keys[levels >= level], level)
                for _ in range(PROBES):
                    bits[own.spots(h)] = 1
                    h = h + step
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    rows = merged.select("bucket", "order", "keys", "levels")
    return rows.groupBy("bucket").applyInArrow(run, "bucket int, bits binary")


def score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    least_count: tuple[int, ...] = (1, 1, 1, 1),
    prior: float = 40.0,
    table_size: int = 1 << 17,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``docs`` without its text, with the model's score of every whole text.

    Adds ``n_tokens, n_known, train_tokens`` (long) and ``base_score, score``
    (double): the log10 probability of the tokens by smoothed word frequencies
    and by the n-gram model of the rows where ``train`` holds. Tokens are the
    words with A-Z lower-cased and an end, so a null text has one. By default
    every n-gram is kept; with ``least_count`` above 1 the share of the mass of
    rarer ones goes to the order below, and ``prior`` words of it besides. Repeated rows
    repeat their scores; without training rows every token is unknown; an empty
    table stays empty. Columns of ``docs`` with the names above are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in (text_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    training = docs.filter(F.coalesce(train, F.lit(False))).select(text_col)
    vocabulary = materialize(word_counts(training, text_col), "vocabulary")
    total, distinct = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.count("*")).first())
    ends = vocabulary.filter(F.col("word") == F.lit(END)).select("n").collect()
    n_texts = int(ends[0].n) if ends else 0

    buckets = 1 << max(4, (total // GRAMS_PER_BUCKET).bit_length())
    least = list(least_count[:order])
    runs = word_runs(vocabulary, buckets)
    if order > 1:
        runs = runs.unionByName(gram_runs(training, text_col, order, buckets))
    merged = materialize(merge_runs(runs, least), "grams")
    levels, pairs = choose_levels(merged, order, least)
    segment = max(64, -(-pairs * BITS_PER_PAIR // buckets // 8) * 8)
    bits = materialize(segments(merged, levels.least, segment), "segments")
    sent, per_group = send_groups(bits, buckets, segment, group_bytes)
    chunk_bytes = CHUNK * min(16, len(sent))

    frequent = vocabulary.filter(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(table_size)
    top = frequent.select("word", "n").toArrow()
    table = spark.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)))
    scale = math.log10(total + 0.5 * (distinct + 1))
    filters = Filters(sent, buckets, segment, per_group, levels)

    def logs_of(tokens: Tokens) -> np.ndarray:
        return _log_probabilities(tokens, filters, order, n_texts, total, distinct, prior)

    def each(texts: pa.Array, tail_name: str) -> dict:
        tokens = Tokens.of(texts)
        known = np.array([table.value.get(w, -1) for w in tokens.distinct], np.int64)[tokens.numbers]
        scored = tokens.place > 0
        starts = np.cumsum(tokens.sizes) - tokens.sizes
        logs = np.where(scored & (known >= 0), np.log10(np.maximum(known, 0) + 0.5) - scale, 0.0)
        owner = np.repeat(np.arange(len(starts)), tokens.sizes)
        rare = scored & (known < 0)
        pairs, n = np.unique(owner[rare] * len(tokens.distinct) + tokens.numbers[rare], return_counts=True)
        texts_of, numbers = np.divmod(pairs, len(tokens.distinct))
        tail = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(texts_of, np.arange(len(starts) + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(tokens.distinct, pa.binary()).take(pa.array(numbers)), pa.array(n)], ["word", "n"]),
        )
        return {
            "n_tokens": tokens.sizes - 1,
            "n_known": np.add.reduceat((scored & (known > 0)).astype(np.int64), starts),
            "base_score": np.add.reduceat(logs, starts),
            "score": np.add.reduceat(np.where(scored, logs_of(tokens), 0.0), starts),
            tail_name: tail,
        }

    row, tail_name, body = named(docs, "row"), named(docs, "tail"), named(docs, "body")
    made = [("n_tokens", "bigint"), ("n_known", "bigint"), ("base_score", "double"), ("score", "double")]
    fields = ", ".join(f"{n} {t}" for n, t in made) + f", {tail_name} array<struct<word:binary,n:bigint>>"
    rows = docs.select(*own, utf8(F.col(text_col)).alias(body))
    heads = arrow_map(rows, lambda chunk: each(chunk.column(body), tail_name), fields, body, own, chunk_bytes=chunk_bytes)
    heads = materialize(heads.withColumn(row, F.monotonically_increasing_id()), "scored")

    words = heads.select(F.col(row).alias("row"), F.explode(tail_name).alias("at")).select("row", "at.word", "at.n")
    counts = vocabulary.withColumnRenamed("n", "count")
    log = F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.5)) - F.lit(scale)
    rest = (
        words.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * log).alias("more"), F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("found"))
    )
    zero = F.lit(0).cast("long")
    return heads.join(rest, heads[row] == rest["row"], "left").select(
        *[heads[c] for c in own],
        heads["n_tokens"],
        (heads["n_known"] + F.coalesce("found", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (heads["base_score"] + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        heads["score"],
    )


def _log_probabilities(tokens, filters, order, n_texts, total, distinct, prior) -> np.ndarray:
    """Log10 probability of each token after those before it in its text."""
    asked, have = [(mix(tokens.hashes), 1)], []
    for o, keys in enumerate(tokens.grams(order), 1):
        if o > 1:
            have.append(tokens.place >= o - 1)
            asked.append((keys[have[-1]], o))
    words, *longer = filters.counts(asked)
    words[0] = n_texts
    below = words[tokens.numbers]  # counts of the n-grams of the order below that end at each token
    chance = (below + 0.5) / (total + 0.5 * (distinct + 1))
    for o, (there, found) in enumerate(zip(have, longer, strict=True), 2):
        counts = np.zeros(len(there))
        counts[there] = found
        context = np.concatenate(([0.0], below[:-1]))
        left = prior + (1.0 - filters.levels.kept[o - 1]) * context
        better = (np.minimum(counts, context) + left * chance) / (context + prior)
        chance = np.where(there, np.minimum(better, 1.0), chance)
        below = counts
    return np.log10(chance)
