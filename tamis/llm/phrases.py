"""Phrases of each language whose words occur together more often than their parts suggest.

Counts of word runs are kept in weighted acyclic automata that read the
language, then the words. Tasks build one per prefix range from their own
sorted n-grams; those of a range meet in a shuffle, are united and their
weights summed, and what is too rare is left out. Ranges are cut where the
words' counts say that a range is full; a first word that fills several is
divided by its second. An n-gram is only counted where everything shorter in it
is frequent: words first, then pairs, then all longer ones. What is known to be
frequent goes to the tasks as a bit set of bounded size, which may let more
through and never less.

The parts of a phrase are looked up by composing it with two automata: reading
it forward meets the counts of all its beginnings, reading it backward, in an
automaton of reversed n-grams, those of all its ends. The arcs that leave its
last state are the phrases with one word more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tamis.llm.lm import mix
from tamis.llm.text import byte_strings, in_chunks, split_words, utf8
from tamis.llm.transducer import NONE, Transducer, folded, levels, union
from tamis.operators.order import positions, running_totals
from tamis.session import materialize

UNKNOWN = "und"  # language of texts without one
RANGE = 1 << 19  # word occurrences that a prefix range stands for
MOST_RANGES = 1 << 20
MOST_BITS = 1 << 27  # of the bit set of frequent n-grams: 16 MB
HELD = 1 << 19  # n-grams that a task holds before it sends them
_UPPER, _BREAKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
_SHOWN = np.frombuffer(bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + b"\n" * len(_BREAKS) + b" "), np.uint8)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)  # fixed odd multiplier (XXH64)
_DUMP = "slot long, automaton binary"


class Words(NamedTuple):
    """The words of some texts: numbers of (language, word), and whether a piece begins."""

    numbers: np.ndarray
    begins: np.ndarray
    langs: list[bytes]  # of each number
    words: list[bytes]

    @classmethod
    def of(cls, langs: pa.Array, texts: pa.Array) -> Words:
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        ends = ends - ends[:1] if len(ends) else np.zeros(1, np.int32)
        raw = b"".join(byte_strings(texts))
        data = _SHOWN[np.frombuffer(raw, np.uint8)]
        shown = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        found, owner = split_words(shown)
        breaks = data == 10
        inside = ~breaks & (data != 32)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[ends[:-1][np.diff(ends) > 0]] = inside[ends[:-1][np.diff(ends) > 0]]
        piece = np.cumsum(breaks)[first]
        begins = np.ones(len(piece), bool)
        begins[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
        coded, lang = found.view(pa.binary()).dictionary_encode(), langs.dictionary_encode()
        words, names = byte_strings(coded.dictionary), [str(x).encode() for x in lang.dictionary.to_pylist()]
        both = lang.indices.to_numpy()[owner].astype(np.int64) * len(words) + coded.indices.to_numpy()
        seen = np.zeros(len(words) * len(names), bool)
        seen[both] = True
        some = np.flatnonzero(seen)
        number = np.cumsum(seen) - 1
        return cls(
            number[both], begins, [names[i] for i in (some // max(len(words), 1)).tolist()], [words[i] for i in (some % max(len(words), 1)).tolist()]
        )


def word_keys(langs: list[bytes], words: list[bytes]) -> np.ndarray:
    import xxhash

    seeds = {lang: xxhash.xxh64_intdigest(lang) for lang in set(langs)}
    hashed = (xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in zip(langs, words, strict=True))
    return np.fromiter(hashed, np.uint64, len(words))


def longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of n-grams with one more word."""
    return mix(keys * _STEP + words)


class BitSet:
    """Keys of frequent n-grams; says yes for all of them and a few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_set(grams: DataFrame) -> BitSet:
    """From ``lang, words``: 32 bits for each n-gram, ``MOST_BITS`` at most."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (32 * grams.count()).bit_length()))

    def run(batches):
        for batch in batches:
            langs, words = batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("words").to_pylist()
            keys = word_keys(langs, [w[0] for w in words])
            rest = [word_keys(langs, [w[n] for w in words]) for n in range(1, len(words[0]))] if words else []
            for more in rest:
                keys = longer(keys, more)
            at = np.unique(mix(keys) & np.uint64(size - 1)).astype(np.int64)
            bits = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
            first = np.flatnonzero(np.concatenate(([True], at[1:] >> 6 != at[:-1] >> 6))) if len(at) else at
            masks = np.bitwise_or.reduceat(bits, first) if len(at) else bits
            yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6), pa.array(masks.view(np.int64))], names=["block", "bits"])

    rows = grams.select("lang", F.transform("words", lambda w: w.cast("binary")).alias("words"))
    blocks = rows.mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[blocks["block"].to_numpy()] = blocks["bits"].to_numpy()
    return BitSet(out.view(np.uint8))


class Ranges:
    """Prefix ranges of n-grams: the words that end them, and how many ranges each of these fills."""

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.ends = [c for c, _ in cuts]
        self.width = [n for _, n in cuts] + [1]
        self.first = np.cumsum([0, *self.width]).tolist()

    def find(self, langs: list[bytes], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First range of each word, and the number of ranges it fills."""
        first, width = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        for i, key in enumerate(map(b"\0".join, zip(langs, words, strict=True))):
            at = bisect_left(self.ends, key)
            first[i] = self.first[at]
            if at < len(self.ends) and self.width[at] > 1 and self.ends[at] == key:
                width[i] = self.width[at]
        return first, width


def prefix_ranges(words: DataFrame) -> Ranges:
    """From ``lang, word, n``: a row per full range visits the driver, ``MOST_RANGES`` at most."""
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    step = max(RANGE, total // MOST_RANGES)
    ordered = running_totals(words, ["lang", "word"], {"upto": "n"})
    full = (F.floor(F.col("upto") / step) - F.floor((F.col("upto") - F.col("n")) / step)).cast("long")
    cuts = ordered.select("lang", "word", full.alias("full")).filter("full > 0").collect()
    return Ranges(sorted((r.lang.encode() + b"\0" + bytes(r.word), r.full) for r in cuts))


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` from ``lang, body``; equal words of a task are folded."""

    def run(batches):
        held: list[pa.Table] = []

        def fold() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])

        for chunk in in_chunks(batches, "body"):
            words = Words.of(chunk.column("lang"), chunk.column("body"))
            n = np.bincount(words.numbers, minlength=len(words.words))
            columns = [pa.array(words.langs, pa.binary()).view(pa.string()), pa.array(words.words, pa.binary()), pa.array(n)]
            held.append(pa.table(columns, names=["lang", "word", "n"]))
            if sum(t.num_rows for t in held) > HELD:
                held[:] = [fold()]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from fold().to_batches()

    return texts.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dumped(words: list[bytes], rows: np.ndarray, counts: np.ndarray, ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """Automata of sorted distinct rows (language, words), one per prefix range.

    A single word that fills several ranges is in each of them.
    """
    langs, firsts = rows[:, 0].astype(np.int64), rows[:, 1]
    seconds = rows[:, 2] if rows.shape[1] > 2 else np.zeros(len(rows), np.int64)
    pairs, at = np.unique(langs * (len(words) + 1) + firsts, return_inverse=True)
    heads = [words[i - 1] for i in (pairs // (len(words) + 1)).tolist()], [words[i - 1] for i in (pairs % (len(words) + 1)).tolist()]
    first, width = (x[at] for x in ranges.find(*heads))
    share = np.zeros(len(rows), np.int64)
    wide = np.flatnonzero(width > 1)
    if len(wide):
        some, back = np.unique(seconds[wide], return_inverse=True)
        keys = word_keys([b""] * len(some), [words[i - 1] if i else b"" for i in some.tolist()])
        share[wide] = (mix(keys)[back] % width[wide].astype(np.uint64)).astype(np.int64)
    alone = np.flatnonzero((width > 1) & (seconds == NONE))
    copies = np.repeat(alone, width[alone])
    spread = np.arange(len(copies)) - np.repeat(np.cumsum(width[alone]) - width[alone], width[alone])
    rest = np.setdiff1d(np.arange(len(rows)), alone)
    slot = np.concatenate((first[rest] + share[rest], first[copies] + spread))
    source = np.concatenate((rest, copies))
    order = np.lexsort((source, slot))
    slot, source = slot[order], source[order]
    cuts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))) if len(slot) else [0]
    made = [Transducer.build(words, rows[source[a:b]], counts[source[a:b]]).dump() for a, b in zip(cuts, cuts[1:])]
    for i in range(0, len(made), 64):
        yield pa.RecordBatch.from_arrays([pa.array(slot[cuts[i : i + 64][: len(made) - i]]), pa.array(made[i : i + 64], pa.binary())], names=["slot", "automaton"])


class Held:
    """N-grams that a task has counted, in the words' own numbers."""

    def __init__(self, depth: int):
        self.depth, self.number, self.rows, self.counts = depth, {}, [], []

    def add(self, words: Words, rows: np.ndarray, counts: np.ndarray) -> None:
        """``rows`` are numbers of ``words``, -1 where there is none."""
        used = np.unique(rows)
        used = used[used >= 0]
        number = self.number
        own = [number.setdefault(words.words[i], len(number) + 1) for i in used.tolist()]
        lang = [number.setdefault(words.langs[i], len(number) + 1) for i in used.tolist()]
        names, langs = np.zeros(len(words.words) + 1, np.int32), np.zeros(len(words.words) + 1, np.int32)
        names[used], langs[used] = own, lang  # the last entry, for -1, stays NONE
        self.rows.append(np.concatenate((langs[rows[:, :1]], names[rows]), axis=1))
        self.counts.append(counts)

    def size(self) -> int:
        return sum(map(len, self.rows))

    def fold(self) -> None:
        rows, counts = folded(np.concatenate(self.rows), np.concatenate(self.counts))
        self.rows, self.counts = [rows], [counts]

    def taken(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words in their order, sorted distinct rows, counts; nothing is held any more."""
        words = sorted(self.number)
        place = np.zeros(len(words) + 1, np.int32)
        place[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        rows, counts = folded(place[np.concatenate(self.rows)], np.concatenate(self.counts))
        self.number, self.rows, self.counts = {}, [], []
        return words, rows, counts


def grams(texts: DataFrame, least: int, most: int, frequent: BitSet, ranges: Ranges) -> DataFrame:
    """Automata of the tasks' n-grams of ``least`` to ``most`` words, per prefix range.

    ``frequent`` knows the n-grams of ``least - 1`` words that may be in one.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((frequent.bits, ranges))

    def run(batches):
        known, cuts = BitSet(sent.value[0]), sent.value[1]
        held = Held(most + 1)
        for chunk in in_chunks(batches, "body"):
            words = Words.of(chunk.column("lang"), chunk.column("body"))
            number, size = words.numbers, len(words.numbers)
            keys = word_keys(words.langs, words.words)
            if least == 2:
                good = known.has(keys)[number]
            else:
                good = np.zeros(size, bool)
                pairs = np.flatnonzero(~words.begins[1:]) if size else np.zeros(0, np.int64)
                good[pairs] = known.has(longer(keys[number[pairs]], keys[number[pairs + 1]]))
            # How many n-grams of least - 1 words begin one after the other here.
            piece = np.cumsum(words.begins)
            stop = np.ones(size + 1, bool)
            stop[:size] = ~good
            after = np.minimum.accumulate(np.where(stop, np.arange(size + 1), size)[::-1])[::-1][:size]
            last = np.searchsorted(piece, piece, "right")
            run_ = np.minimum(after, last if least == 2 else last - 1) - np.arange(size)
            for n in range(least, most + 1):
                at = np.flatnonzero(run_ >= n - least + 2)
                if not len(at):
                    continue
                rows = number[at[:, None] + np.arange(n)]
                rows, counts = folded(rows, np.ones(len(rows), np.int64))
                held.add(words, np.pad(rows, ((0, 0), (0, most - n)), constant_values=-1), counts)
            if held.size() > HELD:
                held.fold()
                if held.size() > HELD // 2:
                    yield from dumped(*held.taken(), cuts)
        if held.rows:
            yield from dumped(*held.taken(), cuts)

    return texts.mapInArrow(run, _DUMP)


def as_automata(counted: DataFrame, ranges: Ranges) -> DataFrame:
    """``lang, words, n`` in the form of ``grams``."""
    sent = counted.sparkSession.sparkContext.broadcast(ranges)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                langs, words = batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("words").to_pylist()
                yield from dumped(*_rows_of(langs, words, batch.column("n").to_numpy()), sent.value)

    rows = counted.select("lang", F.transform("words", lambda w: w.cast("binary")).alias("words"), "n")
    return rows.mapInArrow(run, _DUMP)


def _rows_of(langs: list[bytes], grams: list[list[bytes]], counts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    words = sorted({w for g in grams for w in g} | set(langs))
    number = {w: i for i, w in enumerate(words, 1)}
    rows = np.zeros((len(grams), 1 + max(map(len, grams))), np.int64)
    for i, (lang, gram) in enumerate(zip(langs, grams, strict=True)):
        rows[i, : len(gram) + 1] = [number[lang], *(number[w] for w in gram)]
    return words, *folded(rows, counts)


def united(automata: DataFrame, least_count: int, most: int) -> DataFrame:
    """``lang, words, n, parts, more`` of all n-grams that occur ``least_count`` times or more.

    ``parts`` are the counts of its beginnings, shortest first; ``more`` is the
    count of the most frequent n-gram with one more word behind it. Of a word
    that fills several ranges each gives a row.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [Transducer.load(bytes(a.as_buffer())) for a in table["automaton"].combine_chunks()]
        words, rows, counts = union(parts, most + 1)
        kept = counts >= least_count
        return _composed(words, rows[kept], counts[kept])

    return automata.groupBy("slot").applyInArrow(run, "lang string, words array<binary>, n long, parts array<long>, more long")


def _composed(words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Every sequence with the weights that its path meets."""
    nodes = levels(rows, counts)
    size = (rows != NONE).sum(axis=1)
    parts, more = np.zeros(rows.shape, np.int64), np.zeros(len(rows), np.int64)
    for d in range(1, rows.shape[1]):
        level = nodes[d]
        there = level.node >= 0
        parts[there, d] = level.weight[level.node[there]]
        most = np.zeros(len(nodes[d - 1].first), np.int64)
        np.maximum.at(most, level.parent, level.weight)
        ends = size == d
        more[ends] = most[nodes[d - 1].node[ends]]
    taken = pa.array(words, pa.binary())
    inner = (np.arange(rows.shape[1]) > 0) & (np.arange(rows.shape[1]) < size[:, None])
    before = inner & (np.arange(rows.shape[1]) < size[:, None] - 1)

    def lists(values: pa.Array, mask: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *mask.sum(axis=1)]), pa.int32()), values)

    return pa.table(
        {
            "lang": taken.take(pa.array(rows[:, 0] - 1)).view(pa.string()),
            "words": lists(taken.take(pa.array(rows[inner] - 1)), inner),
            "n": pa.array(counts),
            "parts": lists(pa.array(parts[before]), before),
            "more": pa.array(more),
        }
    )


def reversed_parts(frequent: DataFrame, ranges: Ranges, most: int) -> DataFrame:
    """``lang, words, ends, more_before``: counts of the ends of every n-gram, shortest first."""
    back = frequent.select("lang", F.reverse("words").alias("words"), "n")
    found = united(as_automata(back, ranges), 0, most)
    return found.select("lang", F.reverse("words").alias("words"), F.col("parts").alias("ends"), F.col("more").alias("more_before"))


def collocations(
    docs: DataFrame,
    least_count: int = 100,
    most_words: int = 5,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """``lang, phrase, a, l, r, n, score``: all phrases of 2 to ``most_words`` words, seen ``least_count`` times or more.

    Texts are lower-cased (A-Z), cut at ``. , ; : ! ?`` and line breaks, and
    words are what spaces and tabs separate; phrases lie inside a piece.
    ``n`` counts the words of the language, ``a`` the phrase, ``l`` and ``r``
    its two parts where 1000 a n / (l r), floored, is lowest: ``score``; of
    equal cuts the first. A phrase is left out if one with a word more, of
    ``most_words`` at most, holds it and occurs as often. Scores are exact. A null text is empty, a null language ``und``; repeated rows
    count as often as they are there; an empty table gives an empty table.
    Other columns are ignored.
    """
    if most_words < 2:
        raise ValueError("phrases have two words at least")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), utf8(F.col(text_col)).alias("body"))
    words = materialize(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    known = words.filter(F.col("n") >= least_count)
    single = known.select("lang", F.array("word").alias("words"), "n")
    ranges = prefix_ranges(known)
    base = as_automata(single, ranges)
    pairs = united(grams(texts, 2, 2, bit_set(single), ranges), least_count, most_words)
    pairs = materialize(pairs.select("lang", "words", "n"), "pairs")
    automata = base.unionByName(as_automata(pairs, ranges))
    if most_words > 2:
        automata = automata.unionByName(grams(texts, 3, most_words, bit_set(pairs), ranges))
    frequent = materialize(united(automata, least_count, most_words).dropDuplicates(["lang", "words"]), "phrases")
    ends = reversed_parts(frequent, ranges, most_words).filter(F.size("words") > 1)
    both = frequent.filter(F.size("words") > 1).join(ends, ["lang", "words"])
    free = both.filter((F.col("more") < F.col("n")) & (F.col("more_before") < F.col("n")))
    return _scored(free.join(totals, "lang"))


def _scored(phrases: DataFrame) -> DataFrame:
    """Exact scores in whole numbers, which may pass 64 bits on the way."""

    def run(batches):
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("n", "total", "parts", "ends"))
            for a, total, parts, ends in zip(*columns, strict=True):
                out.append(min((1000 * a * total // (left * right), k, left, right) for k, (left, right) in enumerate(zip(parts, reversed(ends), strict=True))))
            score, _, left, right = ([x[i] for x in out] for i in range(4))
            made = [batch.column("lang"), batch.column("phrase"), batch.column("n"), *(pa.array(x, pa.int64()) for x in (left, right)), batch.column("total"), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["lang", "phrase", "a", "l", "r", "n", "score"])

    phrase = F.array_join(F.transform("words", lambda w: F.decode(w, "UTF-8")), " ")
    rows = phrases.select("lang", phrase.alias("phrase"), "n", "total", "parts", "ends")
    return rows.mapInArrow(run, "lang string, phrase string, a long, l long, r long, n long, score long")


def best_phrases(docs: DataFrame, per_lang: int = 2000, **options) -> DataFrame:
    """The first ``per_lang`` collocations of each language by score, count and phrase, with their rank."""
    found = materialize(collocations(docs, **options), "collocations")
    ranked = positions(found, [F.desc("score"), F.desc("a"), "phrase"], ["lang"], "rank").filter(F.col("rank") <= per_lang)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
