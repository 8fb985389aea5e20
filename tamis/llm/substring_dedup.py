"""Repeated passages found by recompression.

A text's words are recompressed in rounds. A round puts every symbol into a left
or a right class by its name, names each pair of a left symbol and a right one
after it, and names each run of equal symbols that remain. Names are 64-bit
hashes of what they stand for, so all tasks give equal substrings equal names
without exchanging a dictionary; what a name depends on besides its own words,
its neighbours, is kept as the symbol's context. A window of words takes, of the
symbols of the highest round that has any whose context lies inside it, the one
whose name hashes lowest. That depends on the window's words alone: equal
windows meet at equal symbols, and neighbouring windows share one.

A piece is a run of windows with one symbol. Pieces meet by the hash of the
symbol's context. Where all pieces that meet have the same words, all but the
first are repeats, whole; only where they differ, at the borders of repeats,
single windows are hashed and compared. Tasks fold what they have themselves
before each shuffle, so a passage in every text leaves a task once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tamis.llm.text import arrow_map, byte_strings, in_chunks, split_words, utf8
from tamis.session import materialize

WINDOW = 20
ROUNDS = 3
SHORT = 6  # words of context below which a window stands for itself
COPY_BITS = 40  # texts that share an id are told apart above these bits of a position
FILTER_BITS = 24  # of the filter that spares other documents' texts a shuffle; bounds its broadcast
HELD, CHUNK = 1 << 19, 2 << 20  # pieces that a task folds at once, bytes of text whose words it holds
_MUL = [np.uint64(m) for m in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F)]  # fixed odd multipliers (XXH64)
_DUP, _ASK = 1, 2


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)  # fixed odd multiplier (MurmurHash3)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts in one row, with two hashes each and hashes of any span."""

    def __init__(self, texts: pa.Array):
        import xxhash

        words, self.owner = split_words(texts)
        coded = words.dictionary_encode()
        at, distinct = coded.indices.to_numpy(), byte_strings(coded.dictionary)
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        hashes = np.array([(xxhash.xxh64_intdigest(w, 1), xxhash.xxh64_intdigest(w, 2)) for w in distinct], np.uint64).reshape(-1, 2)
        self.names = hashes[:, 0][at] if len(at) else np.zeros(0, np.uint64)
        self._sums, self._back = [], []
        for family in (0, 1):
            powers = np.cumprod(np.full(len(at), _MUL[family]), dtype=np.uint64)
            self._sums.append(np.concatenate(([np.uint64(0)], np.cumsum(hashes[:, family][at] * powers, dtype=np.uint64))))
            inverse = np.uint64(pow(int(_MUL[family]), -1, 1 << 64))
            self._back.append(np.cumprod(np.full(len(at) + 1, inverse), dtype=np.uint64))

    def spans(self, family: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``start`` to before ``end``, the same wherever they stand."""
        sums, back = self._sums[family], self._back[family]
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))

    def windows(self, width: int = WINDOW) -> np.ndarray:
        """Starts of all windows that lie inside one text."""
        at = np.arange(len(self.names))
        return at[at + width <= self.ends[self.owner]] if len(at) else at


def near_equal(name: np.ndarray, owner: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the symbol ``at`` exists, in the same text, and equals the one ``of``."""
    inside = (at >= 0) & (at < len(name))
    at = np.clip(at, 0, len(name) - 1)
    return inside & (owner[at] == owner[of]) & (name[at] == name[of])


def rounds(words: Words, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names and contexts ``[low, high)`` of the symbols after each round, in text order.

    A context that depends on where the text begins or ends reaches out of it.
    """
    name, owner = words.names, words.owner
    low = np.arange(len(name))
    high = low + 1
    for r in range(n):
        if not len(name):
            return
        left = (mix(name + np.uint64((r + 1) * int(_MUL[1]) % (1 << 64))) & np.uint64(1)) == 0
        near = owner[1:] == owner[:-1]
        pair = np.concatenate((near & left[:-1] & ~left[1:], [False]))  # with the symbol after it
        second = np.concatenate(([False], pair[:-1]))
        free = ~(pair | second)
        same = np.concatenate(([False], near & free[1:] & free[:-1] & (name[1:] == name[:-1])))
        first = np.flatnonzero(~(second | same))
        count = np.diff(np.concatenate((first, [len(name)])))
        last = first + count - 1
        paired = pair[first]
        begins, ends = words.starts[owner[first]], words.ends[owner[first]]
        # An equal symbol next to a run is outside it because it is half of a pair: both halves matter.
        before, after = first - 1, last + 1
        before = before - near_equal(name, owner, before, first)
        after = after + near_equal(name, owner, after, last)
        low_at, high_at = np.maximum(before, 0), np.minimum(after, len(name) - 1)
        outer_low = np.where((before >= 0) & (owner[low_at] == owner[first]), low[low_at], begins - 1)
        outer_high = np.where((after < len(name)) & (owner[high_at] == owner[first]), high[high_at], ends + 1)
        new_low, new_high = np.where(paired, low[first], outer_low), np.where(paired, high[last], outer_high)
        pairs = mix(name[first] * _MUL[0] + mix(name[last] + _MUL[1]))
        runs = np.where(count > 1, mix(name[first] * _MUL[1] + count.astype(np.uint64)), name[first])
        name, owner, low, high = np.where(paired, pairs, runs), owner[first], new_low, new_high
        yield name, low, high


_PLACE = np.uint64((1 << 28) - 1)


def lowest(rank: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the lowest rank in each non-empty ``[start, end)``; of equal ones the first."""
    table = (rank & ~_PLACE) | np.arange(len(rank), dtype=np.uint64)
    size, out = end - start, np.zeros(len(start), np.int64)
    width = 1
    while len(size) and width <= size.max():  # minima over 1, 2, 4, ... symbols
        use = np.flatnonzero((size >= width) & (size < 2 * width))
        both = np.minimum(table[start[use]], table[end[use] - width])
        out[use] = (both & _PLACE).astype(np.int64)
        table = np.minimum(table, np.concatenate((table[width:], np.full(min(width, len(table)), ~np.uint64(0)))))
        width *= 2
    return out


def pieces(words: Words, width: int = WINDOW, n: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """First and last window of each piece, and the hashes of its context and of all its words."""
    start = words.windows(width)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    low, high, level = start.copy(), start + width, np.zeros(len(start), np.int64)
    for r, (names, lows, highs) in enumerate(rounds(words, n), 1):
        begin, end = np.searchsorted(lows, start), np.searchsorted(highs, start + width, "right")
        some = np.flatnonzero(end > begin)
        at = lowest(mix(names), begin[some], end[some])
        long = highs[at] - lows[at] >= SHORT
        some, at = some[long], at[long]
        low[some], high[some], level[some] = lows[at], highs[at], r
    new = np.concatenate(([True], (start[1:] != start[:-1] + 1) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (level[1:] != level[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    begin, end = start[first], start[last]
    context = mix(words.spans(0, low[first], high[first]) + level[first].astype(np.uint64) * _MUL[1])
    whole = mix(words.spans(1, begin, end + width) + (low[first] - begin).astype(np.uint64) * _MUL[0])
    return begin, end, context, whole


def _first_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, document and place; where each row's key begins; whether the row is at the key's first place."""
    order = np.lexsort((at, doc, *key.T[::-1]))
    k, d, a = key[order], doc[order], at[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))) if len(k) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return order, head, (d == d[head]) & (a == a[head])


def _fold_pieces(context, whole, doc, at, mixed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks over pieces: repeats as a whole; to be asked window by window; the representative of its context.

    ``mixed`` marks pieces whose context is known to have pieces with other words.
    """
    order, _, is_first = _first_of(np.stack((context, whole), 1), doc, at)
    repeat = np.zeros(len(doc), bool)
    repeat[order] = ~is_first
    c = context[order]
    new = np.concatenate(([True], c[1:] != c[:-1]))
    group = np.cumsum(new) - 1
    w = whole[order]
    other = np.concatenate(([False], ~new[1:] & (w[1:] != w[:-1]))) | mixed[order]
    many = np.zeros(group[-1] + 1, bool)
    many[group[other]] = True
    ask, head = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    ask[order] = many[group] & is_first
    head[order] = new
    return repeat, ask, head


_PIECE = "context long, whole long, doc long, at long, n int, kind int"
_FOUND = "doc long, at long, n int, kind int"


def _batch(fields: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(f.split() for f in fields.split(", ")))
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kinds[t]) for c, t in zip(columns, types, strict=True)],
        names=list(names),
    )


def find_pieces(docs: DataFrame, width: int) -> DataFrame:
    """Pieces of all texts, folded per task: repeats and askers decided, one row per context left to compare.

    ``kind`` is 0 for a piece to compare, and for one whose context has other
    words too ``_ASK`` with ``n`` 0. What is decided needs no context any more
    and is dealt out evenly instead.
    """

    def run(batches):
        held: list[tuple] = []

        def flush():
            context, whole, doc, at, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            repeat, ask, head = _fold_pieces(context, whole, doc, at, np.zeros(len(doc), bool))
            kind = np.where(repeat, _DUP, np.where(ask, _ASK, 0))
            deal = np.where(kind > 0, mix(doc.view(np.uint64) * _MUL[0] + at.view(np.uint64)), context)
            yield _batch(_PIECE, deal, whole, doc, at, n, kind)
            mark = head & ask  # tells the others that the context has several
            yield _batch(_PIECE, context[mark], whole[mark], doc[mark], at[mark], 0 * n[mark], np.full(mark.sum(), _ASK))

        for chunk in in_chunks(batches, "body", CHUNK):
            words = Words(chunk.column("body"))
            begin, end, context, whole = pieces(words, width)
            if len(begin):
                own = words.owner[begin]
                doc, copy = (chunk.column(c).to_numpy()[own] for c in ("doc", "copy"))
                held.append((context, whole, doc, (copy << COPY_BITS) + begin - words.starts[own], end - begin + 1))
            if sum(len(h[0]) for h in held) > HELD:
                yield from flush()
        if held:
            yield from flush()

    return docs.select("doc", "copy", "body").mapInArrow(run, _PIECE)


def compare_pieces(found: DataFrame) -> DataFrame:
    """Runs of windows that repeat (``kind`` 1) and that must be asked one by one (2): ``doc, at, n, kind``."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        context, whole, doc, at, n, kind = (rows[c].to_numpy() for c in ("context", "whole", "doc", "at", "n", "kind"))
        settled = (kind != 0) & (n > 0)
        yield _batch(_FOUND, doc[settled], at[settled], n[settled], kind[settled])
        left = ~settled
        if left.any():
            context, whole, doc, at, n, mixed = (c[left] for c in (context, whole, doc, at, n, kind == _ASK))
            repeat, ask, _ = _fold_pieces(context, whole, doc, at, mixed)
            out = np.where(repeat, _DUP, np.where(ask, _ASK, 0))
            out[mixed] = 0
            yield _batch(_FOUND, doc[out > 0], at[out > 0], n[out > 0], out[out > 0])

    return found.repartition("context").mapInArrow(run, _FOUND)


_WINDOWS = "one long, two long, doc long, at long, n int, kind int"


def find_windows(asked: DataFrame, width: int) -> DataFrame:
    """The windows asked for, by the hash of their words, folded per task."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            one, two, doc, at = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order, _, first = _first_of(np.stack((one, two), 1), doc, at)
            kind = np.where(first, 0, _DUP)
            yield _batch(_WINDOWS, one[order], two[order], doc[order], at[order], np.ones(len(one), np.int64), kind)

        for chunk in in_chunks(batches, "body", CHUNK):
            words = Words(chunk.column("body"))
            spans = chunk.column("spans")
            counts = pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = spans.flatten()
            text = np.repeat(np.arange(len(counts)), counts)
            n = flat.field("n").to_numpy().astype(np.int64)
            base = np.repeat(flat.field("at").to_numpy(), n)
            step = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
            text, at = np.repeat(text, n), base + step
            begin = words.starts[text] + (at & ((1 << COPY_BITS) - 1))
            doc = chunk.column("doc").to_numpy()[text]
            held.append((words.spans(0, begin, begin + width), words.spans(1, begin, begin + width), doc, at))
            if sum(len(h[0]) for h in held) > HELD:
                yield from flush()
        if held:
            yield from flush()

    return asked.mapInArrow(run, _WINDOWS)


def compare_windows(windows: DataFrame) -> DataFrame:
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        one, two, doc, at, kind = (rows[c].to_numpy() for c in ("one", "two", "doc", "at", "kind"))
        order, _, first = _first_of(np.stack((one, two), 1), doc, at)
        again = np.zeros(len(doc), bool)
        again[order] = ~first
        again |= kind == _DUP
        yield _batch(_FOUND, doc[again], at[again], np.ones(again.sum(), np.int64), np.full(again.sum(), _DUP))

    return windows.repartition("one", "two").mapInArrow(run, _FOUND)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``doc``, ``copy`` and ``body``: id, number of the text among those that share it, bytes.

    Where no id repeats, which the ids alone show, ``copy`` is 0 throughout.
    """
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.withColumns({"doc": F.coalesce(F.col(id_col).cast("long"), least), "body": utf8(F.col(text_col))})
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("doc")).groupBy("doc").count().filter("count > 1")
    if ids.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    print_ = F.sha2("body", 256)
    texts = rows.join(ids.select("doc"), "doc", "left_semi").select("doc", print_.alias("print")).distinct()
    number = F.row_number().over(Window.partitionBy("doc").orderBy("print")) - 1
    numbered = materialize(texts.withColumn("copy", number.cast("long")), "copies")
    joined = rows.withColumn("print", print_).join(numbered, ["doc", "print"], "left")
    return joined.withColumn("copy", F.coalesce("copy", F.lit(0).cast("long"))).drop("print")


def repeated_spans(rows: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc, copy, spans``: per text its runs of windows whose words start earlier elsewhere or before.

    ``rows`` has ``doc, copy, body``. Earlier means a smaller ``doc``, then
    ``copy``, then place.
    """

    def per_text(found: DataFrame) -> DataFrame:
        copy = F.shiftright("at", COPY_BITS)
        return found.groupBy("doc", copy.alias("copy")).agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    first = materialize(compare_pieces(find_pieces(rows, width)), "pieces")
    asks = first.filter(F.col("kind") == _ASK)
    may, _ = split_by(rows.select("doc", "copy", "body"), touched(asks))
    asked = may.join(per_text(asks), ["doc", "copy"])
    second = materialize(compare_windows(find_windows(asked, width)), "windows")
    return per_text(first.filter(F.col("kind") == _DUP).unionByName(second))


def touched(found: DataFrame) -> DataFrame:
    """Bits of the documents in ``found``, by hash: at most ``2**(FILTER_BITS - 6)`` rows of 64."""
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    block, bit = F.shiftright(place, 6).alias("block"), place.bitwiseAND(F.lit(63)).cast("int")
    marks = found.select(block, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    return materialize(marks.groupBy("block").agg(F.bit_or("bit").alias("bits")), "touched")


def split_by(rows: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose document may be among those that made ``blocks``, and the rows that cannot be."""
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    marked = rows.withColumns({"block": F.shiftright(place, 6), "bit": place.bitwiseAND(F.lit(63)).cast("int")})
    marked = marked.join(F.broadcast(blocks), "block", "left")
    hit = F.coalesce(F.bit_get("bits", F.col("bit")) == 1, F.lit(False))
    return tuple(marked.filter(c).select(*rows.columns) for c in (hit, ~hit))


def kept_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_removed, kept_sha256``; see ``remove_repeats``."""
    kept = remove_repeats(docs.select(id_col, text_col), id_col, text_col, width)
    return kept.select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``id_col, n_words, n_removed, kept_text``: each text without the words of repeated windows.

    A window is ``width`` consecutive words of one text. A word goes if a window
    that covers it has words that start earlier too: in a row with a smaller id,
    or before in the same text. Windows are judged on the input. ``kept_text``
    (binary) joins the words left by one space. A null text has no words. Ids
    are whole numbers; a null id comes before all others. Rows that repeat id
    and text are one text and get the same result; texts that share an id come
    in the order of their SHA-256. An empty table gives an empty table.
    """
    rows = _keyed(docs.select(id_col, text_col), id_col, text_col)
    spans = repeated_spans(rows, width)
    may, others = split_by(rows.select(id_col, "doc", "copy", "body"), touched(spans))
    joined = may.join(spans, ["doc", "copy"], "left").unionByName(others, allowMissingColumns=True)

    def each(chunk: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        for text, runs in zip(chunk.column("body").to_pylist(), chunk.column("spans").to_pylist(), strict=True):
            words = text.split()
            if runs:
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.array([r["at"] for r in runs]) & ((1 << COPY_BITS) - 1)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + np.array([r["n"] for r in runs]) + width - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        return {"n_words": n_words, "n_removed": n_removed, "kept_text": kept}

    return arrow_map(joined, each, "n_words bigint, n_removed bigint, kept_text binary", "body", [id_col], CHUNK)
