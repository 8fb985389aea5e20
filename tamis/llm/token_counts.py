"""Token counts by a lookup in two tiers, without moving a pre-token.

A first pass over all documents counts words inside each task and keeps the
task's most frequent ones; their merged counts, split into pre-tokens, give a
table of the ``table_size`` most frequent with their lengths in tokens. The table is bounded by
that parameter and goes to every task. The second pass looks pre-tokens up in
it; a miss is encoded once and kept in the task's cache, which starts anew when
it is full. Both tiers only save work: every length is what the library gives.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamis.llm.text import arrow_map, in_chunks, named, split_words, utf8

TABLE_SIZE = 1 << 15
CACHE_SIZE = 1 << 18  # pre-tokens of a task's second tier
LONGEST = 64  # bytes of a word, or characters of a pre-token, that is kept in either tier


class Splitter:
    """Special tokens and pre-tokens of texts, as a tokenizer file defines them."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(pattern).findall

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens between special tokens, and the number of special tokens."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [t for part in parts for t in self.split(part)], len(parts) - 1

    def length(self, pre_token: str) -> int:
        return len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)


def frequent_lengths(docs: DataFrame, path: str, pattern: str, text_col: str, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths in tokens of frequent pre-tokens of the corpus, ``table_size`` at most.

    The words of all documents are counted, which is cheaper than splitting them
    into pre-tokens and finds the same ones: a word with the space before it is
    split once. What leaves a task are its own most frequent words with their
    counts, ``table_size`` at most, not the pre-tokens of its texts.
    """

    def run(batches):
        held: list[pa.Table] = []

        def fold() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for chunk in in_chunks(batches, "body"):
            found = split_words(chunk.column("body"))[0].view(pa.binary()).value_counts()
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            if sum(t.num_rows for t in held) > 64 * table_size:
                held[:] = [fold().sort_by([("n", "descending")]).slice(0, 16 * table_size)]
        if held:
            yield from fold().sort_by([("n", "descending")]).slice(0, table_size).to_batches()

    found = docs.select(utf8(F.col(text_col)).alias("body")).mapInArrow(run, "word binary, n long")
    frequent = found.filter(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    splitter, seen = Splitter(path, pattern), Counter()
    for r in frequent.orderBy(F.desc("n"), "word").limit(table_size).collect():
        for token in splitter(" " + bytes(r.word).decode("utf-8", "replace"))[0]:
            seen[token] += r.n
    return {token: splitter.length(token) for token, _ in seen.most_common(table_size)}


def count_tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    name: str = "n_tokens",
    table_size: int = TABLE_SIZE,
    cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """``docs`` without its text, with ``name``: tokens of the whole text (long).

    ``path`` is the tokenizer's file on every executor, ``pattern`` the split
    pattern of its byte-level pre-tokenizer. Special strings inside a text are
    special tokens, as the library has it. A null text has no tokens. Repeated
    rows repeat their count, an empty table stays empty, other columns pass
    through.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, pattern, text_col, table_size))
    body = named(docs, "__body")
    keep = [c for c in docs.columns if c not in (text_col, name)]
    held = []  # the task's splitter and second tier

    def each(chunk) -> dict:
        if not held:
            held.extend((Splitter(path, pattern), {}))
        splitter, cache = held
        first, counts = table.value.get, []
        for raw in chunk.column(body).to_pylist():
            tokens, total = splitter(raw.decode("utf-8", "replace"))
            for t in tokens:
                n = first(t) or cache.get(t)
                if n is None:
                    n = splitter.length(t)
                    if len(t) <= LONGEST:
                        if len(cache) >= cache_size:
                            cache.clear()
                        cache[t] = n
                total += n
            counts.append(total)
        return {name: counts}

    rows = docs.select(*keep, utf8(F.col(text_col)).alias(body))
    return arrow_map(rows, each, f"`{name}` bigint", body, keep)


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
