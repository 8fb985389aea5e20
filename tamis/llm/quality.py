"""Quality rules as a short-circuit cascade.

Every rule is a condition that rejects a text. On a sample of rows each rule is
timed and its share of rejections is counted; the rules are then tried in the
order of rejections per second, and a CASE stops at the first that rejects. The
order changes the work, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tamis.llm.text import let, n_words, words
from tamis.session import materialize

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    name: str
    rejects: Column


def word_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[{SYMBOLS}]")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))), F.lit(0)).cast("long")


def n_repeat_words(tokens: Column, width: int = 8) -> Column:
    """Words covered by windows of ``width`` words that the text has twice or more.

    Hashes of the windows show whether any window repeats at all; only then are
    the windows themselves sorted and compared.
    """

    def windows(t: Column, make) -> Column:
        last = F.size(t) - (width - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: make(F.slice(t, i, width))))

    def covered(ordered: Column) -> Column:
        def repeated(entry: Column, at: Column) -> Column:
            same = [F.coalesce(F.get(ordered, at + step)["window"] == entry["window"], F.lit(False)) for step in (-1, 1)]
            return F.when(same[0] | same[1], entry["at"])

        starts = F.array_sort(F.filter(F.transform(ordered, repeated), lambda p: p.isNotNull()))
        spans = let(starts, lambda s: F.transform(s, lambda p, k: F.least(F.get(s, k + 1) - p, F.lit(width))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)

    def exact(t: Column) -> Column:
        entries = F.transform(
            windows(t, lambda w: F.array_join(w, " ")), lambda w, at: F.struct(w.alias("window"), at.alias("at"))
        )
        return let(F.array_sort(entries), covered)

    def count(t: Column) -> Column:
        return let(
            windows(t, lambda w: F.xxhash64(w)),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(t)),
        )

    return F.coalesce(let(tokens, count), F.lit(0).cast("long"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of the whole text.

    A null text has no words; all five are 0 then.
    """
    text = F.col(text_col)
    return docs.withColumns(
        {
            "n_words": n_words(text),
            "word_chars": word_chars(text),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
            "n_repeat_words": n_repeat_words(words(text)),
        }
    )


def base_rules(n: Column, repeats: Column) -> list[Rule]:
    return [Rule("few_words", n < 20), Rule("repeats", 100 * repeats > 30 * n)]


def text_rules(text: Column, n: Column, symbols: Column, dup_lines: Column, chars: Column) -> list[Rule]:
    """Rules on the counts that come in as columns or expressions, and on the text itself."""
    lines = F.size(F.split(text, "\n"))
    return [
        Rule("symbols", 10 * symbols > n),
        Rule("copied_lines", (dup_lines >= 3) & (100 * dup_lines > 30 * lines)),
        Rule("word_length", (chars < 2 * n) | (chars > 20 * n)),
        Rule("shouting", 4 * F.regexp_count(text, F.lit("[!?]")) > n),
        Rule("few_letters", 2 * F.regexp_count(text, F.lit(r"[\p{L}\p{M}]")) < chars),
    ]


_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def rules_of(text: Column) -> list[Rule]:
    """All rules from the text alone; each computes what it needs when it is reached.

    In scripts that put no spaces between words every character counts as a
    word; they are only counted where the words between spaces would reject.
    """
    n = n_words(text)
    more = n + F.regexp_count(text, F.lit(_UNSPACED))

    def rules(n: Column) -> list[Rule]:
        return base_rules(n, n_repeat_words(words(text))) + text_rules(text, n, n_symbols(text), n_dup_lines(text), word_chars(text))

    return [Rule(r.name, r.rejects & again.rejects) for r, again in zip(rules(n), rules(more), strict=True)]


def first_rows(docs: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """The first rows Spark finds, ``rows`` at most, as far as their texts fit into ``most_bytes``.

    Their sizes are looked at before any text is fetched.
    """
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c, kind in docs.dtypes if kind in ("string", "binary")]
    sizes = docs.select(sum(texts, F.lit(0).cast("long")).alias("bytes")).take(rows)
    fit = sum(total <= most_bytes for total in accumulate(r.bytes for r in sizes))
    return docs.sparkSession.createDataFrame(docs.take(fit), docs.schema)


def order_rules(
    docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000, sample_bytes: int = 32 << 20
) -> list[Rule]:
    """``rules`` by rejections per second on a sample; ties keep the given order.

    The sample is the first ``sample_rows`` rows Spark finds, fewer if their
    texts exceed ``sample_bytes``: bounds that only the order of the rules
    depends on. Spark reads as many splits as that takes. Each rule runs twice,
    because the first run compiles it.
    """
    sample = materialize(first_rows(docs, sample_rows, sample_bytes), "sample")
    worth = []
    for rule in rules:
        for _ in range(2):
            start = time.perf_counter()
            rejected, n = sample.agg(F.count_if(F.coalesce(rule.rejects, F.lit(False))), F.count("*")).first()
            seconds = time.perf_counter() - start
        worth.append((rejected + 0.5) / (n + 1) / seconds)
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def first_rejection(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not computed."""
    out = None
    for rule in rules:
        met, name = F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)
        out = F.when(met, name) if out is None else out.when(met, name)
    return F.lit(None).cast("string") if out is None else out


def quality_cascade(
    docs: DataFrame, rules: Sequence[Rule], name: str = "rejected_by", sample_rows: int = 2000
) -> DataFrame:
    """``docs`` with the name of a rule that rejects the row, null for rows that stay.

    Rules are SQL conditions over the columns of ``docs``. A null condition
    rejects nothing. Which of several rejecting rules is named depends on the
    measured order, whether a row is rejected does not. Rows that repeat get the
    same verdict, columns with other names pass through, and an empty table
    stays empty.
    """
    return docs.withColumn(name, first_rejection(order_rules(docs, rules, sample_rows)))


def keep_quality(docs: DataFrame, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all their columns unchanged.

    A null text goes, as one without words. Repeated rows share their fate, an
    empty table stays empty.
    """
    rules = order_rules(docs, rules_of(F.col(text_col)), sample_rows)
    return docs.filter(first_rejection(rules).isNull())
