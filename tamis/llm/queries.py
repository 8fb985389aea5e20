"""The operators over their whole tables, one query each, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.llm import bpe, chat, exact_dedup, html_text, importance, langid, lm, mixing, phrases, quality, simhash, substring_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
QUOTED = "</s>[INST] ok [/INST]"  # said by both turns of op11's own conversation


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = langid.fold(F.col("doc_id")) == 1
    return lm.score(docs.withColumn("held_out", held_out), train=~F.col("held_out"))


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold(F.col("doc_id")) == 0
    filters = langid.fit_filters(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)


@query
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"), keep="largest")


@query
def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_digests(table(spark, sf, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Token ids and decoded bytes of every document as digests."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "text"), path, pattern)
    return bpe.decode(ids, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = quality.measured(table(spark, sf, "documents").select("doc_id", "text"))
    n, chars, symbols, lines, repeats = map(F.col, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    base = quality.base_rules(n, repeats)
    rules = base + quality.text_rules(F.col("text"), n, symbols, lines, chars)
    return quality.quality_cascade(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (base[0].rejects | base[1].rejects).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )


@query
def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    text = html_text.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


@query
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf, "documents"))


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.kept_words(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", token_counts.n_bytes(F.col("text")).alias("n_bytes"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op11_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one whose turns quote control strings, written and read back."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    quoting = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(QUOTED).alias("text")
    )
    formatted = chat.format_conversations(turns.unionByName(quoting), content_col="text")
    learnt = F.array_join("learnt", "")
    read = chat.read_turns(F.col("formatted"), F.col("attachments"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), chat.said_text(t["content"]), F.lit("\n")))
    return chat.learnt_texts(formatted).withColumn("turns", read).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.best_phrases(table(spark, sf, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op3_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""

SQL["op5_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM t),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 7], ' ') AS body FROM starts),
repeated AS (SELECT doc_id, s FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, body) >= 2),
covered AS (SELECT doc_id, count(DISTINCT s + k) AS n FROM repeated, range(8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words
    OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * len(string_split(text, chr(10))))
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 4 * len(regexp_extract_all(text, '[!?]')) > n_words
    OR 2 * len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]')) < word_chars) AS kept
FROM b
"""

SQL["op9_substring_dedup"] = rf"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM t),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS body FROM starts),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS spot FROM later, range(20) AS r(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM t),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY spot) AS body, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(rest.n, 0) AS n_removed,
  sha256(coalesce(rest.body, '')) AS kept_sha256
FROM t LEFT JOIN rest USING (doc_id)
"""

_CONTROL = chat.Template().control_pattern().replace("'", "''")

SQL["op11_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IN ('assistant') AS learnt
  FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{QUOTED}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (learnt), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learnt), '')) AS loss_sha256,
  sum({sum(len(m) for m in (chat.Template().start, chat.Template().body, chat.Template().end))} + length(role) + length(text)
    + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_FEATURES = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL["op12_importance_resampling"] = f"""
WITH RECURSIVE byte(b, k, v) AS (SELECT b, 0, b FROM range(256) AS r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM byte WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS steps FROM byte WHERE k = 8),
d AS (SELECT doc_id, {_FEATURES.format(_LOWER)} AS w FROM documents),
q AS (SELECT {_FEATURES.format(_LOWER)} AS w FROM benchmark),
corpus AS (SELECT g, count(*) AS n FROM (SELECT unnest(w) AS g FROM d) GROUP BY g),
target AS (SELECT g, count(*) AS n FROM (SELECT unnest(w) AS g FROM q) GROUP BY g),
grams AS (SELECT DISTINCT g FROM (SELECT g FROM corpus UNION ALL SELECT g FROM target)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(g)), 2),
    lambda i: ('0x' || substr(hex(encode(g)), i, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, steps[xor(a & 255, x) + 1])), 4294967295) % {importance.BUCKETS} AS bucket FROM grams, crc),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM corpus JOIN hashed USING (g) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM target JOIN hashed USING (g) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {importance.BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {importance.BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
each AS (SELECT doc_id, unnest(w) AS g FROM d),
means AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM each JOIN hashed USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN means USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""

SQL["op13_collocations"] = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, range(1, 6) AS r(k)) GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k > 1 AND f >= 100),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[i : j], ' ') AS phrase, a
  FROM (SELECT lang, w, a, k, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT lang, w, a, k, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k),
free AS (SELECT c.* FROM c ANTI JOIN inner_ AS o ON c.lang = o.lang AND c.phrase = o.phrase AND o.a >= c.a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS one, array_to_string(w[cut + 1 : k], ' ') AS two
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM free)),
scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score, cut
  FROM cuts AS c JOIN grams AS x ON c.lang = x.lang AND c.one = x.phrase JOIN grams AS y ON c.lang = y.lang AND c.two = y.phrase
  JOIN totals AS t ON c.lang = t.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
