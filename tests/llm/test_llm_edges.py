"""Every operator on the odd rows, on no rows, and against plain Python."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from llm_cases import CLASHES, LONG, ROWS, docs, rows_of
from pyspark.sql import functions as F

from tamis.llm import bpe, exact_dedup, html_text, langid, lm, mixing, quality, simhash, substring_dedup, token_counts
from tamis.operators import graph

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def words(text):
    return (text or "").encode().split()


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(docs(spark), keep="largest")
    by = {}
    for i, text, *_ in ROWS:
        by.setdefault((text or "").encode().lower(), []).append(i)
    want = []
    for i, text, *_ in ROWS:
        body = (text or "").encode().lower()
        keep = max((x for x in by[body] if x is not None), default=None)
        want.append((i, keep, len(by[body]), i == keep, hashlib.sha256(body).hexdigest()))
    assert rows_of(got, *got.columns) == sorted(want, key=repr)


def test_colliding_hashes_are_told_apart(spark):
    same = exact_dedup.exact_groups(docs(spark), digest=lambda text: F.lit("one hash"))
    assert rows_of(same, *same.columns) == rows_of(exact_dedup.exact_groups(docs(spark)), *same.columns)
    kept = exact_dedup.drop_exact_copies(docs(spark))
    assert kept.columns == docs(spark).columns and Counter(r.doc_id for r in kept.collect())[2] == 0


def test_quality_counts(spark):
    def counts(text):
        w = (text or "").encode().split()
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        chars = sum(len(x.decode()) for x in w)
        return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    got = quality.measured(docs(spark)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert all(tuple(r)[2:] == counts(r.text) for r in got.collect())


def test_sample_is_bounded_in_rows_and_bytes(spark):
    df = docs(spark).select("doc_id", "text").coalesce(1)
    before = sum(len((r[1] or "").encode()) for r in ROWS[:5])
    assert quality.first_rows(df, 3, 1 << 20).count() == 3
    assert quality.first_rows(df, 100, before).count() == 5  # the long text comes sixth
    assert quality.first_rows(df, 100, len(LONG) * 2).count() == len(ROWS)
    assert quality.first_rows(df, 100, -1).isEmpty() and quality.first_rows(df.limit(0), 100, 9).isEmpty()
    rules = quality.rules_of(F.col("text"))
    assert {r.name for r in quality.order_rules(df, rules, sample_bytes=-1)} == {r.name for r in rules}


def test_cascade_does_not_depend_on_order(spark):
    df = docs(spark)
    rules = quality.rules_of(F.col("text"))
    names = {r.name for r in rules}
    got = quality.quality_cascade(df, rules).select("text", "rejected_by").collect()
    back = df.select("text", quality.first_rejection(rules[::-1]).alias("r")).collect()
    assert Counter((r.text, r.rejected_by is None) for r in got) == Counter((r.text, r.r is None) for r in back)
    assert {r.rejected_by for r in got} <= names | {None}
    null = quality.Rule("never", F.lit(None).cast("boolean"))
    assert quality.quality_cascade(df, [null]).filter("rejected_by is not null").isEmpty()


def encoder():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    e = encoder()
    got = bpe.decode(bpe.encode(docs(spark), RANKS, PATTERN), RANKS, PATTERN)
    assert {r.body for r in got.collect()} == {"own body"}
    want = sorted(((i, e.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS), key=repr)
    assert sorted(((r.doc_id, r.ids, bytes(r.bytes)) for r in got.collect()), key=repr) == want


def test_bpe_holds_few_rows_at_once(spark):
    text = F.when(F.col("doc_id") < 9000, F.repeat(F.lit("some words "), 1000)).otherwise(F.raise_error(F.lit("read too far")))
    df = spark.range(9500, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    ids = encoder().encode_ordinary("some words " * 1000)
    assert bpe.encode(df, RANKS, PATTERN).take(1) == [(0, ids)]
    assert bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).take(1) == [(0, ids, b"some words " * 1000)]


def test_bpe_odd_ids_and_bytes(spark):
    df = spark.createDataFrame([(1, [258, 5]), (2, []), (3, None)], "k int, ids array<int>")
    want = {1: encoder().decode_bytes([258, 5]), 2: b"", 3: b""}
    assert {r.k: bytes(r.bytes) for r in bpe.decode(df, RANKS, PATTERN).collect()} == want
    raw = spark.sql("SELECT 1 AS k, X'61FF62' AS text UNION ALL SELECT 2, X'' UNION ALL SELECT 3, NULL")
    want = {1: encoder().encode_ordinary("a\ufffdb"), 2: [], 3: []}
    assert {r.k: r.ids for r in bpe.encode(raw, RANKS, PATTERN).collect()} == want


@pytest.mark.parametrize("text", [LONG, "a" * 70_000, " " * 70_000, "é 1 " * 30_000, "word's  two\n\n x" * 9000])
def test_bpe_pieces_change_no_id(text):
    assert "".join(bpe.pieces(text, 1000)) == text
    assert [i for p in bpe.pieces(text, 1000) for i in encoder().encode_ordinary(p)] == encoder().encode_ordinary(text)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs(spark), path, PATTERN, table_size=4, cache_size=3)
    want = sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS), key=repr)
    assert rows_of(got, "doc_id", "n_tokens") == want


def test_language_model(spark):
    df = docs(spark).withColumn("train", F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 1)
    got = lm.score(df, F.col("train"), table_size=3).collect()
    seen = Counter()
    for i, text, *_ in ROWS:
        if (i or 0) % 2 == 1:
            seen.update([*(w.lower() for w in words(text)), "end"])
    total, v = sum(seen.values()), len(seen)
    want = Counter()
    for i, text, *_ in ROWS:
        tokens = [*(w.lower() for w in words(text)), "end"]
        base = sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (v + 1))) for t in tokens)
        want[i, len(tokens), sum(seen[t] > 0 for t in tokens), total, round(base, 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 and r.row == "own row" for r in got)


def test_language_model_without_training(spark):
    got = lm.score(docs(spark), F.lit(False)).collect()
    assert len(got) == len(ROWS) and {r.n_known for r in got} == {0} and {r.train_tokens for r in got} == {0}


def test_filter_finds_every_pair():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64)
    f = lm.Filter(np.zeros(8000, np.uint8), 1, 64_000)
    h, step = f.probes(keys, 3)
    bits = np.zeros(64_000, np.uint8)
    for _ in range(lm.PROBES):
        bits[f.spots(h)] = 1
        h = h + step
    f.bits = np.packbits(bits, bitorder="little")
    assert len(f.contains(keys, 3)) == 5000
    assert len(f.contains(keys, 4)) < 500


def test_languages(spark):
    filters = langid.fit_filters(docs(spark), length=3)
    got = langid.identify(docs(spark), filters).collect()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id == 1} == {"en"}
    none = langid.identify(docs(spark), langid.fit_filters(docs(spark).filter("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_folds(spark):
    got = docs(spark).select("doc_id", langid.fold(F.col("doc_id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 for r in got)


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = langid.fold(F.col("doc_id")) == 0
    got = langid.identify(df.filter(held), langid.fit_filters(df.filter(~held)))
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.97


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [w[i : i + 4] for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_groups(spark):
    got = simhash.near_groups(docs(spark))
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in ROWS]
    root = brute_components({p for _, p in prints}, 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=repr)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("group_variants", [1 << 21, 3000])
def test_balls_find_every_link(spark, group_variants):
    import random

    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(3):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.ball_links(spark.createDataFrame(signed, "fp long"), 4, group_variants=group_variants)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in graph.components(links).collect()}
    want = brute_components(prints, 4)
    classes = lambda of: {frozenset(p for p in prints if of(p) == r) for r in map(of, prints)}
    assert classes(lambda p: got.get(p, p)) == classes(lambda p: want[p])


def test_components_of_a_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 900), (None, 5)], "a long, b long"))
    got = graph.components(chain).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(301)} and len(got) == 301


def test_mix(spark):
    got = mixing.mixed(docs(spark)).collect()
    size = {}
    for _, text, _, source, _ in ROWS:
        size[source] = size.get(source, 0) + len(words(text))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, *_ in ROWS)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in got)
    assert sum({r.source_size: r.target for r in got}.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(tuple, got), key=repr) == rows_of(mixing.mixed(docs(spark)), *got[0].asDict())


def test_mix_meets_targets(spark):
    df = spark.range(20_000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "trim(repeat('w ', cast(1 + id * 37 % 90 as int))) as text"
    )
    got = mixing.mixed(df).join(df.select("doc_id", "source"), "doc_id")
    rows = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("c")).collect()
    assert all(abs(r.taken - r.target) <= 90 and r.c <= 2 for r in rows)


def test_pivot_keeps_words():
    import numpy as np

    rng = np.random.default_rng(5)
    part, size = rng.random(999), rng.integers(1, 50, 999)
    means = []
    for _ in range(200):
        out = mixing.pivot(part, size, rng.random(999))
        assert ((out > 0) & (out < 1)).sum() <= 1 and (out * size).sum() == pytest.approx((part * size).sum())
        means.append(out)
    assert abs(np.mean(means, axis=0) - part).max() < 0.2


def brute_repeats(rows, width=20):
    texts = sorted({(-1 if i is None else i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in texts:
        w, gone = words(t), set()
        for s in range(len(w) - width + 1):
            window = tuple(w[s : s + width])
            if window in seen:
                gone.update(range(s, s + width))
            seen.add(window)
        out[i, t] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings(spark):
    import random

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(15, 60))) for _ in range(6)]
    rows = list(ROWS)
    for i in range(100, 180):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n"]).join(parts + ["a"] * rng.choice([0, 0, 50])), "en", "s", 0))
    rows += [(150, "another text of the same id " * 12, "en", "s", 0)]
    got = substring_dedup.remove_repeats(docs(spark, rows))
    want = brute_repeats(rows)
    found = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in got.collect()]
    assert Counter(found) == Counter((i, *want[-1 if i is None else i, t or ""]) for i, t, *_ in rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   para&shy;graph<br>goes <b>on</b> for a while, with words.
<p>Second paragraph &lt;here&gt;, as long as the first one.<form>Name <input></form><aside>Side</aside></article>
<section id="comments"><p>Great post, thanks!</p></section><div class=ad>Buy</div><footer>&copy; 2020</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == [
        "Title & more", "First para­graph goes on for a while, with words.", "Second paragraph <here>, as long as the first one.",
    ]
    assert html_text.main_text("") == "" and html_text.main_text("<nav>only a menu</nav>") == ""
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    got = html_text.extract(pages.withColumn("__body", F.lit("own"))).collect()
    assert sorted((r.page_id, r.text.count("\n")) for r in got) == [(1, 2), (2, 0), (2, 0), (3, 0)]


def test_empty_tables(spark):
    none = docs(spark, [])
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (
        exact_dedup.exact_groups(none), exact_dedup.drop_exact_copies(none), quality.keep_quality(none),
        bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS, PATTERN), token_counts.count_tokens(none, path, PATTERN),
        lm.score(none, F.lit(True)), langid.identify(none, langid.fit_filters(none)), simhash.near_groups(none),
        simhash.drop_near_copies(none), mixing.mixed(none), mixing.take_mix(none), substring_dedup.remove_repeats(none),
    ):
        assert out.isEmpty()


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs(spark), "").columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]


def test_texts_without_a_letter_are_of_no_language(spark):
    rows = [(1, "der die das und nicht " * 9, "de"), (2, "the cat and the dog " * 9, "en"), (3, "² ½ ³", "en"), (4, "12 _ 7", "de"), (5, "٣ Ⅷ ①", "de"), (6, "ª", "en"), (7, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(df.select("doc_id", "text"), langid.fit_filters(df)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["de", "en", "und", "und", "und", "und"]
    assert out[6].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in out.values())


def test_repeats_do_not_depend_on_how_much_a_task_holds(spark, monkeypatch):
    from tamis.llm import substring_dedup

    shared = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"a{i} {shared} b{i} {shared}" if i % 2 else f"c{i} {shared}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = lambda: sorted(map(tuple, substring_dedup.kept_words(df).collect()))
    whole = found()
    monkeypatch.setattr(substring_dedup, "CHUNK", 300)
    monkeypatch.setattr(substring_dedup, "HELD", 20)
    assert found() == whole and [r[2] for r in whole] == [0] + [80 if i % 2 else 40 for i in range(1, 30)]
