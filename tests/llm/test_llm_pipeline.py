"""The pipeline against its stages in plain Python."""

import hashlib
from collections import Counter

import duckdb
import corpus_pipeline
from test_llm_edges import brute_components, brute_fingerprint, encoder, words

from tamis.llm.queries import SQL

SF = "/root/testdata/sf0.001"


def test_run(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {i for i, good in con.sql(f"SELECT doc_id, kept FROM ({SQL['op5_quality_rules']})").fetchall() if good}
    text = {i: t for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall() if i in kept}
    source = dict(con.sql("SELECT doc_id, source FROM documents").fetchall())
    first = {}
    for i in sorted(text):
        first.setdefault(text[i].encode().lower(), i)
    prints = {i: brute_fingerprint(text[i]) for i in first.values()}
    root = brute_components(set(prints.values()), 4)
    least = {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
    left = sorted(least.values())

    got = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    sizes = Counter()
    for i in left:
        sizes[source[i]] += len(words(text[i]))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, over, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in over]
        rest = total - sum(2 * sizes[s] for s in over)
        target = {s: 2 * sizes[s] if s in over else rest * weights[s] / sum(weights[f] for f in free) for s in sizes}
        more = {s for s in free if target[s] > 2 * sizes[s]}
        if not more:
            break
        over |= more
    for s in sizes:
        taken = sum(copies[i] * len(words(text[i])) for i in left if source[i] == s)
        assert abs(taken - target[s]) <= max(len(words(text[i])) for i in left if source[i] == s)
    e = encoder()
    for r in got:
        ids = e.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
