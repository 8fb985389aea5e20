"""Chat formatting, importance resampling and collocations against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from llm_cases import LONG, docs
from pyspark.sql import functions as F

from tamis.llm import chat, importance, phrases, transducer

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURNS = "conv_id long, turn long, role string, text string, id string, piece string, place string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


SAYINGS = [
    "", None, "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|end|><", "<<|end|>", "[[INST]", "<", "\\", "<\\", LONG,
    "<|start|>user<|message|>no<|end|>", "a\nb", "Ünï 😀 <|image|>", "[\\/INST]", "<|im_start|><\\s>",
]


def test_any_text_comes_back(spark):
    rows = [(c, t, r, s, "own", "own", "own") for c, (s, r) in enumerate((s, r) for s in SAYINGS for r in ("user", "assistant", None, "<|end|>")) for t in (2, 1, None)]
    df = spark.createDataFrame(rows, TURNS)
    formatted = chat.format_conversations(df, content_col="text")
    read = chat.learnt_texts(formatted).withColumn("turns", chat.read_turns(F.col("formatted"), F.col("attachments")))
    out = read.withColumn("said", F.transform("turns", lambda t: chat.said_text(t["content"]))).collect()
    want = {}
    for c, _, r, s, *_ in rows:
        want.setdefault(c, []).append((r or "", s or ""))
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        assert [(t.role, s) for t, s in zip(r.turns, r.said)] == want[r.conv_id]
        assert r.learnt == [s for role, s in want[r.conv_id] if role == "assistant"]
        assert r.formatted.count("<|start|>") == r.formatted.count("<|end|>") == 3


def test_parts_are_placeholders_in_order(spark):
    content = [
        part("text", "see <|image|>"), part("image", ref="i1", width=29, height=56), part("image", ref="i2"), part("text", None),
        part("audio", ref="a1", seconds=1.01), part("text", "and"), part("text", " more"), part("document", ref="d1", pages=2), part("odd", "kept"),
    ]
    df = spark.createDataFrame([(1, 1, "user", [part("image", ref="i0", width=1, height=1)]), (1, 2, "assistant", content), (1, 3, None, None)], f"conv_id long, turn long, role string, content {PARTS}")
    formatted = chat.format_conversations(df)
    r = formatted.withColumn("turns", chat.read_turns(F.col("formatted"), F.col("attachments"))).first()
    assert [tuple(a) for a in r.attachments] == [
        ("image", "i0", 1, 1), ("image", "i1", 2, 4), ("image", "i2", 2, 0), ("audio", "a1", 2, 26), ("document", "d1", 2, 2048)
    ]
    assert r.n_tokens == 1 + 4 + 26 + 2048
    assert [tuple(p) for p in r.turns[1].content] == [
        ("text", "see <|image|>", None), ("image", None, "i1"), ("image", None, "i2"), ("audio", None, "a1"),
        ("text", "and more", None), ("document", None, "d1"), ("text", "kept", None),
    ]
    assert [(s.start, s.end) for s in r.loss] == [tuple(x) for x in [(r.formatted.index("see"), r.formatted.index("kept") + 4)]]
    assert not chat.format_conversations(df.limit(0)).collect()


def test_templates_that_cannot_be_escaped_are_refused():
    for wrong in ({"start": "<<SYS>>"}, {"end": "x"}, {"body": "<\\a>"}, {"audio": "<|image|>"}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def features(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("order", [1, 3])
def test_resampling(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choices(["Éa", "b-c", "d1", "\x7f", "the", "of", "x" * 70], k=rng.randrange(60))), "en", "s", 1) for i in range(150)]
    rows += [(7, rows[7][1], "en", "s", 1), (None, "a " * 25, None, None, None), (900, None, "en", "s", 1), (901, LONG, "en", "s", 1)]
    target = ["the of the d1", None, "Éa the"]
    got = importance.resample(docs(spark, rows), spark.createDataFrame([(t, "own") for t in target], "text string, id string"), 10, 20, order, 64).collect()

    def counted(texts):
        return Counter(crc32(g.encode()) % 64 for t in texts for g in features(t, order)[1])

    s, t = counted(r[1] for r in rows), counted(target)
    S, T = s.total() + 64, t.total() + 64
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * S / ((s[b] + 1.0) * T))) for b in range(64)]
    want = []
    for doc_id, text, *_ in rows:
        w, f = features(text, order)
        weight = sum(gain[crc32(g.encode()) % 64] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append((doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    long_enough = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, len(long_enough) // 10 + 1))
    assert [r.doc_id for r in drawn] == [r[0] for r in long_enough[: len(drawn)]]
    assert not importance.resample(docs(spark, []), docs(spark)).collect()


def brute_phrases(rows, least, most):
    total, found = Counter(), Counter()
    for _, text, lang, *_ in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            found.update((lang or "und", tuple(w[i : i + n])) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    many = {g: a for g, a in found.items() if len(g[1]) > 1 and a >= least}
    inside = {(lang, w[i:j]) for (lang, w), a in many.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and found[lang, w[i:j]] <= a}
    out = set()
    for (lang, w), a in many.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * total[lang] // (found[lang, w[:k]] * found[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.add((lang, " ".join(w), a, found[lang, w[:k]], found[lang, w[k:]], total[lang], score))
    return out


@pytest.mark.parametrize("step", [1 << 19, 40])
def test_collocations(spark, monkeypatch, many_ranges, step):
    monkeypatch.setattr(phrases, "RANGE", step)
    rng = random.Random(step)
    vocabulary = ["the", "THE", "of", "é", "x\x01y", "\x1cq", "…", "san", "francisco", "und", "a" * 80]
    rows = [
        (i, "".join(w + rng.choice(["  ", " ", " ", "\t", ". ", "\n", "\x0b"]) for w in rng.choices(vocabulary, [9, 3, 5, 1, 1, 1, 1, 2, 2, 1, 1], k=rng.randrange(80))), rng.choice(["en", "de", None, "und"]), "s", 1)
        for i in range(120)
    ]
    rows += [(i, "one passage that many texts share word for word", "en", "s", 1) for i in range(30)] + [(None, None, None, None, None), (1, "", "fr", None, 0)]
    got = phrases.collocations(docs(spark, rows), least_count=12, most_words=5).collect()
    want = brute_phrases(rows, 12, 5)
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 50
    pairs = phrases.collocations(docs(spark, rows), least_count=12, most_words=2).collect()
    assert set(map(tuple, pairs)) == brute_phrases(rows, 12, 2)
    first = phrases.best_phrases(docs(spark, rows), per_lang=3, least_count=12).filter("lang = 'en'").orderBy("rank").collect()
    assert [tuple(r)[2:4] for r in first] == [x[1:3] for x in sorted((x for x in want if x[0] == "en"), key=lambda x: (-x[6], -x[2], x[1].encode()))[:3]]
    assert not phrases.collocations(docs(spark, [])).collect()


def test_transducers_give_back_what_they_were_built_from():
    import numpy as np

    rng = random.Random(3)
    words = [b"", b"a", b"b", b"long word"]
    seen = Counter(tuple(rng.randrange(1, 5) for _ in range(rng.randrange(1, 5))) for _ in range(400))
    rows = np.array([[*g, *[0] * (4 - len(g))] for g in seen])
    rows, counts = transducer.folded(rows, np.array(list(seen.values())))
    made = transducer.Transducer.load(transducer.Transducer.build(words, rows, counts).dump())
    back, n = transducer.folded(*made.rows(4))
    assert (back == rows).all() and (n == counts).all() and made.words == words
    same, r, c = transducer.union([made, made, transducer.Transducer.build(words, rows[:0], counts[:0])], 4)
    assert same == words and (r == rows).all() and (c == 2 * counts).all()
    chain = np.array([[a, 2, 3, 4] for a in (1, 2, 3, 4)])  # equal tails are one state each
    assert len(transducer.Transducer.build(words, chain, np.full(4, 7)).label) == 4 + 3


def test_automata_are_read_as_they_were_written():
    import numpy as np

    from tamis.llm.transducer import Transducer

    words, rows = [b"", b"a", b"\xc3\xa9\x00", b"zz"], np.array([[1, 0], [1, 2], [3, 4], [4, 0]])
    for counts in ([1, 2, 3, 4], [1, 2**31, 2**40, 4], [2**31 - 1] * 4):
        built = Transducer.build(words, rows, np.array(counts))
        again = Transducer.load(built.dump())
        assert again.words == built.words and again.root == built.root
        found, n = again.rows(2)
        assert sorted(zip(map(tuple, found.tolist()), n.tolist())) == sorted(zip(map(tuple, rows.tolist()), counts))
    empty = Transducer.build([], np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    assert len(Transducer.load(empty.dump()).rows(2)[0]) == 0
