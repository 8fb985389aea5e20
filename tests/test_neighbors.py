import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions import bits
from tamis.operators import neighbors

N_BITS = 128


def prints(n, seed, density=0.2):
    """Random fingerprints around a few centres, with copies and an empty one."""
    rng = random.Random(seed)
    centres = [[rng.random() < density for _ in range(N_BITS)] for _ in range(6)]
    out = []
    for _ in range(n):
        base = rng.choice(centres)
        out.append("".join("1" if b != (rng.random() < 0.06) else "0" for b in base))
    out[3] = out[1]
    out[5] = out[1]
    out[7] = "0" * N_BITS
    return out


def sim(a, b):
    x, y = (int(s, 2) for s in (a, b))
    return (x & y).bit_count() / (x | y).bit_count() if x | y else None


def frame(spark, strings, start=0):
    df = spark.createDataFrame([(start + i, s) for i, s in enumerate(strings)], "id long, bits string")
    return df.withColumn("fp", bits.pack_bits("bits", N_BITS))


def test_bit_functions(spark):
    df = spark.createDataFrame([("1100" + "0" * 60, "0110" + "0" * 60), ("0" * 64, "0" * 64)], "a string, b string")
    a, b = bits.pack_bits("a", 64), bits.pack_bits("b", 64)
    assert [r[0] for r in df.select(bits.tanimoto(a, b, 1)).collect()] == [pytest.approx(1 / 3), None]
    assert [r[0] for r in df.select(bits.popcount(a, 1)).collect()] == [2, 0]
    back = df.select(bits.positions_to_bits(bits.set_bits("b"), 64)).collect()
    assert [r[0] for r in back] == ["0110" + "0" * 60, "0" * 64]
    values = df.select(bits.bits_to_vector("a")).first()[0]
    assert values.toArray().tolist() == [1.0, 1.0] + [0.0] * 62


def test_ones_match_the_string(spark):
    s = prints(10, 1)
    got = frame(spark, s).select(bits.ones(F.col("fp"), 2)).collect()
    assert [r[0] for r in got] == [[i for i, c in enumerate(x) if c == "1"] for x in s]


@pytest.mark.parametrize(("block", "part"), [(1 << 20, 1 << 20), (3, 7), (1, 1 << 10)])
def test_nearest_in_one_block_or_many(spark, block, part, monkeypatch):
    monkeypatch.setattr(neighbors, "REFERENCE_BLOCK", block)
    monkeypatch.setattr(neighbors, "ROW_SLICE", part)
    rows, refs = prints(60, 2), prints(25, 9)
    ref = frame(spark, refs, 100).select(F.col("id").alias("ref_id"), F.col("fp").alias("ref_fp"))
    out = {
        r.id: (r.nearest_id, r.nearest_similarity)
        for r in neighbors.nearest(frame(spark, rows), ref, "fp", "id", N_BITS).collect()
    }
    for i, s in enumerate(rows):
        sims = [(sim(s, t), -(100 + j)) for j, t in enumerate(refs) if sim(s, t) is not None]
        best = max(sims)
        if int(s, 2) == 0:  # every non-empty reference is equally far
            assert out[i][1] == 0.0
            continue
        assert out[i][0] == -best[1] and out[i][1] == pytest.approx(best[0])


def test_popcount_blocks_are_in_order_and_bounded():
    counts = {0: 2, 3: 4, 4: 1, 7: 23, 9: 5, 10: 6}
    for size in (1, 5, 10, 100):
        first, pieces, n_blocks = neighbors.popcount_blocks(counts, 12, size)
        held = {}
        for ones, n in counts.items():
            for piece in range(pieces[ones]):
                held.setdefault(first[ones] + piece, []).append(n / pieces[ones])
        assert sorted(held) == list(range(n_blocks)) and max(map(sum, held.values())) <= size
        assert first == sorted(first)
    assert neighbors.popcount_blocks({}, 3, 5)[2] == 0


def test_nearest_without_references(spark):
    none = frame(spark, prints(9, 1)).filter("id < 0").select(F.col("id").alias("ref_id"), F.col("fp").alias("ref_fp"))
    row = neighbors.nearest(frame(spark, prints(9, 1)), none, "fp", "id", N_BITS).first()
    assert row.nearest_id is None and row.nearest_similarity is None


@pytest.mark.parametrize("distance", [0.2, 0.5])
def test_pairwise_finds_every_pair(spark, distance, many_ranges):
    s = prints(80, 4)
    out = neighbors.pairwise(frame(spark, s), None, "fp", "id", N_BITS, distance).collect()
    got = {(r.id_a, r.id_b): r for r in out}
    assert len(got) == len(out)
    first = {}
    for i, x in enumerate(s):
        first.setdefault(x, i)
    heads = sorted(i for x, i in first.items() if int(x, 2))
    want = {
        (a, b): 1 - sim(s[a], s[b]) for a in heads for b in heads if a < b and 1 - sim(s[a], s[b]) <= distance + 1e-12
    }
    assert set(got) == set(want)
    assert all(got[k].distance == pytest.approx(v) for k, v in want.items())
    assert all(r.copies_a == s.count(s[r.id_a]) for r in out)


def test_increment_completes_the_pairs(spark):
    s = prints(60, 6)
    whole = frame(spark, s)
    old, new = whole.filter("id < 40"), whole.filter("id >= 40")
    key = lambda df: {frozenset((r.id_a, r.id_b)) for r in df.collect()}
    args = ("fp", "id", N_BITS, 0.4)
    before = key(neighbors.pairwise(old, None, *args))
    added = key(neighbors.extend_pairs(old, new, *args))
    after = key(neighbors.pairwise(whole, None, *args))
    ids = {x: i for i, x in reversed(list(enumerate(s)))}
    same = lambda pairs: {frozenset(ids[s[i]] for i in p) for p in pairs}
    assert {p for p in same(before) | same(added) if len(p) == 2} == after


def sequential_clusters(s, t):
    n = len(s)
    near = [
        [j for j in range(n) if j != i and (s[i] == s[j] or (sim(s[i], s[j]) or 0) >= 1 - t - 1e-12)] for i in range(n)
    ]
    order = sorted(range(n), key=lambda i: (-len(near[i]), i))
    owner = {}
    for i in order:
        if i not in owner:
            owner[i] = i
            for j in near[i]:
                owner.setdefault(j, i)
    return owner


@pytest.mark.parametrize("seed", [1, 2])
def test_leader_clusters_equal_the_sequential_rule(spark, seed):
    s = prints(70, seed)
    out = neighbors.leader_clusters(frame(spark, s), "fp", "id", N_BITS, 0.4).collect()
    assert {r.id: r.leader_id for r in out} == sequential_clusters(s, 0.4)
    assert {r.cluster_id for r in out} == set(range(len({r.leader_id for r in out})))


def test_diverse_pick_is_greedy(spark):
    s = prints(30, 8)
    scores = [float(i % 7) for i in range(30)]
    df = frame(spark, s).withColumn("score", (F.col("id") % 7).cast("double"))
    got = [r.id for r in neighbors.pick_diverse(df, "fp", "id", "score", N_BITS, 6).orderBy("pick_order").collect()]
    rank = sorted(range(30), key=lambda i: (-scores[i], i))
    chosen = [rank[0]]
    distance = lambda a, b: 0.0 if sim(s[a], s[b]) is None else 1 - sim(s[a], s[b])
    while len(chosen) < 6:
        rest = [i for i in rank if i not in chosen]
        chosen.append(max(rest, key=lambda i: round(float(np.mean([distance(i, c) for c in chosen])), 12)))
    assert got == chosen
    assert neighbors.pick_diverse(df.limit(3), "fp", "id", "score", N_BITS, 6).count() == 3


def test_leader_assignment_and_groups(spark):
    s = prints(20, 3)
    df = frame(spark, s)
    heads = df.filter("id IN (0, 2, 4)").select(F.col("id").alias("lid"), F.col("fp").alias("lfp"), (F.col("id") * 10).alias("c"))
    out = neighbors.assign_leader(df, heads, "fp", "id", N_BITS, "lid", "lfp", ["c"]).collect()
    assert len(out) == 20 and all(r.c == r.leader_id * 10 for r in out if r.leader_id is not None)
    refs = df.select(F.col("id").alias("ref_id"), F.col("fp").alias("ref_fp"), F.when(F.col("id") < 10, "x").otherwise("y").alias("g"))
    near = neighbors.nearest_per_group(df.select("id", "fp"), refs, ["x", "y"], "g", "fp", "id", N_BITS)
    row = near.filter("id = 0").first()
    assert row.distance_x == 0.0 and row.nearest_x_id == 0 and row.distance_y >= 0


def test_far_apart_rows_lead_themselves(spark):
    df = frame(spark, [format(7 << (4 * i), f"0{N_BITS}b") for i in range(6)])
    out = neighbors.leader_clusters(df, "fp", "id", N_BITS, 0.3).collect()
    assert all(r.leader_id == r.id for r in out) and {r.cluster_id for r in out} == set(range(6))
    assert neighbors.pick_diverse(df.withColumn("score", F.col("id") * 1.0), "fp", "id", "score", N_BITS, 1).first().id == 5


@pytest.mark.parametrize(("distance", "joined"), [(0.2, 1e9), (0.2, 1e-9), (0.55, 1e-9)])
@pytest.mark.parametrize("block", [7, 4096])
def test_both_ways_of_the_similarity_join_find_every_pair(spark, distance, joined, block, monkeypatch):
    """Costs that force the join on rare bits (1e-9: any number of its rows is cheap) or the blocks."""
    monkeypatch.setattr(neighbors, "JOINED_ROW", joined)
    monkeypatch.setattr(neighbors, "REFERENCE_BLOCK", block)
    s, other = prints(40, 4), prints(30, 5)
    heads = {x: i for i, x in reversed(list(enumerate(s))) if int(x, 2)}
    others = {x: 100 + i for i, x in reversed(list(enumerate(other))) if int(x, 2)}
    near = lambda x, y: 1 - sim(x, y) <= distance + 1e-12
    inside = {(a, b): (s.count(x), s.count(y)) for x, a in heads.items() for y, b in heads.items() if a < b and near(x, y)}
    between = {(a, b): (s.count(x), other.count(y)) for x, a in heads.items() for y, b in others.items() if near(x, y)}
    df, more = frame(spark, s), frame(spark, other, 100)
    for second, want in ((None, inside), (more, between)):
        out = neighbors.pairwise(df, second, "fp", "id", N_BITS, distance).collect()
        assert len(out) == len(want) and {(r.id_a, r.id_b): (r.copies_a, r.copies_b) for r in out} == want
    refs = more.select(F.col("id").alias("ref_id"), F.col("fp").alias("ref_fp"))
    best = {r.id: r.nearest_id for r in neighbors.best_above(df, refs, "fp", "id", N_BITS, 1 - distance).collect()}
    assert best == {i: min((-sim(x, y), b) for y, b in others.items())[1] for i, x in enumerate(s) if int(x, 2) and any(near(x, y) for y in others)}


def test_dense_prints_are_not_joined_on_bits(spark):
    """Nearly all pairs of such prints share a rare bit, many times over."""
    rng = random.Random(3)
    df = frame(spark, ["".join(rng.choice("01") for _ in range(N_BITS)) for _ in range(200)]).select("id", "fp", F.lit(1).cast("long").alias("n"))
    assert neighbors._joined_above(df, df, 0.5, 2, True, 200 * 200 * 2 / neighbors.JOINED_ROW) is None
    assert neighbors._joined_above(df, df, 0.5, 2, True, float("inf")).dtypes == neighbors._blocks_above(df, None, 0.5, 2, False).dtypes


def test_a_missing_word_does_not_change_other_rows(spark):
    """Beside a null, words were once read as floats and lost their last bits."""
    s = prints(30, 2)
    df = frame(spark, s).unionByName(frame(spark, [None, None], 50))
    refs = df.filter("id % 2 = 0").select(F.col("id").alias("ref_id"), F.col("fp").alias("ref_fp"))
    got = {r.id: (r.nearest_id, r.nearest_similarity) for r in neighbors.nearest(df, refs, "fp", "id", N_BITS).collect()}
    for i, x in enumerate(s):
        if int(x, 2):
            best = min((-(sim(x, y) or 0), j) for j, y in enumerate(s) if j % 2 == 0)
            assert got[i] == (best[1], -best[0])
    assert got[50] == got[51] == (0, 0.0)
