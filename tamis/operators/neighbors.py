"""Tanimoto neighbours: nearest reference, pairs below a distance, clusters, diverse picks.

Fingerprints are arrays of 64-bit words (``tamis.functions.bits``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.bits import WORD, ones, popcount, tanimoto
from tamis.functions.rows import number
from tamis.operators.order import positions
from tamis.session import materialize

# References of a block, rows of a slice, and pairs compared at once.
REFERENCE_BLOCK, ROW_SLICE, PAIRS_AT_ONCE = 4096, 1 << 16, 1 << 16
# Comparisons of a word in blocks that cost as much as one row of the join on rare bits,
# pairs of blocks that a task compares, and pairs that it holds before it hands them on.
JOINED_ROW, BLOCKS_A_TASK, PAIRS_HELD = 64, 16, 1 << 18
# Picks whose distances may wait as expressions before the running sums are written.
PICKS_HELD = 16


def _words(column: pa.ChunkedArray, n_words: int) -> np.ndarray:
    """Fingerprints as a matrix of unsigned words, a row each; a missing word has no ones."""
    return column.combine_chunks().flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, n_words).view(np.uint64)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ones that each of ``x`` shares with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] & y[None, :, w])
    return out


def _best_of(rows: pa.Table, refs: pa.Table, n_words: int) -> pa.Table:
    """Per row the most similar of the references (ties: smallest id); rows that meet none are left out."""
    refs = refs.sort_by("ref_id")
    x, y = _words(rows["fp"], n_words), np.asfortranarray(_words(refs["fp"], n_words))
    found, best = np.zeros(len(x), np.int64), np.full(len(x), -1.0)
    ones_x, ones_y = (np.bitwise_count(v).sum(axis=1, dtype=np.float64) for v in (x, y))
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for lo in range(0, len(x) if len(y) else 0, step):
        both = _shared(x[lo : lo + step], y).astype(np.float64)
        either = ones_x[lo : lo + step, None] + ones_y - both
        sims = np.divide(both, either, out=np.full(both.shape, -1.0), where=either > 0)
        first = sims.argmax(axis=1)
        found[lo : lo + step], best[lo : lo + step] = first, sims[np.arange(len(sims)), first]
    hit = np.flatnonzero(best >= 0)
    return pa.table({"at": rows["at"].take(pa.array(hit)), "ref_id": refs["ref_id"].take(pa.array(found[hit])), "similarity": pa.array(best[hit])})


def popcount_blocks(counts: dict[int, int], n_bits: int, size: int) -> tuple[list[int], list[int], int]:
    """First block of each popcount, the number of blocks it fills, and the number of all blocks.

    ``counts`` are references per popcount. Neighbouring popcounts share a block
    until it is full; a popcount with more references than that fills several.
    """
    first, pieces, block, held = [], [], 0, 0
    for ones in range(n_bits + 1):
        n = counts.get(ones, 0)
        if held and held + n > size:
            block, held = block + 1, 0
        first.append(block)
        pieces.append(max(1, -(-n // size)))
        if n > size:
            block, held = block + pieces[-1], 0
        else:
            held += n
    return first, pieces, block + (held > 0)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Blocks:
    """Blocks of like popcount that the rows of a table (column ``ones``) are dealt out to.

    What reaches the driver is one count per popcount, ``n_bits`` + 1 at most.
    """

    def __init__(self, df: DataFrame, n_bits: int):
        counts = {r.ones: r.n for r in df.groupBy("ones").agg(F.count("*").alias("n")).collect()}
        self.n_bits, self.rows = n_bits, sum(counts.values())
        self._first, self._pieces, self.n = popcount_blocks(counts, n_bits, REFERENCE_BLOCK)
        self._last = [f + n - 1 for f, n in zip(self._first, self._pieces, strict=True)]

    def _of(self, values: list[int], ones: Column) -> Column:
        at = F.greatest(F.lit(0), F.least(ones, F.lit(self.n_bits))).cast("int")
        return F.least(F.get(F.array(*map(F.lit, values)), at), F.lit(self.n - 1)).cast("int")

    def first(self, ones: Column) -> Column:
        return self._of(self._first, ones)

    def last(self, ones: Column) -> Column:
        return self._of(self._last, ones)

    def own(self, key: str | Column) -> Column:
        """Block of a row, which ``key`` tells from others of its popcount."""
        piece = F.pmod(F.xxhash64(key), self._of(self._pieces, F.col("ones"))) if max(self._pieces) > 1 else F.lit(0)
        return (self.first(F.col("ones")) + piece).cast("int")


def _compared(rows: DataFrame, refs: DataFrame, n_words: int) -> DataFrame:
    """``at, ref_id, similarity``: the best of each block that a row of ``at, fp, slice, block`` is compared with.

    A task gets the rows of a slice that ask for a block, and the block: both bounded.
    """
    kind, tasks = refs.schema["ref_id"].dataType.simpleString(), _tasks(refs)
    asked = rows.select("slice", "block").distinct().join(refs, "block")
    asked = asked.select(F.col("slice").alias("to_slice"), F.col("block").alias("to_block"), "ref_id", "fp")
    # Few bytes make much work here, so the tasks are not merged by their bytes.
    left = rows.select("slice", "block", "at", "fp").repartition(tasks, "slice", "block").groupBy("slice", "block")
    right = asked.repartition(tasks, "to_slice", "to_block").groupBy("to_slice", "to_block")
    return left.cogroup(right).applyInArrow(
        lambda own, others: _best_of(own, others, n_words), f"at long, ref_id {kind}, similarity double"
    )


def nearest(
    df: DataFrame,
    refs: DataFrame,
    fp: str,
    id_col: str,
    n_bits: int,
    ref_id: str = "ref_id",
    ref_fp: str = "ref_fp",
    out: str = "nearest",
) -> DataFrame:
    """Most similar reference of each row (ties: smallest id) and its similarity.

    References are dealt out to blocks of like popcount, distinct fingerprints
    of the rows to slices. A row first meets the block of its own popcount; the
    similarity found there bounds the popcounts that could do as well, and it
    meets the blocks in between. Slices and blocks meet in a shuffle and are
    compared by matrix products; a row's best of all blocks is folded. What
    reaches the driver is one count per popcount. References without an id or a
    fingerprint are none; a row without a fingerprint is like an empty one.
    """
    n_words = n_bits // WORD
    slim = refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_fp).alias("fp")).filter("ref_id IS NOT NULL AND fp IS NOT NULL")
    slim = materialize(slim.groupBy("fp").agg(F.min("ref_id").alias("ref_id")).withColumn("ones", popcount("fp", n_words)).filter("ones IS NOT NULL"), "references")
    dealt = Blocks(slim, n_bits)
    names = [f"{out}_id", f"{out}_similarity"]
    if not dealt.n:
        return df.withColumns({names[0]: F.lit(None).cast(slim.schema["ref_id"].dataType), names[1]: F.lit(None).cast("double")})
    blocks = slim.select("ref_id", "fp", dealt.own("ref_id").alias("block"))
    empty = F.array(*[F.lit(0).cast("long")] * n_words)
    keys = df.select(F.coalesce(F.col(fp), empty).alias("fp")).distinct()
    keys = materialize(keys.select("fp", popcount("fp", n_words).alias("ones"), F.monotonically_increasing_id().alias("at")), "rows")
    n = keys.count()
    slices = max(-(-n // ROW_SLICE), min(-(-n // REFERENCE_BLOCK), -(-_tasks(df) // dealt.n)), 1)
    keys = keys.withColumn("slice", F.pmod(F.xxhash64("at"), F.lit(slices)))
    home = keys.withColumn("block", dealt.first(F.col("ones")))
    found = _compared(home, blocks, n_words)
    if dealt.n > 1:
        found = materialize(found, "home")
        best, ones = F.coalesce("similarity", F.lit(0.0)), F.col("ones")
        low = F.when(best > 0, dealt.first(F.ceil(best * ones - 1e-6))).otherwise(F.lit(0))
        high = F.when(best > 0, dealt.last(F.floor(F.least(ones / best, F.lit(float(n_bits))) + 1e-6))).otherwise(F.lit(dealt.n - 1))
        more = home.join(found.select("at", "similarity"), "at", "left").withColumnRenamed("block", "met")
        more = more.select("at", "fp", "slice", "met", F.explode(F.sequence(low, high)).alias("block"))
        found = found.unionByName(_compared(more.filter("block <> met"), blocks, n_words))
    pick = F.min_by(F.struct("ref_id", "similarity"), F.struct(-F.col("similarity"), F.col("ref_id"))).alias("__best")
    best = keys.join(found.groupBy("at").agg(pick), "at").select(F.col("fp").alias("__fp"), "__best")
    joined = df.join(best, F.coalesce(df[fp], empty) == best["__fp"], "left")
    return joined.withColumns({names[0]: F.col("__best.ref_id"), names[1]: F.col("__best.similarity")}).drop("__best", "__fp")


def nearest_per_group(
    df: DataFrame, refs: DataFrame, groups: list, group: str, fp: str, id_col: str, n_bits: int, **names: str
) -> DataFrame:
    """Smallest distance to each of several named reference groups, one column each."""
    out = df
    for g in groups:
        out = nearest(out, refs.filter(F.col(group) == g), fp, id_col, n_bits, out=f"__{g}", **names)
        out = out.withColumn(f"distance_{g}", 1.0 - F.col(f"__{g}_similarity")).withColumnRenamed(
            f"__{g}_id", f"nearest_{g}_id"
        )
        out = out.drop(f"__{g}_similarity")
    return out


def assign_leader(
    df: DataFrame, leaders: DataFrame, fp: str, id_col: str, n_bits: int, leader_id: str, leader_fp: str, cols: list[str]
) -> DataFrame:
    """Nearest cluster leader of each row, whose cluster columns it inherits."""
    near = nearest(df, leaders, fp, id_col, n_bits, leader_id, leader_fp, out="leader")
    info = leaders.select(F.col(leader_id).alias("leader_id"), *cols)
    return near.join(info, "leader_id", "left")


# Pairs above a similarity.


def copies(df: DataFrame, id_col: str, fp: str) -> DataFrame:
    """One row per distinct fingerprint: smallest id and number of copies.

    Comparing copies with each other is pointless and, for a hot fingerprint,
    quadratic; they are carried as a count and found again by the fingerprint.
    """
    return df.groupBy(fp).agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies"))


def _with_prefix(df: DataFrame, fp: str, rank_of: Column, threshold: float, n_words: int) -> DataFrame:
    """Add popcount, size band and the rarest ones that a partner must share one of."""
    n = F.col("__n")
    keep = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1
    width = np.log(1.0 / threshold) if threshold > 0 else None
    band = F.floor(F.ln(n.cast("double")) / F.lit(float(width)) + 1e-9).cast("int") if width else F.lit(0)
    ranked = F.array_sort(F.transform(ones(F.col(fp), n_words), lambda p: F.get(rank_of, p)))
    return (
        df.withColumn("__n", popcount(fp, n_words))
        .withColumn("__prefix", F.slice(ranked, F.lit(1), F.least(keep, n)))
        .withColumn("__band", band)
    )


def _joined_above(a: DataFrame, b: DataFrame, threshold: float, n_words: int, ordered: bool, least: float) -> DataFrame | None:
    """``id_a, id_b, copies_a, copies_b, similarity`` of the pairs, by a join on rare bits; None above ``least`` rows joined.

    Exact prefix filter (Chaudhuri et al. 2006, Bayardo et al. 2007): with ones
    ordered from rare to common, two fingerprints that similar share one of their
    first n - ceil(t n) + 1 ones, and their sizes differ by a factor of at most
    1/t. So candidates meet in an equi-join on (rare bit, size band); common bits,
    the hot keys, are last in every list and mostly not in it. A pair is emitted
    only at its first shared bit, so nothing has to be de-duplicated. How many
    rows the join makes is counted first, from one row per bit and band.
    """
    n_bits = n_words * WORD
    counted = a.select("fp").union(b.select("fp"))
    per_bit = dict(  # at most one row per bit
        counted.select(F.explode(ones(F.col("fp"), n_words)).alias("bit")).groupBy("bit").count().collect()
    )
    rank = [0] * n_bits
    for r, bit in enumerate(sorted(range(n_bits), key=lambda i: (per_bit.get(i, 0), i))):
        rank[bit] = r
    rank_of = F.array(*[F.lit(r) for r in rank])

    left = _with_prefix(a.withColumnsRenamed({"id": "id_a", "fp": "fp_a", "n": "copies_a"}), "fp_a", rank_of, threshold, n_words)
    right = _with_prefix(b.withColumnsRenamed({"id": "id_b", "fp": "fp_b", "n": "copies_b"}), "fp_b", rank_of, threshold, n_words)
    left = left.withColumnsRenamed({"__n": "n_a", "__prefix": "p_a", "__band": "band_a"})
    right = right.withColumnsRenamed({"__n": "n_b", "__prefix": "p_b", "__band": "band"})
    near = F.array(F.col("band_a") - 1, F.col("band_a"), F.col("band_a") + 1) if threshold > 0 else F.array("band_a")
    on = ["token", "band"]
    per_key = lambda df, band, p, n: df.select(band, p).withColumn("token", F.explode(p)).groupBy(*on).agg(F.count("*").alias(n))
    asking = per_key(left, F.explode(near).alias("band"), "p_a", "asking")
    made = asking.join(per_key(right, "band", "p_b", "met"), on).agg(F.sum(F.col("asking").cast("double") * F.col("met")).alias("n"))
    if (made.first().n or 0.0) > least:
        return None

    # The join multiplies its rows, so they start out dealt over all tasks, even
    # when the other side is small enough to be sent to them.
    probes = left.repartition(_tasks(a), "id_a").withColumn("band", F.explode(near)).withColumn("token", F.explode("p_a"))
    entries = right.withColumn("token", F.explode("p_b"))
    t = F.lit(threshold)
    sizes = (F.col("n_a") * t <= F.col("n_b") + 1e-9) & (F.col("n_b") * t <= F.col("n_a") + 1e-9)
    joined = probes.join(entries, on).filter(sizes)
    if ordered:
        joined = joined.filter("id_a < id_b")
    sim = tanimoto("fp_a", "fp_b", n_words)
    kept = joined.withColumn("similarity", sim).filter(F.col("similarity") >= t - 1e-12)
    first = F.array_min(F.array_intersect("p_a", "p_b")) == F.col("token")
    return kept.filter(first).select("id_a", "id_b", "copies_a", "copies_b", "similarity")


def shared_needed(n_bits: int, threshold: float) -> np.ndarray:
    """By the sum of two popcounts: ones that must be shared for the similarity; never none, ``n_bits`` + 1 if it can't be."""
    both, total = np.arange(1, n_bits + 1)[None, :], np.arange(2 * n_bits + 1)[:, None]
    reached = (2 * both <= total) & (both / np.maximum(total - both, 1) >= threshold - 1e-12)
    return np.where(reached.any(axis=1), reached.argmax(axis=1) + 1, n_bits + 1).astype(np.uint16)


def _similar(x: np.ndarray, y: np.ndarray, needed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices of the pairs that share enough ones, and their similarity, some rows of ``x`` at a time."""
    y = np.asfortranarray(y)
    ones_x, ones_y = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for n in np.unique(ones_x):
        alike, least = np.flatnonzero(ones_x == n), needed[n + ones_y]
        for lo in range(0, len(alike), step):
            some = alike[lo : lo + step]
            both = _shared(x[some], y)
            i, j = np.nonzero(both >= least)
            shared = both[i, j].astype(np.float64)
            yield some[i], j, shared / (n + ones_y[j] - shared)


def _best_hits(x: pa.Table, y: pa.Table, hits: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The hit of the largest similarity of each row of ``x``; ties go to the smallest id in ``y``, a null one first."""
    place = np.empty(y.num_rows, np.int64)
    place[pa.compute.sort_indices(y["id"], null_placement="at_start").to_numpy()] = np.arange(y.num_rows)
    for i, j, sim in hits:  # all of a row's hits come together
        order = np.lexsort((place[j], -sim, i))
        kept = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        yield i[kept], j[kept], sim[kept]


def _blocks_above(a: DataFrame, b: DataFrame | None, threshold: float, n_words: int, best: bool) -> DataFrame:
    """``id_a, id_b, copies_a, copies_b, similarity`` of the pairs, or only the best of a row in each block.

    Both sides lie in blocks of like popcount. A row meets the blocks whose
    popcounts are within the factor of the threshold; with ``b`` None its own and
    those above, so that every pair meets once. A task gets two blocks at a
    time, compares them in word arithmetic and hands pairs on as they come: what it
    holds does not depend on how many there are.
    """
    n_bits = n_words * WORD
    counted = lambda df: df.withColumn("ones", popcount("fp", n_words))
    a, same, kind = counted(a), b is None, a.schema["id"].dataType.simpleString()
    b = a if same else counted(b)
    kind_b = b.schema["id"].dataType.simpleString()
    mine = Blocks(a, n_bits)
    others = mine if same else Blocks(b, n_bits)
    schema = f"id_a {kind}, id_b {kind_b}, copies_a long, copies_b long, similarity double"
    if not mine.n or not others.n:
        return a.sparkSession.createDataFrame([], schema)
    t, ones_ = max(threshold, 1.0 / n_bits), F.col("ones")
    low = mine.own("fp") if same else others.first(F.ceil(ones_ * t - 1e-6))
    high = others.last(F.floor(F.least(ones_ / F.lit(t), F.lit(float(n_bits))) + 1e-6))
    x = a.select("id", "fp", "n", mine.own("fp").alias("slice"), F.explode(F.sequence(low, F.greatest(low, high))).alias("block"))
    x = materialize(x, "asking")
    y = x.select("slice", "block").distinct().join(b.select("id", "fp", "n", others.own("fp").alias("block")), "block")
    sides = x.select("slice", "block", F.col("id").alias("x"), F.lit(None).cast(kind_b).alias("y"), "fp", "n", F.lit(True).alias("asks"))
    sides = sides.union(y.select("slice", "block", F.lit(None).cast(kind), "id", "fp", "n", F.lit(False)))
    needed = shared_needed(n_bits, threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        side = lambda asks, name: both.filter(both["asks"] if asks else pa.compute.invert(both["asks"])).rename_columns({name: "id"})
        left, right = side(True, "x"), side(False, "y")
        if not left.num_rows or not right.num_rows:
            return
        within = same and left["slice"][0] == left["block"][0]
        if within:
            right = left
        hits = _similar(_words(left["fp"], n_words), _words(right["fp"], n_words), needed)
        held, n = [], 0
        for hit in _best_hits(left, right, hits) if best else hits:
            held.append(tuple(v[hit[0] < hit[1]] for v in hit) if within else hit)
            n += len(held[-1][0])
            if n >= PAIRS_HELD:
                yield _paired(left, right, held)
                held, n = [], 0
        if n:
            yield _paired(left, right, held)

    tasks = max(_tasks(a), mine.n * others.n // BLOCKS_A_TASK)
    return sides.repartition(tasks, "slice", "block").groupBy("slice", "block").applyInArrow(compare, schema)


def _paired(left: pa.Table, right: pa.Table, hits: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    i, j, sim = (np.concatenate(v) for v in zip(*hits, strict=True))
    of = lambda table, name, at: table[name].combine_chunks().take(pa.array(at))
    columns = {"id_a": of(left, "id", i), "id_b": of(right, "id", j), "copies_a": of(left, "n", i), "copies_b": of(right, "n", j)}
    return pa.RecordBatch.from_pydict({**columns, "similarity": pa.array(sim)})


def _pairs_above(a: DataFrame, b: DataFrame | None, threshold: float, n_words: int, best: bool = False) -> DataFrame:
    """Pairs of ``a`` and ``b`` (``id, fp, n``: distinct fingerprints), or inside ``a``, at or above ``threshold`` (above 0 for 0).

    Two exact ways. Where fingerprints are sparse and the threshold is high, few
    pairs share a rare bit and the join on these bits is cheapest. Near the
    similarity of unrelated fingerprints nearly all do, a pair several times
    over; then blocks are compared, which costs the number of pairs and no more.
    """
    size = a.count() * (1.0 if b is None else b.count())
    pairs = _joined_above(a, a if b is None else b, threshold, n_words, b is None, size * n_words / JOINED_ROW)
    return _blocks_above(a, b, threshold, n_words, best) if pairs is None else pairs


def pairwise(
    x: DataFrame, y: DataFrame | None, fp: str, id_col: str, n_bits: int, max_distance: float
) -> DataFrame:
    """Pairs within ``max_distance``: ``id_a, id_b, distance, copies_a, copies_b``.

    One row per pair of distinct fingerprints, named by their smallest ids. With
    ``y`` None the pairs inside ``x``, each once.
    """
    if max_distance >= 1:
        raise ValueError("keep only pairs below a distance of 1")
    n_words = n_bits // WORD
    single = lambda d: materialize(
        copies(d.filter(popcount(fp, n_words) > 0), id_col, fp).select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col("n_copies").alias("n")),
        "prints",
    )
    pairs = _pairs_above(single(x), None if y is None else single(y), 1.0 - max_distance, n_words)
    out = ["id_a", "id_b", (1.0 - F.col("similarity")).alias("distance"), "copies_a", "copies_b"]
    if y is not None:
        return pairs.filter("id_a IS NOT NULL AND id_b IS NOT NULL").select(*out)
    turned = F.col("id_a") > F.col("id_b")
    put = lambda one, other: F.when(turned, F.col(other)).otherwise(F.col(one)).alias(one)
    swaps = [put("id_a", "id_b"), put("id_b", "id_a"), "similarity", put("copies_a", "copies_b"), put("copies_b", "copies_a")]
    return pairs.filter("id_a <> id_b").select(*swaps).select(*out)


def best_above(
    df: DataFrame, refs: DataFrame, fp: str, id_col: str, n_bits: int, least: float, ref_id: str = "ref_id", ref_fp: str = "ref_fp"
) -> DataFrame:
    """``id_col, nearest_id`` of the rows with a reference of similarity ``least`` or more (ties: smallest id).

    By a similarity join in word arithmetic over distinct fingerprints.
    """
    n_words = n_bits // WORD
    rows = df.select(F.col(id_col).alias("id"), F.col(fp).alias("fp")).filter(popcount("fp", n_words) > 0)
    keys = rows.groupBy("fp").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("id"), "fp", "n")
    known = refs.select(F.col(ref_id).alias("id"), F.col(ref_fp).alias("fp")).filter(popcount("fp", n_words) > 0)
    known = known.groupBy("fp").agg(F.min(F.struct("id")).alias("__id"), F.count("*").alias("n")).select("__id.id", "fp", "n")
    keys, known = materialize(keys, "prints"), materialize(known, "prints")
    pairs = _pairs_above(keys, known, least, n_words, best=True)
    order = F.struct((-F.col("similarity")).alias("s"), F.col("id_b"))
    found = pairs.groupBy("id_a").agg(F.min(order).alias("best"))
    named = keys.select("fp", F.col("id").alias("id_a")).join(found, "id_a")
    out = rows.join(named, "fp").groupBy("id").agg(F.min("best").alias("best"))
    return out.select(F.col("id").alias(id_col), F.col("best.id_b").alias("nearest_id"))


def extend_pairs(old: DataFrame, new: DataFrame, fp: str, id_col: str, n_bits: int, max_distance: float) -> DataFrame:
    """Only the pairs that new rows add: old x new and new x new."""
    between = pairwise(old, new, fp, id_col, n_bits, max_distance)
    inside = pairwise(new, None, fp, id_col, n_bits, max_distance)
    return between.unionByName(inside)


# Leader clusters.


def leader_clusters(
    df: DataFrame, fp: str, id_col: str, n_bits: int, max_distance: float
) -> DataFrame:
    """Taylor-Butina clusters: ``id, leader_id, cluster_id``.

    Order: most neighbours first, then smallest id. In rounds every open row that
    comes first among its open neighbours becomes a leader and closes them, which
    gives the leaders of the sequential rule; afterwards each row joins the first
    of its neighbouring leaders. Copies of a fingerprint act as one node. A row
    without a fingerprint has no neighbours and leads itself.
    """
    n_words = n_bits // WORD
    has = df.filter(F.col(fp).isNotNull())
    bare = df.filter(F.col(fp).isNull()).select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.lit(1).cast("long").alias("n_copies"))
    folded = copies(has, id_col, fp).select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), "n_copies")
    nodes = materialize(folded.unionByName(bare), "nodes")
    pairs = materialize(
        pairwise(nodes.filter("fp IS NOT NULL").withColumnsRenamed({"id": id_col, "fp": fp}), None, fp, id_col, n_bits, max_distance).select(
            "id_a", "id_b"
        ),
        "pairs",
    )
    sizes = nodes.select("id", "n_copies")
    both = pairs.union(pairs.select(F.col("id_b"), F.col("id_a"))).toDF("u", "v")
    around = (
        both.join(sizes.withColumnsRenamed({"id": "v"}), "v").groupBy("u").agg(F.sum("n_copies").alias("n_near"))
    )
    ordered = materialize(
        sizes.join(around, sizes.id == around.u, "left").select(
            "id",
            F.struct(
                (1 - F.col("n_copies") - F.coalesce("n_near", F.lit(0))).alias("n"), F.col("id").alias("i")
            ).alias("p"),
        ),
        "order",
    )
    # Edges point from the later to the earlier row of the order, smallest first.
    named = both.join(ordered.toDF("u", "pu"), "u").join(ordered.toDF("v", "pv"), "v")
    upward = materialize(named.filter("pv < pu").select("u", "v"), "upward")
    edges, closed = upward, []
    while not edges.isEmpty():
        blocked = edges.select(F.col("u").alias("v")).distinct()
        winners = edges.select("v").distinct().join(blocked, "v", "left_anti")
        losers = edges.join(winners, "v", "left_semi").select("u").distinct()
        gone = losers.union(winners.select(F.col("v").alias("u")))
        still = edges.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti")
        # One table per round: the edges left, and the rows closed as edges to nowhere.
        state = materialize(still.select("u", "v").unionByName(losers, allowMissingColumns=True), "round")
        closed.append(state.filter("v IS NULL").select(F.col("u").alias("id")))
        edges = state.filter("v IS NOT NULL")
    heads = ordered
    if closed:
        heads = ordered.join(reduce(lambda a, b: a.union(b), closed), "id", "left_anti")
    numbered = materialize(
        positions(heads, ["p"], name="cluster_id").select(
            F.col("id").alias("v"), (F.col("cluster_id") - 1).alias("cluster_id")
        ),
        "heads",
    )
    joined = (
        upward.join(numbered, "v")
        .groupBy("u")
        .agg(F.min(F.struct("cluster_id", F.col("v").alias("leader_id"))).alias("c"))
        .select(F.col("u").alias("id"), F.col("c.leader_id"), F.col("c.cluster_id"))
    )
    # A head has no earlier leader beside it; leaders close all their neighbours.
    own = numbered.select(F.col("v").alias("id"), F.col("v").alias("leader_id"), "cluster_id")
    assigned = joined.join(own.select("id"), "id", "left_anti").unionByName(own)
    placed = nodes.join(assigned, "id").select("id", "fp", "leader_id", "cluster_id")
    by_print = placed.filter("fp IS NOT NULL").drop("id").withColumnRenamed("fp", fp)
    alone = placed.filter("fp IS NULL").select(F.col("id").alias(id_col), "leader_id", "cluster_id")
    return has.select(id_col, fp).join(by_print, fp).select(id_col, "leader_id", "cluster_id").unionByName(alone)


# Diverse picks.


def pick_diverse(df: DataFrame, fp: str, id_col: str, score: str, n_bits: int, n: int) -> DataFrame:
    """Best row first, then n - 1 times the row with the largest mean distance to those chosen.

    Ties go to the better rank. Each row carries the sum of its distances to the
    picks so far; a round adds the distance to the newest and keeps the best row
    per task. A missing fingerprint has no ones, a row without a score comes last.
    """
    n_words = n_bits // WORD
    blank = F.array(*[F.lit(0).cast("long")] * n_words)
    late = F.coalesce(-number(score).cast("double"), F.lit(float("inf")))
    rows = materialize(
        df.filter(F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("id"), late.alias("late"), F.coalesce(fp, blank).alias("fp"), F.lit(0.0).alias("sum")
        ),
        "candidates",
    )
    order = F.struct((-F.round("mean", 12)).alias("m"), "late", F.col("id").alias("i"))
    chosen, total = [], F.col("sum")
    while len(chosen) < n:
        left = rows.filter(~F.col("id").isin([r.id for r in chosen])) if chosen else rows
        mean = total / F.lit(float(max(len(chosen), 1)))
        best = left.withColumn("mean", mean).agg(F.min_by(F.struct("id", "fp"), order).alias("best")).first().best
        if best is None:
            break
        chosen.append(best)
        newest = F.array(*[F.lit(w).cast("long") for w in best.fp])
        total = total + (1.0 - F.coalesce(tanimoto(F.col("fp"), newest, n_words), F.lit(1.0)))
        if len(chosen) % PICKS_HELD == 0:
            rows, total = materialize(rows.withColumn("sum", total), "candidates"), F.col("sum")
    kind = df.schema[id_col].dataType.simpleString()
    picks = df.sparkSession.createDataFrame([(r.id, i) for i, r in enumerate(chosen)], f"`{id_col}` {kind}, pick_order int")
    return df.join(F.broadcast(picks), id_col)  # n rows
