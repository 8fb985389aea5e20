"""Near duplicates by SimHash fingerprints and ball hashing that meets in the middle.

Two fingerprints within ``radius`` bits have a value within half the radius of
both. Every distinct fingerprint therefore stands for its ball: all variants
with at most ``radius // 2`` flipped bits. Variants are shuffled by their first
bits: a fingerprint goes to each prefix that its ball reaches, and the task of a
prefix makes the variants that begin with it, sorts them and links fingerprints
that meet. Meeting at a variant proves a distance of at most ``radius``, and the
links are verified besides. A prefix whose fingerprints make too many variants
for one task is lengthened and dealt out again until none is; a full variant is
met by one ball of fingerprints at most, so this ends. Components of the links
take the smallest id.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.graph import components
from tamis.llm.sieve import marks, split
from tamis.llm.text import arrow_map, named, utf8
from tamis.session import materialize

BITS = 64
GROUP_VARIANTS = 1 << 21  # variants that a task makes at once
STEP = 6  # bits by which a crowded prefix grows


def fingerprint(words: list[bytes], width: int, digest) -> int:
    """Majority per bit over the hashes of all ``width``-word shingles, repeats included."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        hashes = [digest(joined)]
    else:
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        hashes = [digest(joined[s:e]) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, name: str = "fp"
) -> DataFrame:
    """``id_col`` and the SimHash of the whole text, A-Z lower-cased, as a signed long.

    Shingles of ``width`` words are joined by spaces and hashed with XXH64; a
    text with fewer words is one shingle, a null text or one without words has
    fingerprint 0.
    """
    body = named(docs.select(id_col), "body")

    def each(chunk) -> dict:
        import xxhash

        def digest(shingle: bytes) -> int:
            return xxhash.xxh64_intdigest(shingle, seed)

        found = [fingerprint(t.lower().split(), width, digest) for t in chunk.column(body).to_pylist()]
        return {name: pa.array(np.array(found, np.uint64).view(np.int64))}

    return arrow_map(docs.select(id_col, utf8(F.col(text_col)).alias(body)), each, f"{name} bigint", body, [id_col])


def flips(bits: int, low: int, most: int) -> list[int]:
    """Masks with at most ``most`` of the ``bits`` bits from bit ``low`` on, fewest first."""
    spots = [1 << (low + i) for i in range(bits)]
    return [sum(c) for n in range(most + 1) for c in combinations(spots, n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _meet(fps: np.ndarray, prefix: int, depth: int, half: int, masks: np.ndarray) -> np.ndarray:
    """Links ``(n, 2)`` among fingerprints whose balls share a variant beginning with ``prefix``.

    ``masks`` flip the bits after the prefix, fewest flips first.
    """
    rest = BITS - depth
    top = (fps >> np.uint64(rest)) if rest < BITS else np.zeros(len(fps), np.uint64)
    used = np.bitwise_count(top ^ np.uint64(prefix)) if depth else np.zeros(len(fps), np.uint8)
    low = fps & np.uint64((1 << rest) - 1)
    upto = np.cumsum([comb(rest, n) for n in range(half + 1)])
    variants, owners = [], []
    for spent in range(half + 1):
        mine = np.flatnonzero(used == spent)
        if len(mine):
            some = masks[: upto[half - spent]]
            variants.append((low[mine][:, None] ^ some).ravel())
            owners.append(np.repeat(mine.astype(np.int32), len(some)))
    if not variants:
        return np.zeros((0, 2), np.uint64)
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    pairs = np.unique(np.sort(np.stack([owners[same], owners[same + 1]], 1), axis=1), axis=0) if len(same) else np.zeros((0, 2), np.int32)
    return fps[pairs]


def _span(links: np.ndarray) -> np.ndarray:
    """Links of a spanning forest of the same components, each to its component's least."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in links.tolist():
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    out = [(x, find(x)) for x in list(up)]
    return np.array([p for p in out if p[0] != p[1]], np.uint64).reshape(-1, 2)


def ball_links(distinct: DataFrame, radius: int, fp_col: str = "fp", group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within ``radius`` bits, directly or through others.

    ``distinct`` has each fingerprint once. Two fingerprints within ``radius``
    bits are always connected; a link stands for a chain of verified pairs.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even: two equal halves meet in the middle")
    ball = sum(comb(BITS, k) for k in range(half + 1))
    n = distinct.count()
    depth = min(BITS, max(0, (8 * n * ball // group_variants).bit_length()))
    rows = distinct.select(F.col(fp_col).alias("fp"), F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"))
    rows = _deepen(rows, 0, depth, half)
    parts = []
    while True:
        sums = rows.groupBy("prefix").agg(F.sum(_cost(depth, half)).alias("variants"))
        crowded = materialize(sums.filter(F.col("variants") > group_variants).select("prefix"), "crowded")
        if depth == BITS or crowded.isEmpty():
            parts.append(_linked(rows, depth, half, radius))
            break
        parts.append(_linked(rows.join(crowded, "prefix", "left_anti"), depth, half, radius))
        deeper = min(BITS, depth + STEP)
        rows = materialize(_deepen(rows.join(crowded, "prefix", "left_semi"), depth, deeper, half), "balls")
        depth = deeper
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _spent(depth: int) -> Column:
    """Bits by which the prefix differs from the fingerprint's own."""
    if not depth:
        return F.lit(0)
    return F.bit_count(F.shiftrightunsigned("fp", BITS - depth).bitwiseXOR(F.col("prefix")))


def _cost(depth: int, half: int) -> Column:
    """Variants of the fingerprint that begin with the prefix."""
    rest = BITS - depth
    sizes = [sum(comb(rest, k) for k in range(left + 1)) for left in range(half, -1, -1)]
    return F.element_at(F.array(*[F.lit(s).cast("long") for s in sizes]), _spent(depth) + 1)


def _deepen(rows: DataFrame, depth: int, deeper: int, half: int) -> DataFrame:
    """Each row once per longer prefix that its ball still reaches."""
    if deeper == depth:
        return rows
    more = deeper - depth
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in flips(more, 0, half)])
    own = F.shiftrightunsigned("fp", BITS - deeper).bitwiseAND(F.lit((1 << more) - 1).cast("long")) if more < BITS else F.col("fp")
    base = F.shiftleft("prefix", more).bitwiseOR(own)
    wider = rows.select("fp", base.alias("base"), F.explode(masks).alias("mask"))
    wider = wider.select("fp", F.col("base").bitwiseXOR(F.col("mask")).alias("prefix"), F.lit(deeper).alias("depth"))
    return wider.filter(_spent(deeper) <= half)


def _linked(rows: DataFrame, depth: int, half: int, radius: int) -> DataFrame:
    masks = np.array(flips(BITS - depth, 0, half), np.uint64)

    def run(key, group):
        fps = group["fp"].to_numpy().view(np.uint64)
        links = _meet(fps, key[0].as_py() & ((1 << BITS) - 1), depth, half, masks) if len(fps) > 1 else np.zeros((0, 2), np.uint64)
        if len(links):
            close = np.bitwise_count(links[:, 0] ^ links[:, 1]) <= radius
            links = _span(links[close])
        links = links.view(np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(links[:, 0].copy()), "b": pa.array(links[:, 1].copy())})

    return rows.select("prefix", "fp").groupBy("prefix").applyInArrow(run, "a bigint, b bigint")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
    width: int = 4,
    seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, fingerprint`` (16 hex digits) ``, component_id``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked,
    and ``component_id`` is the smallest id reachable. Documents with equal
    fingerprints are one node of the search. Rows without an id link like others
    but name no component; a component without any id has null. An empty table
    gives an empty table.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width, seed).withColumnRenamed(id_col, "id"), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(ball_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(placed.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
    width: int = 4,
    seed: int = 42,
) -> DataFrame:
    """One row of each group of ``near_groups``, all columns unchanged: that with the smallest id.

    Rows without an id stay only where no row of the group has one; of rows
    with equal ids the least text stays, of rows equal in that too any one.
    Texts without words, null ones included, are a group. Only rows whose id
    belongs to a group of two rows or more are moved, folded per task by
    fingerprint first. An empty table stays empty.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width, seed).withColumnRenamed(id_col, "id"), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.count("*").alias("n")), "nodes")
    roots = components(ball_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = materialize(nodes.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
    several = placed.groupBy("root").agg(F.sum("n").alias("rows")).filter("rows > 1").select("root")
    groups = materialize(placed.join(several, "root").select("fp", "root"), "groups")
    may, others = split(docs, F.xxhash64(id_col), marks(prints.join(groups, "fp").select(F.xxhash64("id").alias("key"))))
    found = fingerprints(may.select("row", F.col("row")[text_col].alias("text")), "row", "text", width, seed)
    pick = F.min_by("row", F.struct(F.col("row")[id_col].isNull(), F.col("row")[id_col], F.col("row")[text_col])).alias("row")
    first = found.groupBy("fp").agg(pick).join(groups, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "row")
    return first.groupBy("root").agg(pick).select("row.*").unionByName(others.select("row.*"))
