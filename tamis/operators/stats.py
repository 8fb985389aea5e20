"""Independence tests and dose-response fits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tamis.functions.rows import number
from tamis.session import materialize

CATEGORY_BLOCK = 4096  # categories of one side that a task draws together
MOST_BLOCKS = 1024  # blocks of a side; with more categories the blocks grow
DRAWN_DIRECTLY = 10**9  # largest population the generator's own hypergeometric draw takes


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (series or continued fraction)."""
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


@F.pandas_udf(DoubleType())
def _tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or k <= 0 else chi2_sf(v, int(k)) for v, k in zip(x, dof)])


def _observed(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("observed"))


def expected_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected count of every combination that occurs."""
    seen = _observed(df, a, b)
    rows = seen.groupBy(a).agg(F.sum("observed").alias("row_total"))
    cols = seen.groupBy(b).agg(F.sum("observed").alias("col_total"))
    total = seen.agg(F.sum("observed").alias("n"))
    joined = seen.join(rows, a).join(cols, b).withColumn("total", total.scalar())
    expected = F.col("row_total").cast("double") * F.col("col_total") / F.col("total")
    return joined.withColumn("expected", expected)


def chi2_table(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """Chi-square of independence: ``statistic, p_value, dof``.

    Cells that do not occur add their expected count; as expected counts sum to
    n, the statistic is sum(O * O / E) - n over the cells that do occur, and no
    table of all combinations is built. One degree of freedom gets the usual
    continuity correction, where all four cells deviate by the same amount.
    """
    table = expected_counts(df, a, b)
    o, e = F.col("observed"), F.col("expected")
    sums = table.agg(
        F.count_distinct(a).alias("n_a"),
        F.count_distinct(b).alias("n_b"),
        F.max("total").alias("n"),
        F.sum(o * o / e).alias("ratio"),
        F.max(F.abs(o - e)).alias("off"),
        F.max(F.struct("row_total", "col_total")).alias("m"),
    )
    dof = ((F.col("n_a") - 1) * (F.col("n_b") - 1)).cast("int")
    plain = F.greatest(F.col("ratio") - F.col("n"), F.lit(0.0))
    r, c, n = F.col("m.row_total").cast("double"), F.col("m.col_total").cast("double"), F.col("n")
    spread = n * (1 / r + 1 / (n - r)) * (1 / c + 1 / (n - c))
    corrected = F.pow(F.greatest(F.col("off") - 0.5, F.lit(0.0)), 2) * spread
    statistic = F.when((dof == 1) & F.lit(correction), corrected).otherwise(plain)
    return (
        sums.select(statistic.alias("statistic"), dof.alias("dof"))
        .withColumn("p_value", _tail(F.col("statistic"), F.col("dof")))
        .select("statistic", "p_value", "dof")
    )


def chi2_uniform(counts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chi-square of each count column against equal counts in all rows."""
    sums = counts.agg(
        F.count("*").alias("k"),
        *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
        *[F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q_{c}") for c in cols],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(f"q_{c}") * F.col("k") / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) - F.col(f"s_{c}")).alias(
                "statistic"
            ),
            (F.col("k") - 1).cast("int").alias("dof"),
        )
        for c in cols
    ]
    return sums.select(F.inline(F.array(*rows))).withColumn(
        "p_value", _tail(F.col("statistic"), F.col("dof"))
    )


@F.pandas_udf(DoubleType())
def _log_factorial(n: pd.Series) -> pd.Series:
    return n.map(lambda v: math.lgamma(v + 1.0))


def draw_marked(rng: np.random.Generator, marked: int, others: int, n: int) -> int:
    """How many of ``n`` taken from ``marked + others`` are marked, for populations of any size.

    Beyond the generator's range the chances within 12 deviations of the mode
    are added up from their ratios; what lies outside is below 1e-30.
    """
    if marked + others < DRAWN_DIRECTLY:
        return int(rng.hypergeometric(marked, others, n))
    least, most = max(0, n - others), min(n, marked)
    if least == most:
        return least
    size = marked + others
    mode = min(max((n + 1) * (marked + 1) // (size + 2), least), most)
    deviation = math.sqrt(n * (marked / size) * (others / size) * ((size - n) / max(size - 1, 1)))
    reach = int(12 * deviation) + 20
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log(marked - k) + np.log(n - k) - np.log(k + 1) - np.log(others - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    summed = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(summed, rng.random() * summed[-1], side="right")), high - low)


def draw_colours(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """``n`` taken without replacement from an urn with so many of each colour."""
    left = int(colours.sum())
    if left < DRAWN_DIRECTLY:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out = np.zeros_like(colours)
    for j, count in enumerate(colours.tolist()):
        left -= count
        out[j] = draw_marked(rng, count, left, n)
        n -= int(out[j])
    return out


def random_cells(rng: np.random.Generator, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells above 0 of a random table with these totals: row, column and count.

    A row with more than one unit a column is drawn column by column, the units
    of all other rows are shuffled, so the work is the smaller of both.
    """
    large = np.flatnonzero(rows > len(cols))
    small = np.flatnonzero((rows > 0) & (rows <= len(cols)))
    left, found = cols.copy(), []
    for i in large:
        line = draw_colours(rng, left, int(rows[i]))
        left -= line
        at = np.flatnonzero(line)
        found.append((np.full(len(at), i), at, line[at]))
    if len(small):
        # Columns keep at most as many units as the small rows have.
        units = rng.permutation(np.repeat(np.arange(len(cols)), left))
        cell = np.repeat(small, rows[small]) * len(cols) + units
        cell, count = np.unique(cell, return_counts=True)
        found.append((cell // len(cols), cell % len(cols), count))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate([f[part] for f in found]) for part in range(3))


def log_weight(counts: np.ndarray) -> float:
    """Minus the sum of log n! over the cells."""
    values, times = np.unique(counts, return_counts=True)
    return -float(sum(math.lgamma(v + 1.0) * t for v, t in zip(values.tolist(), times.tolist())))


def _blocks(seen: DataFrame, side: str, name: str) -> tuple[DataFrame, np.ndarray]:
    """Totals of one side in blocks of bounded size (``name, totals``), and the blocks' own totals."""
    totals = seen.groupBy(side).agg(F.sum("observed").alias("n"))
    n = totals.count()
    if n < 2:
        raise ValueError("the test needs two categories on both sides")
    size = max(CATEGORY_BLOCK, -(-n // MOST_BLOCKS))
    block = F.pmod(F.xxhash64(side), F.lit(-(-n // size))).cast("int")
    listed = F.sort_array(F.collect_list(F.struct(F.col(side).alias("category"), "n")))
    blocks = materialize(totals.groupBy(block.alias(name)).agg(F.transform(listed, lambda s: s["n"]).alias("totals")), "margins")
    sums = blocks.select(name, F.aggregate("totals", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).collect()
    whole = np.zeros(1 + max(r[0] for r in sums), dtype=np.int64)  # at most MOST_BLOCKS numbers
    for at, total in sums:
        whole[at] = total
    return blocks, whole


def perm_test(df: DataFrame, a: str, b: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Fisher's exact test with a simulated p-value: ``statistic, p_value, replicates``.

    Shuffling the labels of all rows gives tables with fixed totals; those are
    drawn directly, so a replicate costs the size of the table, or of the data
    if that is smaller. The statistic is the log probability of the table up to
    a constant.

    No side has a limit: its categories are dealt to blocks, and a replicate is
    drawn as a tree. First the table of block by block, then the shares of the
    categories of each block in every block of the other side, and last the
    cells of each pair of blocks, which its shares alone decide. Tasks draw the
    parts, each with a random stream of its own, so a part that is lost comes
    out the same again; the driver sees the blocks' totals only.
    """
    seen = materialize(_observed(df, a, b), "cells")
    found = seen.agg((-F.sum(_log_factorial("observed"))).alias("s")).first().s
    if found is None:
        raise ValueError("the test needs two categories on both sides")
    rows, row_totals = _blocks(seen, a, "p")
    cols, col_totals = _blocks(seen, b, "q")

    def pairs_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                p, q, n = random_cells(np.random.default_rng([seed, int(i), 0]), row_totals, col_totals)
                yield pd.DataFrame({"id": int(i), "p": p, "q": q, "n": n})

    def shares_of(kind: int, mine: str, other: str):
        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i, block, totals, parts in zip(batch["id"], batch[mine], batch["totals"], batch["parts"]):
                    to, n = (np.array([part[k] for part in parts], dtype=np.int64) for k in (other, "n"))
                    rng = np.random.default_rng([seed, int(i), kind, int(block)])
                    category, at, count = random_cells(rng, np.asarray(totals, dtype=np.int64), n)
                    order = np.lexsort((category, at))
                    at, count, cuts = at[order], count[order], np.searchsorted(at[order], np.arange(len(to) + 1))
                    yield pd.DataFrame(
                        {"id": i, mine: block, other: to, f"{mine}_shares": [count[x:y] for x, y in zip(cuts, cuts[1:])]}
                    )

        return draw

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, p, q, x, y in zip(batch["id"], batch["p"], batch["q"], batch["p_shares"], batch["q_shares"]):
                rng = np.random.default_rng([seed, int(i), 3, int(p), int(q)])
                out.append(log_weight(random_cells(rng, np.asarray(x), np.asarray(y))[2]))
            yield pd.DataFrame({"id": batch["id"], "s": out})

    spark = df.sparkSession
    met = materialize(spark.range(replicates).mapInPandas(pairs_of_blocks, "id long, p int, q int, n long"), "blocks")

    def shares(blocks: DataFrame, kind: int, mine: str, other: str) -> DataFrame:
        parts = met.groupBy("id", mine).agg(F.sort_array(F.collect_list(F.struct(other, "n"))).alias("parts"))
        schema = f"id long, {mine} int, {other} int, {mine}_shares array<long>"
        return parts.join(blocks, mine).mapInPandas(shares_of(kind, mine, other), schema)

    both = shares(rows, 1, "p", "q").join(shares(cols, 2, "q", "p"), ["id", "p", "q"])
    draws = both.mapInPandas(weigh, "id long, s double").groupBy("id").agg(F.sum("s").alias("s"))
    near = found * (1 + 1e-7) if found > 0 else found * (1 - 1e-7)
    return draws.agg(
        F.lit(float(found)).alias("statistic"),
        ((F.count_if(F.col("s") <= near) + 1) / F.lit(replicates + 1.0)).alias("p_value"),
        F.count("*").alias("replicates"),
    )


def hill(dose, midpoint, slope, bottom: float, top: float):
    """Response that falls from ``top`` to ``bottom`` as the dose passes the midpoint; of numbers or columns."""
    return bottom + (top - bottom) / (1.0 + (dose / midpoint) ** slope)


def fit_hill(
    df: DataFrame,
    compound: str,
    dose: str,
    response: str,
    midpoints: Sequence[float],
    slopes: Sequence[float],
    bottom: float = 0.0,
    top: float = 180.0,
    refine: int = 0,
) -> DataFrame:
    """Hill curve per compound with fixed ends: ``midpoint, slope, sse, n``.

    The squared error depends on the readings only through count, sum and sum of
    squares per dose, so readings are folded to one row per dose first, however
    many a compound has. These rows lie together by compound, so the errors of
    all grid points are added up without another shuffle and without a list of
    doses. The best point (ties: smaller midpoint, then slope) is optionally
    refined by grids of a third of the previous spacing around it. Readings
    without a number or a dose do not count; rows without a compound are one.
    """
    readings = df.select(
        F.col(compound).alias("compound"), number(dose).cast("double").alias("dose"), number(response).cast("double").alias("y")
    ).na.drop(subset=["dose", "y"])
    moments = (
        readings.groupBy("compound", "dose")
        .agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
        .repartition("compound")
    )
    if refine:
        moments = materialize(moments, "doses")

    def best_of(rows: DataFrame, points: list[tuple[Column, Column]]) -> DataFrame:
        """The point with the least error, of a grid that may depend on the row's compound."""
        listed = F.array(*[F.struct(m.alias("midpoint"), h.alias("slope")) for m, h in points])
        grid = F.inline(F.array_distinct(listed))  # points may fall together at the least slope
        f = hill(F.col("dose"), F.col("midpoint"), F.col("slope"), bottom, top)
        error = F.col("q") - 2 * f * F.col("s") + F.col("n") * f * f
        errors = rows.select("compound", "dose", "n", "s", "q", grid).groupBy("compound", "midpoint", "slope").agg(
            F.round(F.sum(error), 6).alias("sse"), F.sum("n").alias("n")
        )
        return errors.groupBy("compound").agg(F.min(F.struct("sse", "midpoint", "slope", "n")).alias("best"))

    best = best_of(moments, [(F.lit(float(m)), F.lit(float(h))) for m in midpoints for h in slopes])
    step_m = (max(midpoints) / min(midpoints)) ** (1 / max(len(midpoints) - 1, 1))
    step_h = (max(slopes) - min(slopes)) / max(len(slopes) - 1, 1)
    for _ in range(refine):
        step_m, step_h = step_m ** (1 / 3), step_h / 3
        near_m = [F.col("best.midpoint") * float(step_m**k) for k in range(-3, 4)]
        near_h = [F.greatest(F.col("best.slope") + float(step_h * k), F.lit(1e-3)) for k in range(-3, 4)]
        centres = materialize(best.withColumnRenamed("compound", "of"), "centres")
        around = moments.join(centres, F.col("compound").eqNullSafe(F.col("of")))
        best = best_of(around, [(m, h) for m in near_m for h in near_h])
    return best.select(F.col("compound").alias(compound), "best.midpoint", "best.slope", "best.sse", "best.n")
