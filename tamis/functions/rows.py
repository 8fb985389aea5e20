"""Row-wise arithmetic over replicate, price, distance and label columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Both replicates must reach the level of a tier.
TIER_LEVELS = {"strong": 72.0, "normal": 50.0, "weak": 35.0}


def _cols(columns: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def number(column: str | Column) -> Column:
    """The column with NaN as NULL: NaN is no reading, no score and no vote."""
    c = _cols([column])[0]
    return F.when(~F.isnan(c.cast("double")), c)


def row_sum(columns: Sequence[str | Column]) -> Column:
    """Sum that takes a missing value as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in _cols(columns)])


def row_mean(columns: Sequence[str | Column]) -> Column:
    """Mean of the values present; NULL when there are none."""
    cols = _cols(columns)
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(present > 0, row_sum(cols) / present)


def row_min(columns: Sequence[str | Column]) -> Column:
    """Smallest of the values present."""
    cols = _cols(columns)
    return F.least(*cols) if len(cols) > 1 else cols[0]


def hit_flag(first: str | Column, second: str | Column, clean: str | Column, level: float = 50.0) -> Column:
    """1 when both replicates reach the level and no alert was raised."""
    a, b, ok = _cols([first, second, clean])
    return F.coalesce((a >= level) & (b >= level) & (ok == 1), F.lit(False)).cast("int")


def activity_tier(first: str | Column, second: str | Column, clean: str | Column) -> Column:
    """strong, normal, weak or none; the highest tier reached by both replicates."""
    a, b, ok = _cols([first, second, clean])
    tier = F
    for name, level in TIER_LEVELS.items():
        tier = tier.when((ok == 1) & (a >= level) & (b >= level), name)
    return tier.otherwise("none")


def yes_no(answer: str | Column, yes: str = "Yes") -> Column:
    (c,) = _cols([answer])
    return F.when(c == yes, 1.0).otherwise(0.0)


def to_inhibition(percent_of_control: str | Column) -> Column:
    (c,) = _cols([percent_of_control])
    return F.lit(100.0) - c


def round_percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.lit(100.0) * part / whole, digits)


def stack_labels(columns: Sequence[str | Column]) -> Column:
    """Several labels as one numeric array."""
    return F.array(*[c.cast("double") for c in _cols(columns)])


def flatten_tensor(tensor: str | Column, n_grams: int, sum_segments: bool = False) -> Column:
    """Nested array [gram][projection][segment] to a flat one, column-major.

    Only the first ``n_grams`` grams stay; with ``sum_segments`` the last axis
    is summed first. Column-major: the gram index runs fastest, then projection,
    then segment.
    """
    (t,) = _cols([tensor])
    kept = F.slice(t, 1, n_grams)
    if sum_segments:
        kept = F.transform(
            kept,
            lambda g: F.transform(
                g, lambda p: F.array(F.aggregate(p, F.lit(0.0), lambda a, x: a + x))
            ),
        )
    projections = F.sequence(F.lit(0), F.size(kept[0]) - 1)
    segments = F.sequence(F.lit(0), F.size(kept[0][0]) - 1)
    return F.flatten(
        F.transform(
            segments,
            lambda s: F.flatten(
                F.transform(projections, lambda p: F.transform(kept, lambda g: F.get(F.get(g, p), s)))
            ),
        )
    )
