"""Cross-validation over models, settings and runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, functions as F

from tamis.operators.metrics import evaluation_report
from tamis.operators.splits import cv_split
from tamis.session import materialize


def grid(lists: Mapping[str, Sequence]) -> Iterator[dict]:
    """Cartesian product of settings, numbered by the caller."""
    for values in product(*lists.values()):
        yield dict(zip(lists, values))


def run_one(
    df: DataFrame,
    make: Callable[[dict], object],
    conf: dict,
    run: int,
    id_col: str,
    label: str,
    ratios: Sequence[float],
    use_val: bool = True,
    fold: str = "fold_id",
) -> DataFrame:
    """Split, fit and report one run."""
    rows = cv_split(df, run, use_val, fold)
    part = lambda name: rows.filter(F.col("split") == name)
    fitted = make(conf).fit(part("train"), part("val") if use_val else None)
    scored = fitted.score(rows).select(id_col, "split", "score", F.col(label).alias("label"))
    return evaluation_report(scored, "split", "score", "label", id_col, ratios)


def run_cv(
    df: DataFrame,
    makers: Mapping[str, Callable[[dict], object]],
    grids: Mapping[str, Mapping[str, Sequence]],
    runs: Sequence[int],
    id_col: str,
    label: str,
    ratios: Sequence[float] = (0.01,),
    use_val: bool = True,
    fold: str = "fold_id",
    parallelism: int = 4,
) -> DataFrame:
    """Metrics table ``model, setting, run, split, metric, ratio, value``.

    The fits are Spark jobs; several are submitted at a time so that small ones
    do not leave the cluster idle. Each report is written before the next step,
    so the table's plan does not hold the fits.
    """
    tasks = [
        (name, i, conf, run)
        for name, lists in grids.items()
        for i, conf in enumerate(grid(lists))
        for run in runs
    ]

    def work(task) -> DataFrame:
        name, i, conf, run = task
        report = run_one(df, makers[name], conf, run, id_col, label, ratios, use_val, fold)
        return materialize(
            report.select(F.lit(name).alias("model"), F.lit(i).alias("setting"), F.lit(run).alias("run"), "*"),
            "report",
        )

    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return reduce(lambda a, b: a.unionByName(b), pool.map(work, tasks))
