"""Registered queries: one Spark job per key over the given tables, with its SQL twin."""

from queries import clean, joins, aggregates, ranking, scalar, metrics, sources, models, cluster, streams, prepare  # noqa: F401
from queries.base import QUERIES, SQL  # noqa: F401
