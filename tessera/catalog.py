"""Registry of the relational core's queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import boxes, matrices, numeric, strings, vectors
from tessera.operators import bundles, communities, corpus, datasets, factors, graphs, join_trees, kernels, landmarks, learners, neighbours, policies, problems, sequences, statistics
from tessera.sources import entries
from tessera.streaming import windows

_MODULES = (corpus, sequences, datasets, statistics, graphs, communities, landmarks, bundles, neighbours, policies, learners, kernels, factors, join_trees, problems, strings, vectors, numeric, matrices, boxes, windows, entries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of (spark, sf_dir)."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """Query name to SQL over the same tables."""
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.ORACLES
    return found
