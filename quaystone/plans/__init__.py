"""Queries by name, each with its DuckDB SQL where SQL can express it."""

from quaystone.plans import features, lake, metrics, scoring, streams, training  # noqa: F401
from quaystone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
