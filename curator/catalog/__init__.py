"""Registered queries, one or more per operator of the inventory."""

from curator.catalog import aggregates, functions, joins, plans, provenance, rendering, scoring, sources, stories, streams, windows  # noqa: F401
from curator.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
