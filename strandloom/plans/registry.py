"""All queries of the core library and their SQL."""

from __future__ import annotations

from strandloom.plans import graph_queries, sequence_queries, skew_queries

MODULES = [skew_queries, sequence_queries, graph_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
