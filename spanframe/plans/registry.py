"""Queries of the engine's own operators and their SQL, for the entry module."""

from __future__ import annotations

from . import oracle, queries

QUERIES = dict(queries.QUERIES)
ORACLES = dict(oracle.ORACLES)
