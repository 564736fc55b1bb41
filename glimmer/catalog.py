"""Queries by name with their SQL, gathered from the plan modules."""

from __future__ import annotations

from .plans import algebra, cells, movie, report, segment, stages, streams

MODULES = [movie, segment, cells, algebra, report, streams, stages]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
