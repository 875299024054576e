"""Registered queries of the evaluation operators and the SQL they are checked with."""

from __future__ import annotations

from gaugespark.queries import composites, inference, records, refits, relational, statistics, textual, verdicts  # noqa: F401  (they register)
from gaugespark.queries.base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = "route_pairing"
