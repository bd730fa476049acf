"""Registered queries and their SQL equivalents, grouped by operator family."""

from voicegrid.plans import (  # noqa: F401  (importing registers the queries)
    columns, comparisons, correlation, enrichment, hygiene, ranking, risk, rollups, sources, streams, text,
)
from voicegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
