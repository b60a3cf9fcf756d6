"""Queries over the benchmark tables, one or more per operator."""

from catalog import keyed, landing, reports, rules, scalars, summaries  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
