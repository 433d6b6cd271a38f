"""All registered queries."""

from castwise.plans import queries_fusion, queries_routing, queries_tables, queries_windows  # noqa: F401
from castwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
