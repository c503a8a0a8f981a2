"""Registered queries over the driver's tables and their DuckDB counterparts."""

from pagequarry.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
