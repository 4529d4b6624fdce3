"""Registered queries."""

from statewise.plans import counting, dirty, geometry, kinetics, structures  # noqa: F401
from statewise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
