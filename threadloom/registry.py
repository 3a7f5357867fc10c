"""Queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from .plans import derived, stateful  # noqa: F401  they register their queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
