"""Registry of the named queries and their SQL twins."""

from __future__ import annotations

from pagewright.plans import events, library, mapping, matching, planning, projects, texts  # noqa: F401  they register
from pagewright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
