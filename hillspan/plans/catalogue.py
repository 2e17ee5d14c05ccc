"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from . import demand, networks, ranking, relational, reports, sources, studies, terrain, transit  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
