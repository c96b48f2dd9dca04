"""Name -> query, and name -> oracle SQL, of the spatial engine."""

from __future__ import annotations

from .catalog import changes, nearest, ranges  # noqa: F401  (they register on import)
from .catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
