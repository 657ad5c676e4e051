"""All catalogue queries by name, and the SQL that checks them."""

from __future__ import annotations

from . import labels, series, texts  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
