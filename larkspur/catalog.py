"""The registry of queries over the driver tables and of their SQL forms."""

from __future__ import annotations

from .plans import clean, cutoffs, history, interests, learned, models, rows, stats, stream  # noqa: F401  registers their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
