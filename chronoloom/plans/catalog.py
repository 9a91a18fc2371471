"""All queries of the library by name, with their DuckDB twins."""

from __future__ import annotations

from . import cleaning, frequencies, gridding, leaderboard, learning, mixing_laws, normalising, overlaps, recipes, recurrences, relations, sampling, scans, scoring, streams, text_sources  # noqa: F401
from .base import ORACLES, QUERIES

FLAGSHIP = "naive_backtest"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
