"""Every registered query of the library and its DuckDB twin."""

from __future__ import annotations

from . import corpus, training  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
