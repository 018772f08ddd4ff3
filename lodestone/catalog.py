"""All queries of the engine, from the modules under ``plans``."""

from __future__ import annotations

from .plans import analysis, answers, formulas, fulltext, ingest, keyed, retrieval, rules, scoring, tables  # noqa: F401
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
