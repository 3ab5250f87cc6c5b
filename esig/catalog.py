"""Registered queries of the time-series operators, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import queries_connectivity, queries_decode, queries_io, queries_runs, queries_select, queries_signals, queries_stats, queries_summary  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
