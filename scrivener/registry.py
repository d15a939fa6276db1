"""Queries of the text-correction engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import correction, memory, sessions

QUERIES = correction.QUERIES | memory.QUERIES | sessions.QUERIES
ORACLES = correction.ORACLES | memory.ORACLES | sessions.ORACLES
