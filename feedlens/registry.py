"""All queries of the feedback domain and their DuckDB counterparts."""

from __future__ import annotations

from feedlens import upkeep, upkeep_sql  # noqa: F401  they add theirs
from feedlens.oracles import ORACLE_SQL
from feedlens.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
