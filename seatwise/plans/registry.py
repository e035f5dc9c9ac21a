"""All queries of the engine, and SQL for those whose rows do not hang on fitted models."""

from __future__ import annotations

from . import modelled, relational

QUERIES = relational.QUERIES | modelled.QUERIES
ORACLE_SQL = dict(relational.ORACLE_SQL)
