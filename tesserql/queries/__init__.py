"""The query catalogue: each query with the SQL that gives the same rows."""

from __future__ import annotations

from . import engine, functions, relational, shapes, sharding, statements

QUERIES = functions.QUERIES | relational.QUERIES | sharding.QUERIES | shapes.QUERIES | statements.QUERIES | engine.QUERIES
ORACLE_SQL = functions.ORACLE_SQL | relational.ORACLE_SQL | sharding.ORACLE_SQL | shapes.ORACLE_SQL | statements.ORACLE_SQL | engine.ORACLE_SQL
