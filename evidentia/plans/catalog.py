"""Named queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from evidentia.plans import analysis, assembly, postings, profiles, relational, retrieval, scoring

PARTS = (relational, retrieval, postings, scoring, profiles, analysis, assembly)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
