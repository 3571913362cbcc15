"""The queries over the test tables and the SQL with the same rows."""

from __future__ import annotations

from folio.plans import dialogues, indexes, jobs, retrieval, tables, texts

QUERIES = {**retrieval.QUERIES, **texts.QUERIES, **dialogues.QUERIES, **tables.QUERIES, **jobs.QUERIES, **indexes.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **texts.ORACLE_SQL, **dialogues.ORACLE_SQL, **tables.ORACLE_SQL, **jobs.ORACLE_SQL, **indexes.ORACLE_SQL}
