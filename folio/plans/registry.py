"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Documents and chunks of sources.schemas, in SQL.
DOCS = "(select doc_id as document_id, source as source_system, lang as doc_type, source || '-' || doc_id as title, date '2018-01-01' + cast((doc_id * 37) % 2500 as integer) as publication_date, n_chars as content_length, sha256(text) as content_hash, text from documents)"
CHUNKS = f"(select e.vec_id as chunk_id, e.embedding::double[] as embedding, e.label, d.*, case when e.vec_id % 7 = 0 then e.vec_id end as table_id from embeddings e join {DOCS} d on e.vec_id = d.document_id)"
MESSAGES = "(select row_number() over (order by conv_id, turn) - 1 as message_id, conv_id as session_id, turn as created_at, role, text as content from conversations)"
FEEDBACK = "(select doc_id as message_id, case when toxic = 1 then -1 when quality = 1 then 1 else 0 end as score from labels)"
#: The first vector of each label asks for its neighbours.
ASKED = "(select label as query_id, embedding::double[] as query_vector, vec_id from embeddings where label is not null qualify row_number() over (partition by label order by vec_id) = 1)"


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """A table of queries, one of SQL, and the decorator that fills both."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None):
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query
