"""Hybrid retrieval for many questions at once: vectors and terms, fused, diversified or re-scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import context, fusion, lexical, mmr, vectors
from folio.providers import Scorer


@dataclass(frozen=True)
class Retrieval:
    """What a retrieval does; each search fetches a multiple of the limit."""

    limit: int = 5
    fetch: int = 2
    rerank_fetch: int = 10
    rrf: bool = False
    mmr: bool = True
    mmr_trade: float = 0.5
    recency: bool = True
    weights: fusion.Weights = fusion.Weights()


def retrieve(queries: DataFrame, chunks: DataFrame, how: Retrieval = Retrieval(), scorer: Scorer | None = None) -> DataFrame:
    """The best chunks of each query (query_id, query_text, query_vector, as_of_year).

    chunks: chunk_id, document_id, text, embedding, publication_date, table_id, title, doc_type, page_start, page_end, section_hint.
    Gives query_id, rank, score and the columns of the chunk; the order is that of selection (score order without MMR).
    A query without a vector is searched by terms alone, a blank one by its vector alone.
    """
    w = how.weights if how.recency else fusion.Weights(**{**how.weights.__dict__, "recency": 0.0, "rrf_recency": 0.0})
    k = how.limit * (how.rerank_fetch if scorer else how.fetch)
    asked = queries.where("query_vector is not null").select("query_id", "query_vector")
    near = vectors.top_k_of_many(chunks, asked, k).withColumn("score", vectors.similarity(F.col("distance")))
    terms = queries.where("trim(query_text) <> ''").select("query_id", lexical.plain_terms(F.col("query_text")).alias("terms"))
    hits = fusion.with_maxima(fusion.merged_hits(near, lexical.matched_terms(chunks, terms, k)))
    known = hits.join(chunks.select("chunk_id", "publication_date", "table_id"), "chunk_id").join(fusion.query_features(queries, w), "query_id")
    if how.recency:
        known = fusion.in_target_years(known, F.col("target_year"), F.col("publication_date"))
    scored = fusion.fused_scores(known, w) if how.rrf else fusion.weighted_scores(known, w)
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).select("query_id", "chunk_id", "score", "rank")
    if scorer:
        with_text = best.join(queries.select("query_id", "query_text"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
        again = context.rescored(with_text, scorer, how.limit)
        best = again.join(best.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.coalesce("rescore", "score").alias("score"), F.col("position").alias("rank"))
    elif how.mmr:
        # queries with no more hits than asked for keep their order
        counted = best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        few = counted.where(F.col("n") <= how.limit).select("query_id", "chunk_id", "score", "rank")
        many = counted.where(F.col("n") > how.limit).join(chunks.select("chunk_id", "embedding"), "chunk_id").join(asked, "query_id")
        spread = mmr.diversify(many, how.limit, how.mmr_trade).select("query_id", "chunk_id", "score", F.col("position").alias("rank"))
        unasked = counted.where(F.col("n") > how.limit).join(asked.select("query_id"), "query_id", "left_anti").where(F.col("rank") <= how.limit).select("query_id", "chunk_id", "score", "rank")
        best = few.unionByName(spread).unionByName(unasked)
    best = best.where(F.col("rank") <= how.limit)
    return best.join(chunks.drop("embedding"), "chunk_id")
