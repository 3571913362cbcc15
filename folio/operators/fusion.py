"""Merging, weighting and rank fusion of the hits of two searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.query import is_data_query, query_class, recency, target_year


@dataclass(frozen=True)
class Weights:
    """How much each signal counts. Weighted scores and rank fusion have boosts of their own."""

    semantic: float = 0.7
    lexical: float = 0.3
    recency: float = 0.25
    table: float = 0.3
    keyword_semantic: float = 0.6
    keyword_lexical: float = 1.4
    rrf_k: int = 60
    rrf_recency: float = 0.25
    rrf_table: float = 0.5


def merged_hits(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """One row for each (query_id, chunk_id) of either search; the missing score is 0.

    Both come as (query_id, chunk_id, score); one union and one aggregation serve as a full outer join.
    """
    both = semantic.select("query_id", "chunk_id", F.col("score").alias("semantic"), F.lit(0.0).alias("lexical")).unionByName(
        lexical.select("query_id", "chunk_id", F.lit(0.0).alias("semantic"), F.col("score").cast("double").alias("lexical"))
    )
    return both.groupBy("query_id", "chunk_id").agg(F.greatest(F.max("semantic"), F.lit(0.0)).alias("semantic"), F.greatest(F.max("lexical"), F.lit(0.0)).alias("lexical"))


def with_maxima(hits: DataFrame) -> DataFrame:
    """The greatest score of either kind among all hits of a query, next to each."""
    every = Window.partitionBy("query_id")
    return hits.withColumn("semantic_max", F.max("semantic").over(every)).withColumn("lexical_max", F.max("lexical").over(every))


def in_target_years(hits: DataFrame, year: Column, published: Column) -> DataFrame:
    """If a query names a year: only what was published in it or the year before, unless that leaves nothing."""
    fits = F.coalesce((F.year(published) == year) | (F.year(published) == year - 1), F.lit(False))
    flagged = hits.withColumn("_fits", fits).withColumn("_some", F.max(fits.cast("int")).over(Window.partitionBy("query_id")))
    return flagged.where(F.col("_fits") | (F.col("_some") == 0)).drop("_fits", "_some")


def query_features(queries: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """The class, year, kind and weights of each query (query_id, query_text, as_of_year)."""
    text = F.col("query_text")
    keyword = query_class(text) == "keyword"
    return queries.select(
        "query_id",
        "query_text",
        query_class(text).alias("query_class"),
        target_year(text).alias("target_year"),
        F.coalesce(target_year(text), F.col("as_of_year")).alias("reference_year"),
        is_data_query(text).alias("data_query"),
        (F.lit(weights.semantic) * F.when(keyword, weights.keyword_semantic).otherwise(1.0)).alias("semantic_weight"),
        (F.lit(weights.lexical) * F.when(keyword, weights.keyword_lexical).otherwise(1.0)).alias("lexical_weight"),
    )


def share(value: Column, most: Column) -> Column:
    return F.when(most > 0, value / most).otherwise(0.0)


def weighted_scores(hits: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Adds score: each signal as a share of its maximum, plus recency and, for data questions, tables.

    hits: query features joined with semantic, lexical, their maxima, publication_date, table_id.
    """
    score = (
        F.col("semantic_weight") * share(F.col("semantic"), F.col("semantic_max"))
        + F.col("lexical_weight") * share(F.col("lexical"), F.col("lexical_max"))
        + F.lit(weights.recency) * recency(F.col("publication_date"), F.col("reference_year"))
        + F.when(F.col("data_query") & F.col("table_id").isNotNull(), F.lit(weights.table)).otherwise(0.0)
    )
    return hits.withColumn("score", score)


def rank_fusion(hits: DataFrame, k: int = 60) -> DataFrame:
    """Adds rrf: the sum over both searches of 1 / (k + rank); all hits have a rank in both, zeros as well."""
    order = lambda c: Window.partitionBy("query_id").orderBy(F.desc(c), "chunk_id")
    ranked = hits.withColumn("semantic_rank", F.row_number().over(order("semantic"))).withColumn("lexical_rank", F.row_number().over(order("lexical")))
    return ranked.withColumn("rrf", 1.0 / (k + F.col("semantic_rank")) + 1.0 / (k + F.col("lexical_rank")))


def fused_scores(hits: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Adds score: rank fusion plus recency and, for data questions, tables."""
    fused = rank_fusion(hits, weights.rrf_k)
    return fused.withColumn(
        "score",
        F.col("rrf") + F.lit(weights.rrf_recency) * recency(F.col("publication_date"), F.col("reference_year")) + F.when(F.col("data_query") & F.col("table_id").isNotNull(), F.lit(weights.rrf_table)).otherwise(0.0),
    )


def fuse_lists(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, id, rrf) over ranked lists (query_id, id, rank): absent from a list adds nothing."""
    every = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        every = every.union(x.select("query_id", "id", "rank"))
    return every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def final_order(hits: DataFrame, limit: int, places: int = 9) -> DataFrame:
    """The best `limit` hits of each query by score, ties by chunk."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", places)), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
