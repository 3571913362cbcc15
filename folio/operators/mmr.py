"""Diverse selection of hits by maximal marginal relevance (Carbonell and Goldstein, 1998)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select(vectors: np.ndarray, query: np.ndarray, k: int, trade: float) -> list[int]:
    """Places of up to k rows: first the most relevant, then each time the best of relevance less redundancy; ties to the first."""
    unit = lambda m: m / (np.linalg.norm(m, axis=-1, keepdims=True) + np.float32(1e-10))
    v, q = unit(vectors.astype(np.float32)), unit(query.astype(np.float32))
    relevance = v @ q
    taken: list[int] = []
    nearest = np.full(len(v), -np.inf, np.float32)
    free = np.ones(len(v), bool)
    while len(taken) < min(k, len(v)):
        value = relevance if not taken else trade * relevance - (1 - trade) * nearest
        best = int(np.argmax(np.where(free, value, -np.inf)))
        taken.append(best)
        free[best] = False
        nearest = np.maximum(nearest, v @ v[best])
    return taken


def diversify(hits: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """The hits (query_id, query_vector, chunk_id, rank, embedding, score) in the order of their selection.

    A hit without a vector counts as a zero vector. A query's hits are few by the searches' limits.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        query = np.asarray(pdf["query_vector"][0], np.float32)
        rows = [np.zeros_like(query) if e is None else np.asarray(e, np.float32) for e in pdf["embedding"]]
        chosen = select(np.stack(rows), query, k, trade)
        out = pdf.loc[chosen, ["query_id", "chunk_id", "score"]]
        out.insert(1, "position", np.arange(1, len(chosen) + 1, dtype=np.int32))
        return out

    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}
    wanted = hits.select("query_id", "query_vector", "chunk_id", "rank", "embedding", F.col("score").cast("double").alias("score"))
    return wanted.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, position int, chunk_id {kinds['chunk_id']}, score double")
