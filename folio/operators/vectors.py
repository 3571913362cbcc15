"""Exact vector search: cosine distance and top-k for one or many queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that are sent to the executors at once.
QUERY_BLOCK = 4_096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def similarity(distance: Column) -> Column:
    """max(0, 1 - distance); 0 where nothing was found."""
    return F.greatest(F.lit(0.0), F.coalesce(1 - distance, F.lit(0.0)))


def wrong_dimension(rows: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not of the dimension that the index declares, with their size; null vectors wait to be embedded."""
    return rows.withColumn("dimension", F.size(vector)).where(F.col(vector).isNotNull() & (F.col("dimension") != dimension))


def top_k_of_one(rows: DataFrame, query: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", places: int = 6) -> DataFrame:
    """The k rows nearest to the one vector in `query` (column query_vector), with their distance.

    Distances are rounded before they are ordered, so that ties fall to the lesser key on any engine.
    """
    measured = rows.crossJoin(F.broadcast(query.limit(1))).withColumn("distance", F.round(cosine_distance(F.col(vector), F.col("query_vector")), places) + F.lit(0.0))
    return measured.where("distance is not null").drop("query_vector").orderBy("distance", key).limit(k)


def top_k_of_many(rows: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", places: int = 6) -> DataFrame:
    """(query_id, key, distance, rank) of the k rows nearest to each of `queries` (query_id, query_vector).

    Queries go out in blocks of bounded size; each Arrow batch is one matrix product, and a task
    passes on its own k best rows of a query only. The window then sees at most k rows a query and batch.
    """
    spark = rows.sparkSession
    asked = queries.select("query_id", "query_vector").orderBy("query_id")
    kind, key_kind = asked.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    arrow_kind = to_arrow_type(asked.schema["query_id"].dataType)
    found = None
    block: list = []

    def search(sent):
        def run(batches):
            ids, q = sent.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                ok = np.array(batch.column(1).is_valid()) & (np.asarray(batch.column(1).value_lengths().fill_null(-1)) == q.shape[1])
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                names = batch.column(0).take(pa.array(at))
                v = np.asarray(batch.column(1).take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1)
                norm = np.linalg.norm(v, axis=1)
                d = np.round(1 - (q @ v.T) / np.where(norm > 0, norm, np.nan)[None, :], places) + 0.0
                order = np.array(pa.compute.rank(names, "ascending"))
                for i in range(len(ids)):
                    good = np.flatnonzero(~np.isnan(d[i]))
                    best = good[np.lexsort((order[good], d[i][good]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(best), arrow_kind), names.take(pa.array(best)), pa.array(d[i][best])], names=["query_id", key, "distance"])

        return run

    def flush():
        nonlocal found, block
        sent = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], np.float64)))
        part = rows.select(key, vector).mapInArrow(search(sent), f"query_id {kind}, {key} {key_kind}, distance double")
        found = part if found is None else found.union(part)
        block = []

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
    if block:
        flush()
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, {key} {key_kind}, distance double, rank int")
    nearest = Window.partitionBy("query_id").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
