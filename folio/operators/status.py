"""The states of documents as functions from snapshot to snapshot, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(docs: DataFrame, before: list[str], after: str) -> DataFrame:
    """Documents with one of some states moved to another."""
    return docs.withColumn("status", F.when(F.col("status").isin(before), F.lit(after)).otherwise(F.col("status")))


def reset(docs: DataFrame, parts: list[DataFrame], before: list[str], after: str = "NEW", key: str = "document_id") -> tuple[DataFrame, list[DataFrame]]:
    """Documents moved back, and their parts (pages, chunks, tables) gone."""
    gone = docs.where(F.col("status").isin(before)).select(key)
    return changed(docs, before, after), [p.join(gone, key, "left_anti") for p in parts]


def pending(docs: DataFrame, limit: int, key: str = "document_id") -> DataFrame:
    """The next documents to work on."""
    return docs.where("status = 'NEW'").orderBy(key).limit(limit)


def embedding_progress(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, those without a vector, and the state that follows."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("remaining"))
    return counts.withColumn("status", F.when(F.col("remaining") == 0, "EMBEDDED").otherwise("CHUNKS_BUILT"))


def without_embeddings(chunks: DataFrame, docs: DataFrame, ids: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors taken away, of all or of some documents, and the states set back.

    Of all: embedded documents go back to CHUNKS_BUILT. Of some: whatever their state.
    """
    chosen = F.lit(True) if ids is None else F.col("document_id").isin(ids)
    back = F.col("status") == "EMBEDDED" if ids is None else chosen
    kind = chunks.schema["embedding"].dataType
    return chunks.withColumn("embedding", F.when(~chosen, F.col("embedding")).cast(kind)), docs.withColumn("status", F.when(back, F.lit("CHUNKS_BUILT")).otherwise(F.col("status")))


def replaced(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows with those of every key of `new` replaced by the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def seeded(rows: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Rows and those seeds whose key is not there yet."""
    return rows.unionByName(seeds.join(rows.select(key), key, "left_anti").select(*rows.columns))


def accuracy_bands(tables: DataFrame, *keys: str) -> DataFrame:
    """Counts of tables by accuracy in one pass, and shares in percent; unknown accuracy is in no band."""
    a = F.col("accuracy")
    n = F.count(F.lit(1))
    bands = {"high": a >= 95, "medium": (a >= 80) & (a < 95), "low": a < 80}
    counts = [F.count_if(c).alias(k) for k, c in bands.items()]
    shares = [F.round(F.coalesce(F.try_divide(F.count_if(c) * 100.0, n), F.lit(0.0)), 4).alias(f"{k}_percent") for k, c in bands.items()]
    captioned = F.count_if(F.coalesce(F.length("caption"), F.lit(0)) > 0).alias("captioned")
    return tables.groupBy(*keys).agg(n.alias("total"), *counts, *shares, captioned)


def table_counts(docs: DataFrame, tables: DataFrame, limit: int | None = None, key: str = "document_id", order: str = "created_at") -> DataFrame:
    """Documents with their number of tables, newest first; those without count 0."""
    counts = docs.join(tables.groupBy(key).agg(F.count(F.lit(1)).alias("tables")), key, "left").withColumn("tables", F.coalesce("tables", F.lit(0)))
    ordered = counts.orderBy(F.desc(order), key)
    return ordered if limit is None else ordered.limit(limit)
