"""The polling loops of ingestion as streams: each run takes what is new and stops, or goes on with a trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.hooks import observed
from folio.operators.pages import pages_of_lines
from folio.plans.ingest import chunks_of, with_missing_vectors
from folio.providers import Embedder

INPUT = "document_id long, text string"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, lines: int = 40, every: str | None = None) -> StreamingQuery:
    """Cleans and chunks the documents that arrive as Parquet files; each micro-batch is written once, under its number.

    Each batch sends `ingest:chunks_built` once it is written. A batch that is tried again overwrites its own folder. The rows are those of the batch job over the same documents.
    """
    docs = spark.readStream.schema(INPUT).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        made = observed(chunks_of(pages_of_lines(batch, lines)), {"ingest:chunks_built": {"chunks": F.count(F.lit(1)), "characters": F.coalesce(F.sum(F.length("text")), F.lit(0))}})
        made.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def embed(spark: SparkSession, source: str, target: str, checkpoint: str, embedder: Embedder, schema: str, every: str | None = None) -> StreamingQuery:
    """Gives vectors to the chunks that arrive."""
    chunks = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        bare = batch.withColumn("embedding", F.lit(None).cast("array<float>"))
        with_missing_vectors(bare, embedder).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of event time; what comes later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "event_type", "n")
