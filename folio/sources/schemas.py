"""Schemas of the tables, and the stand-ins that the test tables give for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import content_hash
from folio.operators.segments import numbered

STATUSES = ["NEW", "PROCESSING", "TEXT_EXTRACTED", "CHUNKS_BUILT", "EMBEDDED", "FAILED"]

DOCUMENTS = "id string, source_system string, source_url string, s3_key string, doc_type string, title string, publication_date date, content_hash string, content_length int, status string, created_at timestamp, updated_at timestamp"
PAGES = "document_id string, page_number int, raw_text string, clean_text string, created_at timestamp"
TABLES = "id bigint, document_id string, page_number int, headers array<string>, rows array<array<string>>, bbox array<double>, accuracy int, caption string, created_at timestamp"
CHUNKS = "id bigint, document_id string, table_id bigint, page_start int, page_end int, chunk_index int, text string, embedding array<float>, section_hint string, created_at timestamp, updated_at timestamp"
CHAT_SESSIONS = "id string, created_at timestamp, metadata_json string"
CHAT_MESSAGES = "id bigint, session_id string, role string, content string, created_at timestamp, metadata_json string"
FEEDBACK = "id bigint, chat_message_id bigint, score int, comment string, corrected_answer string, tags array<string>, created_at timestamp"
EVAL_EXAMPLES = "id bigint, query string, gold_answer string, expected_keywords array<string>, difficulty string, category string, metadata_json string"
EVAL_RUNS = "id string, created_at timestamp, config string, status string, summary_metrics string"
EVAL_RESULTS = "id bigint, eval_run_id string, eval_example_id bigint, llm_answer string, retrieved_chunks int, latency_ms int, match double, passed int, error string, created_at timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("source_system"),
        F.col("lang").alias("doc_type"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("title"),
        F.expr("date_add(date '2018-01-01', cast((doc_id * 37) % 2500 as int))").alias("publication_date"),
        F.col("n_chars").alias("content_length"),
        content_hash(F.col("text")).alias("content_hash"),
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector; every seventh stands for a table."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    docs = documents(spark, sf_dir).drop("content_hash", "content_length")
    return vectors.join(docs, F.col("chunk_id") == F.col("document_id")).withColumn("table_id", F.when(F.col("chunk_id") % 7 == 0, F.col("chunk_id")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat messages, numbered from 0 in order of conversation and turn."""
    c = table(spark, sf_dir, "conversations")
    said = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))
    return numbered(said, ["session_id", "created_at"], "message_id").select("message_id", "session_id", "created_at", "role", "content")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), score.alias("score"), F.lit(None).cast("string").alias("comment"))
