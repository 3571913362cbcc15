"""Questions to answers: screening, retrieval, prompt, generation, screening again."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import safety
from folio.hooks import observed
from folio.operators import context, hybrid
from folio.providers import Embedder, Generator, Scorer, TokenCounter, WordCounter, with_retries


def embedded(rows: DataFrame, embedder: Embedder, text: str, vector: str) -> DataFrame:
    """Adds the vector of a text column; batches go to the model in Arrow batches, failing calls are tried again."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = with_retries(lambda pdf=pdf: embedder.embed(pdf[text].fillna("").tolist())) if len(pdf) else []
            yield pdf.assign(**{vector: list(got)})

    return rows.mapInPandas(run, schema)


def answers(questions: DataFrame, chunks: DataFrame, embedder: Embedder, generator: Generator, how: hybrid.Retrieval = hybrid.Retrieval(), scorer: Scorer | None = None, counter: TokenCounter | None = None, budget: int = 6000, screened: bool = True) -> DataFrame:
    """(query_id, answer, blocked, violations, evidence, analysis, error, latency_ms) for questions (query_id, query_text, as_of_year).

    Questions that the rules forbid are answered with a fixed text and retrieve nothing. A generator that fails gives its error; latency is the whole milliseconds that it took.
    When the first action over the answers has ended, their events are sent with what it has counted.
    """
    judged = questions.withColumn("verdict", safety.verdict(F.col("query_text")))
    safe = judged.where("verdict.is_safe").drop("verdict") if screened else questions
    asked = embedded(safe.select("query_id", "query_text", "as_of_year"), embedder, "query_text", "query_vector")
    hits = hybrid.retrieve(asked, chunks, how, scorer).withColumn("excerpt", context.excerpt())
    kept = hits.join(context.within_budget(hits, counter or WordCounter(), budget), ["query_id", "rank"])
    body = context.contexts(kept)
    asked_full = safe.join(body, "query_id", "left").select("query_id", context.prompt(F.col("query_text"), F.coalesce("context", F.lit(""))).alias("prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple[str | None, str | None, int]] = []
            for p in pdf["prompt"]:
                said = error = None
                began = time.perf_counter()
                try:
                    said = generator.complete(context.SYSTEM_PROMPT, p)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                out.append((said, error, int((time.perf_counter() - began) * 1000)))
            yield pd.DataFrame({"query_id": pdf["query_id"], "answer": [a for a, _, _ in out], "error": [e for _, e, _ in out], "latency_ms": [t for _, _, t in out]})

    kind = questions.schema["query_id"].dataType.simpleString()
    said = asked_full.mapInPandas(run, f"query_id {kind}, answer string, error string, latency_ms int")
    verdict = safety.verdict(F.coalesce("answer", F.lit("")), False)
    said = said.withColumn("v", verdict).select(
        "query_id",
        F.when(F.col("v.is_safe") | ~F.lit(screened), F.col("answer")).otherwise(F.lit(safety.BLOCKED_ANSWER)).alias("answer"),
        (~F.col("v.is_safe") & F.lit(screened)).alias("blocked"),
        F.col("v.violations").alias("violations"),
        "error",
        "latency_ms",
    )
    full = said.join(context.evidence(kept), "query_id", "left").join(context.analyses(safe, kept), "query_id", "left")
    if screened:
        full = full.unionByName(refused(judged).select("*", F.array().cast(full.schema["evidence"].dataType).alias("evidence")), allowMissingColumns=True)
    return observed(full, events())


def events() -> dict:
    """What a run of `answers` sends when it has ended, counted from its rows."""
    held = F.size(F.coalesce("evidence", F.array()))
    refusal = F.col("blocked") & F.col("answer").eqNullSafe(safety.BLOCKED_QUERY)
    return {
        "rag:query_started": {"questions": F.count(F.lit(1))},
        "safety:query_blocked": {"questions": F.count_if(refusal)},
        "rag:retrieval_complete": {"chunks": F.coalesce(F.sum(held), F.lit(0)), "without": F.count_if(~refusal & (held == 0))},
        "safety:answer_blocked": {"answers": F.count_if(F.col("blocked") & ~refusal)},
        "rag:answer_failed": {"answers": F.count_if(F.col("error").isNotNull())},
        "rag:answer_completed": {"answers": F.count_if(F.col("answer").isNotNull() & ~F.col("blocked"))},
    }


def refused(judged: DataFrame) -> DataFrame:
    """The answers to questions (query_id, verdict) that the rules forbid: a fixed text, without evidence, and why as the analysis."""
    why = F.concat(F.lit("Query blocked: "), F.col("verdict.details"))
    return judged.where("not verdict.is_safe").select("query_id", F.lit(safety.BLOCKED_QUERY).alias("answer"), F.lit(True).alias("blocked"), F.col("verdict.violations").alias("violations"), why.alias("analysis"))
