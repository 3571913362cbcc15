"""Evaluation of answers against expected keywords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import keyword_match


def chosen(examples: DataFrame, difficulty: str | None = None, category: str | None = None) -> DataFrame:
    """The examples of a difficulty and a category, where such are asked for."""
    for name, wanted in (("difficulty", difficulty), ("category", category)):
        if wanted is not None:
            examples = examples.where(F.col(name) == wanted)
    return examples


def keywords_of(listed: Column) -> Column:
    """The keywords of a JSON list; null for what is none."""
    return F.from_json(listed, "array<string>")


def run_evaluation(examples: DataFrame, answer: Callable[[DataFrame], DataFrame], run_id: str, least: float = 0.8, difficulty: str | None = None, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The results and the summary of one run over the chosen examples (example_id, query, expected_keywords).

    answer: gives (query_id, answer, retrieved, latency_ms, error) for questions (query_id, query_text). An example that it leaves out failed.
    """
    asked = chosen(examples, difficulty, category)
    said = answer(asked.select(F.col("example_id").alias("query_id"), F.col("query").alias("query_text"))).withColumnRenamed("query_id", "example_id")
    rows = asked.select("example_id", "expected_keywords").join(said, "example_id", "left").withColumn("run_id", F.lit(run_id))
    rows = rows.withColumn("error", F.when(F.col("answer").isNull() & F.col("error").isNull(), "no answer").otherwise(F.col("error")))
    results = judged(rows, least).select("run_id", "example_id", "answer", "match", "passed", "latency_ms", "error")
    return results, run_summary(results, least)


def judged(rows: DataFrame, least: float = 0.8, empty_passes: bool = False) -> DataFrame:
    """Adds match and passed to rows (expected_keywords, answer, retrieved, error).

    Without keywords the match is 0 unless `empty_passes`; an error never passes.
    """
    known = F.coalesce(F.size("expected_keywords"), F.lit(0)) > 0
    match = F.when(known | F.lit(empty_passes), keyword_match(F.col("expected_keywords"), F.col("answer"))).otherwise(0.0)
    good = (match >= least) & (F.length("answer") > 0) & (F.col("retrieved") > 0) & F.col("error").isNull()
    return rows.withColumn("match", F.when(F.col("error").isNull(), match).otherwise(0.0)).withColumn("passed", F.coalesce(good, F.lit(False)).cast("int"))


def run_summary(results: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per run: total, passed, failed, pass_rate, avg_latency_ms of error-free rows, threshold."""
    latency = F.avg(F.when(F.col("error").isNull(), F.col("latency_ms")))
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("passed").alias("passed"),
        (F.count(F.lit(1)) - F.sum("passed")).alias("failed"),
        F.round(F.avg("passed"), 4).alias("pass_rate"),
        F.round(F.coalesce(latency, F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.first(F.lit(threshold)).alias("threshold"),
    )


def recommendation(rate: Column, latency: Column) -> Column:
    """Accept a clear gain; reject a clear loss, or the same quality at a second more."""
    return F.when(rate >= 0.05, "Accept").when(rate < -0.05, "Reject").when((F.abs(rate) < 0.01) & (latency > 1000), "Reject").otherwise("Neutral")


def compared(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences of pairs of runs (run_a, run_b) and what they recommend."""
    a = summaries.select(F.col("run_id").alias("run_a"), F.col("pass_rate").alias("_ra"), F.col("avg_latency_ms").alias("_la"))
    b = summaries.select(F.col("run_id").alias("run_b"), F.col("pass_rate").alias("_rb"), F.col("avg_latency_ms").alias("_lb"))
    rate, latency = F.round(F.col("_rb") - F.col("_ra"), 4), F.round(F.col("_lb") - F.col("_la"), 2)
    both = pairs.join(a, "run_a").join(b, "run_b")
    return both.select("run_a", "run_b", rate.alias("pass_rate_delta"), latency.alias("latency_delta"), recommendation(rate, latency).alias("recommendation"))
