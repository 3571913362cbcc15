"""What a conversation leaves behind: sessions, messages, evaluation runs, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.segments import numbered


def with_turn(messages: DataFrame, sessions: DataFrame, turn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and sessions after question and answer of `turn` (session_id, query_text, answer, at).

    A session that is not known yet is begun under its own id. An answer that is null (a failed generation) leaves
    the question alone. Ids go on from the greatest.
    """
    new = turn.select("session_id", F.col("at").alias("created_at")).dropDuplicates(["session_id"]).join(sessions.select("session_id"), "session_id", "left_anti")
    said = turn.select("session_id", F.col("at").alias("created_at"), F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("query_text").alias("content"), F.lit(0).alias("n")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("n")))).alias("m")).select("session_id", "created_at", "m.*").where("content is not null")
    last = messages.agg(F.coalesce(F.max("message_id"), F.lit(-1)).alias("last")).first()["last"]
    numbers = numbered(said, ["created_at", "session_id", "n"], "message_id", last + 1)
    columns = ["message_id", "session_id", "role", "content", "created_at"]
    return messages.select(*columns).unionByName(numbers.select(*columns)), sessions.select("session_id", "created_at").unionByName(new)


def finished_run(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Runs (run_id, status, summary_metrics) with the summary of those that finished, as JSON."""
    done = summaries.select("run_id", F.to_json(F.struct([c for c in summaries.columns if c != "run_id"])).alias("metrics"))
    return runs.join(done, "run_id", "left").select("run_id", F.when(F.col("metrics").isNotNull(), "completed").otherwise(F.col("status")).alias("status"), F.coalesce("metrics", "summary_metrics").alias("summary_metrics"))


def event_rows(events: list[tuple[str, dict]], spark) -> DataFrame:
    """Events of the bus as rows (event, payload)."""
    return spark.createDataFrame([(e, {k: str(v) for k, v in p.items()}) for e, p in events], "event string, payload map<string,string>")
