"""Chat messages and their ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.segments import filled_forward


def with_prompts(messages: DataFrame) -> DataFrame:
    """Adds prompt: the latest user message of the session up to each message, itself included.

    A backward as-of join by a segmented scan: a session of any length is spread over tasks.
    """
    said = F.when(F.col("role") == "user", F.col("content"))
    return filled_forward(messages, "session_id", ["created_at", "message_id"], said, "prompt")


def rated_prompts(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Rated messages with their prompt; those without a prompt, or an empty one, are left out."""
    rated = with_prompts(messages).join(feedback.select("message_id", "score"), "message_id")
    return rated.where(F.coalesce(F.col("prompt"), F.lit("")) != "")


def preference_pairs(messages: DataFrame, feedback: DataFrame, least: int = 1, most: int = 5) -> DataFrame:
    """(prompt, chosen, rejected): each prompt's well rated answers against its badly rated ones, at most so many pairs.

    Answers of a prompt keep the order of session and time. Only the first `most` of either kind can be in
    the first `most` pairs ordered by both places, so no more are paired.
    """
    rated = rated_prompts(messages, feedback)
    kind = F.when(F.col("score") >= least, "good").when(F.col("score") < 0, "bad")
    place = F.row_number().over(Window.partitionBy("prompt", "kind").orderBy("session_id", "created_at", "message_id"))
    placed = rated.withColumn("kind", kind).where("kind is not null").withColumn("place", place).where(F.col("place") <= most)
    # at most `most` answers of either kind are left of a prompt, so its pairs are made in one row
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "content"))))
    both = placed.groupBy("prompt").agg(listed("good").alias("good"), listed("bad").alias("bad"))
    made = F.flatten(F.transform("good", lambda g: F.transform("bad", lambda b: F.struct(g["content"].alias("chosen"), b["content"].alias("rejected")))))
    return both.select("prompt", F.posexplode(F.slice(made, 1, most)).alias("at", "p")).select("prompt", (F.col("at") + 1).alias("pair"), "p.chosen", "p.rejected")


def latest_answers(messages: DataFrame) -> DataFrame:
    """The newest assistant message of each session."""
    return messages.where("role = 'assistant'").groupBy("session_id").agg(F.max_by("message_id", F.struct("created_at", "message_id")).alias("message_id"), F.max("created_at").alias("created_at"))


def upserted(feedback: DataFrame, updates: DataFrame) -> DataFrame:
    """Feedback after updates (message_id, score, comment, seq): the last score counts, an empty comment leaves the old one.

    seq, of any type that has an order, differs among the updates of a message: which of two equal ones counts is open.
    """

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    last = updates.groupBy("message_id").agg(F.max_by("score", "seq").alias("new_score"), F.max_by("comment", F.when(given(F.col("comment")).isNotNull(), F.col("seq"))).alias("new_comment"))
    return feedback.join(last, "message_id", "full").select("message_id", F.coalesce("new_score", "score").alias("score"), F.coalesce(given(F.col("new_comment")), "comment").alias("comment"))
