"""Segmented scans against a walk over all rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import dialogue, segments
from folio.plans.history import with_turn

SCHEMA = "message_id long, session_id long, created_at long, role string, content string"


def walked(rows):
    last, out = {}, {}
    for m, s, t, role, content in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0])):
        if role == "user" and content is not None:
            last[s] = content
        out[m] = last.get(s)
    return out


def sessions(kind, seed):
    rng = random.Random(seed)
    rows = []
    for m in range(900):
        s = {"one": 1, "many": rng.randint(0, 300), "hot": 1 if rng.random() < 0.6 else rng.randint(2, 40), "null": rng.choice([None, None, 3, 4])}[kind]
        role = rng.choice(["user", "assistant", "system"]) if rng.random() < 0.9 else "assistant"
        if kind == "one" and m > 3:
            role = "assistant" if m < 700 else role
        rows.append((m, s, rng.randint(0, 200), role, None if rng.random() < 0.1 else f"t{m}"))
    return rows


@pytest.mark.parametrize("kind", ["one", "many", "hot", "null"])
@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_last_value_of_any_session(spark, kind, parts):
    rows = sessions(kind, 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = dialogue.with_prompts(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.message_id: r.prompt for r in got} == walked(rows) and len(got) == len(rows)


def test_no_task_has_a_whole_session(spark):
    rows = spark.createDataFrame(sessions("one", 5), SCHEMA)
    plan = dialogue.with_prompts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(session_id" not in plan


@pytest.mark.parametrize("parts", [1, 6])
def test_numbers_follow_the_order(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), rng.random()) for _ in range(500)]
    got = segments.numbered(spark.createDataFrame(rows, "a int, b double").repartition(parts), ["a", "b"], "k", 10).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.k)] == want and sorted(r.k for r in got) == list(range(10, 510))
    assert segments.numbered(spark.createDataFrame([], "a int"), ["a"], "k").collect() == []


def test_turns_are_numbered_after_the_last(spark):
    rows = spark.createDataFrame([(k, 1, k, "user", f"t{k}") for k in range(5)], SCHEMA)
    sessions_ = spark.createDataFrame([(1, 0)], "session_id long, created_at long")
    turn = spark.createDataFrame([(1, "q", "a", 9), (2, "new", None, 8)], "session_id long, query_text string, answer string, at long")
    messages, after = with_turn(rows, sessions_, turn)
    assert sorted((r.message_id, r.session_id, r.content) for r in messages.where(F.col("message_id") > 4).collect()) == [(5, 2, "new"), (6, 1, "q"), (7, 1, "a")]
    assert after.count() == 2
