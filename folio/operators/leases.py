"""Who may work on what: disjoint claims of pending items, and leases that expire, with fencing.

A claim is granted for a time, under a token that grows with each grant of the item. When the time is
over the item can be claimed again. A commit is accepted from the worker that holds the item, in
time; a worker that was lost and comes back late is refused, as the item has had another token since. An item is
done once a commit is accepted, until it is offered anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.segments import filled_forward, numbered, running_sum

OFFER, CLAIM, COMMIT = "offer", "claim", "commit"


class Held(NamedTuple):
    """An item's state: its worker (None: free), the token last granted, when that ends (microseconds), and whether it is done."""

    worker: str | None = None
    token: int = 0
    until: int = 0
    done: bool = False


def decided(held: Held, kind: str, worker: str | None, at: int, lease: int) -> tuple[Held, str]:
    """The state after an event at a moment, and what became of it."""
    busy = held.worker is not None and at < held.until
    if kind == OFFER:
        return (held._replace(worker=None, done=False), "offered") if held.done else (held, "known")
    if kind == CLAIM and not held.done and not busy and worker is not None:
        return Held(worker, held.token + 1, at + lease, False), "granted"
    if kind == COMMIT and not held.done and busy and held.worker == worker:
        return held._replace(worker=None, done=True), "committed"
    return held, "refused"


def replayed(events: DataFrame, lease: int) -> DataFrame:
    """(item, seq, worker, outcome, token) of events (item, seq, at, kind, worker), in order of at and seq; lease in microseconds.

    The events of an item follow each other, so they are one task's, but they pass through it a batch at a time.
    """
    kind = events.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, held = None, Held()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["item"] != item:
                    item, held = row["item"], Held()
                held, outcome = decided(held, row["kind"], row["worker"], row["at"], lease)
                out.append((outcome, held.token))
            columns = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in ("item", "seq", "worker")], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["item", "seq", "worker", "outcome", "token"])

    dealt = events.where("item is not null").select("item", F.col("seq").cast("long"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "kind", F.col("worker").cast("string"))
    return dealt.repartition("item").sortWithinPartitions("item", "at", "seq").mapInArrow(run, f"item {kind}, seq long, worker string, outcome string, token long")


def claimed(pending: DataFrame, requests: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, worker): the pending items in order of key, dealt to requests (seq, worker, n) in order of seq.

    Each takes the next n that nobody before it has taken, so no two ever share an item. Items are numbered and requests
    summed up by segmented scans, and the item's request is the last that begins at or before its number: no join by
    inequality, and no task sees all of either.
    """
    items = numbered(pending.select(key), [key], "place").select("place", F.lit(1).alias("what"), F.col(key).alias("item"), F.lit(None).cast("struct<worker: string, stop: long>").alias("ask"))
    sums = running_sum(requests.where("n > 0").select("seq", F.col("worker").cast("string"), F.col("n").cast("long")), ["seq"], "n", "stop")
    asks = sums.select((F.col("stop") - F.col("n")).alias("place"), F.lit(0).alias("what"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.struct("worker", "stop").alias("ask"))
    both = filled_forward(items.unionByName(asks).withColumn("all", F.lit(0)), "all", ["place", "what"], F.col("ask"), "taker")
    return both.where((F.col("what") == 1) & (F.col("place") < F.col("taker.stop"))).select(F.col("item").alias(key), "taker.worker")
