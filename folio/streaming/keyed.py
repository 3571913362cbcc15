"""Streams with a state for each key: leases with timers, the first of equal contents, the last rating.

Each keeps what its rule needs of a key, and forgets it when the watermark has passed the
key's last event by a given time; so state is bounded by the keys of that time. They need the RocksDB state store
(`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folio.operators.leases import Held, decided

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """Grants, refusals and commits of an item; a timer gives back what its worker has kept too long."""

    COLUMNS = ["item", "seq", "worker", "outcome", "token"]

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "worker string, token long, until long, done boolean")

    def held(self) -> Held:
        return Held(*self.state.get()) if self.state.exists() else Held()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.held(), []
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        for seq, at, kind, worker in zip(batch["seq"], batch["at"], batch["kind"], batch["worker"], strict=True):
            at = at.value // 1000
            held, outcome = decided(held, kind, worker, at, self.lease)
            if outcome == "granted":
                self.handle.registerTimer(-(-held.until // 1000))
            out.append((key[0], seq, worker, outcome, held.token))
        self.state.update(tuple(held))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        # a later grant has a later timer
        if held.worker is not None and held.until <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.state.update(tuple(held._replace(worker=None)))
            yield pd.DataFrame([(key[0], -1, held.worker, "expired", held.token)], columns=self.COLUMNS)

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, lease: int, late: str) -> DataFrame:
    """What becomes of a stream of events (item long, seq long, at timestamp, kind, worker), and what expires (seq -1)."""
    named = events.withWatermark("at", late).groupBy("item")
    return named.transformWithStateInPandas(Leases(lease), "item long, seq long, worker string, outcome string, token long", "Append", "EventTime")


class Chosen(StatefulProcessor):
    """The row of a key with the least (or greatest) `rank`; emits it whenever it changes, forgets it in time."""

    def __init__(self, columns: list[str], schema: str, least: bool, keep: int):
        self.columns, self.schema, self.least, self.keep = columns, schema, least, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chosen", self.schema)
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        best = batch.sort_values(["rank", *[c for c in self.columns if c != "rank"]], ascending=self.least, kind="stable").iloc[0]
        best = tuple(None if pd.isna(best[c]) else best[c].item() if hasattr(best[c], "item") else best[c] for c in self.columns)
        end = max(int(batch["at"].max().value // 10**6) + self.keep, self.ends.get()[0] if self.ends.exists() else 0)
        self.ends.update((end,))
        self.handle.registerTimer(end)
        at = self.columns.index("rank")
        old = self.state.get() if self.state.exists() else None
        if old is None or (best[at] < old[at] if self.least else best[at] > old[at]):
            self.state.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["key", *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ends.exists() and self.ends.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


def chosen(rows: DataFrame, key: str, columns: dict[str, str], least: bool, late: str, keep: int) -> DataFrame:
    """(key, rank, columns) whenever the row of a key with the least (greatest) rank changes; rows: a stream with rank, at and the columns."""
    schema = ", ".join(f"{c} {t}" for c, t in {"rank": "long", **columns}.items())
    kind = rows.schema[key].dataType.simpleString()
    named = rows.withColumn("rank", F.col("rank").cast("long")).withWatermark("at", late).withColumnRenamed(key, "key").groupBy("key")
    return named.transformWithStateInPandas(Chosen(["rank", *columns], schema, least, keep), f"key {kind}, {schema}", "Update", "EventTime")


def first_contents(docs: DataFrame, late: str = "1 hour", keep: int = 86_400_000) -> DataFrame:
    """For each content hash the least document that has it, as documents (document_id, content_hash, at) arrive in any order."""
    return chosen(docs.withColumn("rank", F.col("document_id")), "content_hash", {}, True, late, keep)


def last_ratings(ratings: DataFrame, late: str = "1 hour", keep: int = 86_400_000) -> DataFrame:
    """For each message its last rating, as ratings (message_id, score, comment, seq, at) arrive in any order."""
    return chosen(ratings.withColumn("rank", F.col("seq")), "message_id", {"score": "int", "comment": "string"}, False, late, keep)
