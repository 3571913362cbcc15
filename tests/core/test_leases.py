"""Claims and leases: rules, replay against a walk, streams in any order of files."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import leases
from folio.operators.leases import Held, decided
from folio.streaming import keyed

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "item long, seq long, at timestamp, kind string, worker string"


def test_a_late_commit_is_refused():
    held, said = decided(Held(), "claim", "a", 0, 10)
    assert said == "granted" and decided(held, "claim", "b", 9, 10) == (held, "refused")
    second, said = decided(held, "claim", "b", 10, 10)
    assert said == "granted" and second.token == 2
    assert decided(second, "commit", "a", 11, 10) == (second, "refused")
    done, said = decided(second, "commit", "b", 19, 10)
    assert said == "committed" and decided(done, "claim", "a", 99, 10)[1] == "refused"
    again, said = decided(done, "offer", None, 99, 10)
    assert said == "offered" and decided(again, "claim", "a", 99, 10)[0].token == 3


def log(n, items, seed):
    rng = random.Random(seed)
    return [(rng.randrange(items), k, START + datetime.timedelta(minutes=rng.randrange(600)), rng.choice(["claim", "claim", "commit", "offer"]), rng.choice(["a", "b", None])) for k in range(n)]


def walked(rows, lease):
    state, out = {}, set()
    for item, seq, at, kind, worker in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        state[item], said = decided(state.get(item, Held()), kind, worker, int((at - START).total_seconds() * 10**6), lease)
        out.add((item, seq, worker, said, state[item].token))
    return out


@pytest.mark.parametrize("items", [1, 30])
def test_replay(spark, items):
    rows = log(800, items, 4)
    got = leases.replayed(spark.createDataFrame(rows, SCHEMA).repartition(6), 40 * 60 * 10**6)
    assert {tuple(r) for r in got.collect()} == walked(rows, 40 * 60 * 10**6)


def test_claims_never_share_an_item(spark):
    rng = random.Random(2)
    pending = [(k,) for k in rng.sample(range(10_000), 300)]
    asks = [(s, f"w{s}", rng.choice([0, 1, 5, 12])) for s in range(60)]
    got = leases.claimed(spark.createDataFrame(pending, "document_id long").repartition(7), spark.createDataFrame(asks, "seq int, worker string, n int").repartition(3)).collect()
    want = dict(zip(sorted(k for k, in pending), (w for _, w, n in asks for _ in range(n)), strict=False))
    assert {r.document_id: r.worker for r in got} == want and len(got) == len(want)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, keyed.STORE)
    yield
    spark.conf.unset(name)


def run_stream(spark, files, schema, make, mode, folder):
    """What a stream gives that reads the files one by one."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03}")
        # the source takes files in order of their times
    out = []
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*"))
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return out


def test_a_lost_workers_item_comes_back(spark, store, tmp_path):
    at = lambda m: START + datetime.timedelta(minutes=m)
    files = [
        [(1, 0, at(0), "claim", "a"), (1, 1, at(1), "claim", "b"), (2, 2, at(2), "claim", "b")],
        [(2, 3, at(8), "commit", "b"), (3, 4, at(30), "claim", "a")],  # the watermark passes item 1's ten minutes
        [(4, 8, at(31), "claim", "b")],
        [(1, 5, at(31), "claim", "b"), (1, 6, at(32), "commit", "a"), (1, 7, at(33), "commit", "b")],
    ]
    got = run_stream(spark, files, SCHEMA, lambda s: keyed.lease_stream(s, 10 * 60 * 10**6, "1 minute"), "append", tmp_path)
    said = {(i, seq): (w, o, t) for _, i, seq, w, o, t in got}
    assert said[1, 0] == ("a", "granted", 1) and said[1, 1][1] == "refused" and said[2, 3][1] == "committed"
    assert said[1, -1] == ("a", "expired", 1) and said[1, 5] == ("b", "granted", 2)
    assert said[1, 6][1] == "refused" and said[1, 7] == ("b", "committed", 2) and (2, -1) not in said


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_files_equals_the_batch(spark, store, tmp_path, seed):
    rng = random.Random(seed)
    docs = [(k, f"h{rng.randrange(12)}", START + datetime.timedelta(seconds=k)) for k in range(80)]
    rng.shuffle(docs)
    schema = "document_id long, content_hash string, at timestamp"
    got = run_stream(spark, [docs[:30], docs[30:31], docs[31:]], schema, keyed.first_contents, "update", tmp_path / "docs")
    last = {key: rank for _, key, rank in sorted(got)}
    batch = spark.createDataFrame(docs, schema).groupBy("content_hash").agg(F.min("document_id").alias("least")).collect()
    assert last == {r.content_hash: r.least for r in batch}
    ratings = [(rng.randrange(9), rng.choice([-1, 0, 1]), None if k % 3 else f"c{k}", k, START + datetime.timedelta(seconds=k)) for k in range(60)]
    rng.shuffle(ratings)
    schema = "message_id long, score int, comment string, seq long, at timestamp"
    got = run_stream(spark, [ratings[:20], ratings[20:]], schema, keyed.last_ratings, "update", tmp_path / "ratings")
    last = {r[1]: r[2:] for r in sorted(got, key=lambda r: r[0])}
    assert last == {m: max((s, score, c) for i, score, c, s, _ in ratings if i == m) for m in {r[0] for r in ratings}}
