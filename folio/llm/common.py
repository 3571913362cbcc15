"""Pieces shared by the corpus operators: shared storage, Arrow access, block splitting."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What this Python worker has learned for the operator named, for its later tasks.
LEARNED: dict[str, dict] = {}
#: The tables stored inside each `passing` that is open.
PASSING: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session that names none gets a folder of its own, and only if driver and tasks are one process (a local test).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("spark.folio.test.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="folio_")
        spark.conf.set("spark.folio.test.dir", own)
    return own


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage where later steps read a result more than once: a lost
    executor costs a re-read, not a re-computation of everything before.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.staged_at = path
    for tables in PASSING:
        tables.append(stored)
    return stored


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of what is run inside, as soon as that has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def put_by(df: DataFrame, tag: str) -> DataFrame:
    """`df`, staged, without the shuffle files that it took."""
    with shuffles_dropped(df.sparkSession):
        return staged(df, tag)


@contextmanager
def passing(keep: list[DataFrame]) -> Iterator[None]:
    """Deletes the tables of `staged` that are stored inside, but for those that are in `keep` at the end."""
    PASSING.append([])
    try:
        yield
    finally:
        held = {df.staged_at for df in keep}
        unstage(*[df for df in PASSING.pop() if df.staged_at not in held])


def unstage(*tables: DataFrame) -> None:
    """Deletes tables of `staged` of which everything that read them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def learned(name: str) -> dict:
    """What earlier tasks of the operator have left in this worker; what those of other operators have left is dropped."""
    for other in LEARNED.keys() - {name}:
        del LEARNED[other]
    return LEARNED.setdefault(name, {})


def give_back() -> None:
    """Returns memory that is free in this worker to the system, which would else stay with it for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[..., Iterator[pa.RecordBatch]], name: str = "") -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that begins without what other operators have left and gives its memory back in the end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that columns of the caller can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fold(key: Column, parts: int) -> Column:
    """`key` dealt to 0..parts-1 by hash."""
    return F.pmod(F.xxhash64(key), F.lit(parts))


def in_block_pairs(df: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Give every group of `keys` blocks of about `limit` members and a unit for each pair of blocks.

    A group of one block has the single unit (0, 0). A larger one is cut by a hash
    of `member`; each row is copied to all units of its block, so every pair of
    members meets in exactly one unit and no unit holds more than two blocks,
    whatever the size of the group. Adds block, unit_a and unit_b.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_members"))
    cut = (
        df.join(counts, keys)
        .withColumn("_blocks", F.ceil(F.col("_members") / F.lit(limit)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(F.col(member)), F.col("_blocks")).cast("int"))
    )
    units = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda c: F.struct(F.least(F.col("block"), c).alias("a"), F.greatest(F.col("block"), c).alias("b")),
    )
    return (
        cut.withColumn("_unit", F.explode(units))
        .withColumn("unit_a", F.col("_unit.a"))
        .withColumn("unit_b", F.col("_unit.b"))
        .drop("_unit", "_members", "_blocks")
    )
