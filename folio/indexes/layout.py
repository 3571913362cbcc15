"""How tables lie in storage, so that the usual questions read little and move nothing.

Tables that are joined by a key are bucketed by it, in as many buckets each, and joined without an exchange;
one whose rows have a state is partitioned by it, so a scan for a state reads that folder alone.
A table whose rows are replaced by key is cut by a hash of the key into parts; replacing rewrites the
parts concerned and puts them in place when the job commits. A job that fails before leaves the old rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.shared import kept, removed

#: The column of the folder that a row's key hashes to.
PART = "key_part"


def bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int, state: str | None = None) -> DataFrame:
    """Stores rows as the table `name` at `path`, in sorted buckets of the key, and below folders of the state if there is one.

    Rows are dealt by the key first, so that a bucket is one file (of each state) and not one of every task.
    """
    writer = rows.repartition(buckets, key).write.format("parquet").option("path", path).mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(state) if state else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def stored_by_key(rows: DataFrame, path: str, key: str, parts: int) -> None:
    """Stores rows at `path` in `parts` folders by a hash of the key."""
    rows.withColumn(PART, part_of(key, parts)).repartition(PART).write.partitionBy(PART).parquet(path)


def replace_keys(spark: SparkSession, path: str, rows: DataFrame, key: str, parts: int, gone: DataFrame | None = None) -> None:
    """Puts `rows` in the place of what the table has of their keys, and takes out the keys in `gone`.

    Reads and rewrites the folders of those keys, no others. rows: the columns of the table.
    """
    new = rows.withColumn(PART, part_of(key, parts))
    keys = new.select(key, PART)
    if gone is not None:
        keys = keys.unionByName(gone.select(key).withColumn(PART, part_of(key, parts)))
    keys = kept(keys.distinct(), "keys")
    touched = [r[PART] for r in keys.select(PART).distinct().collect()]  # at most `parts`
    table = spark.read.parquet(path)
    left = table.where(F.col(PART).isin(touched)).join(keys.select(key), key, "left_anti")
    both = left.unionByName(new.select(*table.columns))
    # an overwrite does not see a folder that is left without rows
    empty = set(touched) - {r[PART] for r in both.select(PART).distinct().collect()} if gone is not None else set()
    both.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    for part in empty:
        removed(spark, f"{path}/{PART}={part}")


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)
