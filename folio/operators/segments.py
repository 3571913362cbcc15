"""Scans over rows in order, without binding a group, or the whole table, to a task.

Rows are dealt to tasks by ranges of their order, so a group of any size is spread over
as many tasks as it fills. Each task scans its range; what it would have to know from the ranges before it
is one value of each, and is put in afterwards. The sorted rows are stored between the two steps, so a
lost executor costs a re-read and can't move a border.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.sources.shared import kept

#: Bits of `monotonically_increasing_id` that count the rows of a partition.
PLACE_BITS = 33


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows dealt by ranges of `order` and sorted in them, with _at: the task's number above, the place in it below."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Adds the place of each row in the order of all, from `first` on. Nulls come first; rows of equal order are numbered as they come.

    The driver sees the number of rows of each task, and nothing else.
    """
    held = kept(in_ranges(rows, order), "ordered").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [first, *accumulate((n for _, n in counts), initial=first)][1:-1] if counts else []
    starts = rows.sparkSession.createDataFrame(list(zip((p for p, _ in counts), before, strict=True)), "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_at", "_before")


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of a long column over the rows so far, the row itself included, in the order of all. Nulls count as 0."""
    dealt = in_ranges(rows, order)
    schema = T.StructType([*dealt.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            if batch.num_rows:
                sums = so_far + np.cumsum(batch.column(batch.schema.names.index(value)).fill_null(0).to_numpy())
                so_far = int(sums[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*batch.schema.names, name])

    held = kept(dealt.mapInArrow(run, schema), "summed").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    totals = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.sum(F.coalesce(value, F.lit(0))).alias("n")).collect())
    before = list(accumulate((n for _, n in totals), initial=0))[:-1]
    starts = rows.sparkSession.createDataFrame(list(zip((p for p, _ in totals), before, strict=True)), "_part long, _before long")
    return held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col(name)).drop("_part", "_at", "_before")


def last_known(values: pa.Array, codes: np.ndarray) -> np.ndarray:
    """For each row the place of the last value that is not null in its run of equal codes, or -1."""
    n = len(codes)
    at = np.where(np.asarray(values.is_valid()), np.arange(n), -1)
    begins = np.append(True, codes[1:] != codes[:-1])[:n]
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    last = np.maximum.accumulate(at)
    return np.where(last >= start, last, -1)


def filled_forward(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds to each row the last value that is not null of its group so far, itself included, in the given order.

    A backward as-of join of a table with itself. Null groups are a group.
    """
    columns = rows.columns
    marked = in_ranges(rows.withColumn("_value", value), [group, *order])
    held_at = [*columns, "_at"]
    schema = T.StructType([*[marked.schema[c] for c in held_at], T.StructField(name, marked.schema["_value"].dataType), T.StructField("_open", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, begun, first_group = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            groups = batch.column(names.index(group))
            codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
            values = batch.column(names.index("_value"))
            same = codes == codes[0]
            same &= np.logical_and.accumulate(same)
            if begun is not None and groups[0].as_py() != begun[0]:
                carried, first_group = None, False
            elif begun is None:
                carried = None
            at = last_known(values, codes)
            # the run that goes on from the batch before takes what that had
            both = pa.concat_arrays([pa.array([carried], values.type), values])
            take = np.where(at >= 0, at + 1, np.where(same, 0, -1))
            out = both.take(pa.array(take, mask=take < 0))
            open_ = same & first_group & ~np.asarray(out.is_valid())
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in held_at], out, pa.array(open_)], names=[*held_at, name, "_open"])
            begun = (groups[-1].as_py(),)
            carried = out[-1].as_py()
            first_group = first_group and bool(same.all())

    held = kept(marked.mapInArrow(run, schema), "filled").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    # one row a task: the group that its range ends in, and its value there
    tails = held.groupBy("_part").agg(F.max_by(F.struct(F.col(group).alias("g"), F.col(name).alias("v")), "_at").alias("t")).select("_part", "t.*")
    heads = held.where("_open").select("_part", F.col(group).alias("g")).distinct()
    both = tails.withColumn("head", F.lit(False)).unionByName(heads.withColumn("v", F.lit(None).cast(schema[name].dataType)).withColumn("head", F.lit(True)))
    before = Window.partitionBy("g").orderBy("_part", F.desc("head")).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.withColumn("_carried", F.last_value("v", True).over(before)).where("head").select("_part", "_carried", F.lit(True).alias("_open"))
    joined = held.join(carry, ["_part", "_open"], "left")
    return joined.withColumn(name, F.coalesce(name, "_carried")).select(*columns, name)
