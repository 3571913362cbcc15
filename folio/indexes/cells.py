"""Inverted-file index over vectors: cells of a coarse quantizer, stored apart, of which a search reads a few.

Building: cell centres are learned by spherical k-means on a bounded sample (`SAMPLE` rows; the
draw is by a hash of the key, so it is the same at every run); every vector goes to its nearest centre.
The table is partitioned by cell, and a cell of any size is cut into blocks of about `BLOCK` rows by a
hash of the key, so copies of one vector, however many, are spread over tasks.

Searching: each query is dealt to its `probes` nearest cells, and the scan reads those cells' folders
only. Small cells are put together on shelves of about `BLOCK` rows, so a query goes to a shelf once, with the cells that it asks there.
A block meets the queries of its shelf in groups of at most `ASKED`, cell by cell; the distances are computed from the stored vectors in double
precision, and a task passes on the k best of each query. The exact way goes on
from there: by the triangle inequality for angles no row of a cell is nearer to a query than
angle(query, centre) - radius, so only cells that could still hold one of the k nearest are read in
a second step, which passes on only what is as near as the k-th so far. It gives the rows of a full scan.

Null vectors, those of another size than most of the sample, and those that are zero or not finite are not in the index, as they have no distance. Queries
of that kind find nothing. Ties fall to the lesser key. Keys may repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.sources.shared import kept

#: Rows that centres are learned from, rounds of learning, and cells at most: each is a folder.
SAMPLE, ROUNDS, CELLS = 20_000, 12, 4096
#: Rows of a block, and queries that meet it at once.
BLOCK, ASKED = 20_000, 2_000
#: Distances that a task holds at once; a limit above all distances.
PAIRS, FAR = 2_000_000, 3.0
#: Digits of a distance; what rounding and arithmetic can move.
PLACES, SLACK = 6, 2e-6


@dataclass
class Cells:
    """A stored index: its rows (cell, block, key, vector), and each cell's centre, radius and size."""

    spark: SparkSession
    path: str
    key: str
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    schema: str

    @property
    def shelf(self) -> np.ndarray:
        """The shelf of each cell: cells in a row with at most `BLOCK` rows in all, or a larger one alone."""
        shelf, held, out = 0, 0, []
        for n in self.sizes.tolist():
            if held and held + n > BLOCK:
                shelf, held = shelf + 1, 0
            held += n
            out.append(shelf)
        return np.array(out, np.int64)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def finite(vector: Column, size: int) -> Column:
    """Whether a vector has a distance: the size, no null, nothing infinite, and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == size) & good & F.exists(vector, lambda x: x != 0)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def learned(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of spherical k-means, begun far from each other; a cell that loses all its rows begins anew at the row that fits worst."""
    v = unit(sample)
    pick = [0]
    nearest = v @ v[0]
    rng = np.random.default_rng(7)
    while len(pick) < min(cells, len(v)):  # k-means++
        far = np.maximum(0.0, 1 - nearest)
        if far.sum() <= 1e-9:
            break
        pick.append(int(rng.choice(len(v), p=far / far.sum())))
        nearest = np.maximum(nearest, v @ v[pick[-1]])
    centres = v[pick]
    for _ in range(rounds):
        like = v @ centres.T
        own = like.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-12)
        if len(empty):
            sums[empty] = v[np.argsort(like.max(axis=1), kind="stable")[: len(empty)]]
        centres = unit(sums)
    return centres


def build(rows: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding", cells: int | None = None) -> Cells:
    """Stores an index of the rows at `path` (a folder that driver and executors share)."""
    spark = rows.sparkSession
    known = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    drawn = known.where("vector is not null").withColumn("n", F.size("vector")).orderBy(F.xxhash64("key", "vector")).limit(SAMPLE)
    drawn = drawn.toPandas()
    size = int(drawn["n"].mode().iloc[0]) if len(drawn) else 0
    v = np.array([x for x in drawn["vector"] if len(x) == size], np.float64).reshape(-1, size)
    v = v[np.isfinite(v).all(axis=1) & (np.abs(v).sum(axis=1) > 0)]
    usable = known.where(finite(F.col("vector"), size))
    total = usable.count()
    wanted = cells or max(1, min(CELLS, int(np.sqrt(total))))
    centres = learned(v, wanted) if len(v) else np.zeros((1, max(size, 1)))
    sent = spark.sparkContext.broadcast(centres)
    kind = known.schema["key"].dataType.simpleString()
    of = known.schema["vector"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            like = unit(np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)) @ c.T
            cell = like.argmax(axis=1)
            angle = np.arccos(np.clip(like[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["key", "vector", "cell", "angle"])

    dealt = usable.mapInArrow(assign, f"key {kind}, vector {of}, cell int, angle double")
    dealt = kept(dealt, "assigned")
    facts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    held = {r.cell: (r.n, r.radius) for r in facts.collect()}  # a row a cell
    blocks = F.broadcast(facts.select("cell", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")))
    cut = dealt.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("key", "vector", "angle"), F.col("blocks")).cast("int"))
    cut.select("key", "vector", "cell", "block").repartition("cell", "block").sortWithinPartitions("cell", "block").write.partitionBy("cell").parquet(f"{path}/rows")
    numbers = np.array([held.get(k, (0, 0.0)) for k in range(len(centres))])
    schema = f"key {kind}, vector {of}, block int, cell int"
    index = Cells(spark, path, key, centres, numbers[:, 1], numbers[:, 0].astype(np.int64), schema)
    fields = [(k, c.tolist(), float(r), int(n)) for k, (c, r, n) in enumerate(zip(centres, index.radius, index.sizes, strict=True))]
    spark.createDataFrame(fields, "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(json.dumps({"key": key, "schema": schema}),)], "facts string").coalesce(1).write.text(f"{path}/facts")
    return index


def opened(spark: SparkSession, path: str) -> Cells:
    """The index stored at a path."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    return Cells(spark, path, facts["key"], np.array([c.centre for c in cells]), np.array([c.radius for c in cells]), np.array([c.n for c in cells]), facts["schema"])


def nearest_cells(index: Cells, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, query_vector, cell, step) of the queries: their cells in order of nearness, `probes` of them."""
    sent = index.spark.sparkContext.broadcast((index.centres, index.sizes))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes = sent.value
        full = np.flatnonzero(sizes > 0)
        take = min(probes, len(full))
        for batch in batches:
            n = batch.num_rows
            like = unit(np.asarray(batch.column(1).flatten(), np.float64).reshape(n, -1)) @ centres[full].T
            order = np.argsort(-like, axis=1, kind="stable")[:, :take]
            rows = pa.array(np.repeat(np.arange(n), take))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(full[order.ravel()].astype(np.int32)), pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), n))], names=["query_id", "query_vector", "cell", "step"])

    usable = queries.select("query_id", "query_vector").where(finite(F.col("query_vector"), index.centres.shape[1]))
    return usable.mapInArrow(run, f"query_id {kind}, query_vector {queries.schema['query_vector'].dataType.simpleString()}, cell int, step int")


def on_shelves(index: Cells, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, query_vector, limit, shelf, cells): the cells that each query asks, by shelf.

    Of queries (query_id, query_vector) these are their `probes` nearest. Of those that also have a limit and the cells that they have
    seen (limit, seen), they are all others that can hold a row within the limit.
    """
    sent = index.spark.sparkContext.broadcast((index.centres, index.sizes, index.radius, index.shelf))
    further = "seen" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes, radius, shelf = sent.value
        full = np.flatnonzero(sizes > 0)
        take = min(probes, len(full))
        for batch in batches:
            n = batch.num_rows
            like = unit(np.asarray(batch.column(1).flatten(), np.float64).reshape(n, -1)) @ centres[full].T
            limit = np.asarray(batch.column(2)) if further else np.full(n, FAR)
            asks = np.zeros((n, len(centres)), bool)
            if further:
                # the nearest that a row of the cell can be
                least = 1 - np.cos(np.maximum(0.0, np.arccos(np.clip(like, -1, 1)) - radius[full] - 1e-9))
                asks[:, full] = least <= limit[:, None] + SLACK
                seen = batch.column(3)
                asks[np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(seen))), np.asarray(seen.flatten())] = False
            else:
                np.put_along_axis(asks, full[np.argsort(-like, axis=1, kind="stable")[:, :take]], True, axis=1)
            query, cell = np.nonzero(asks)
            # cells of a shelf are numbered in a row
            begins = np.flatnonzero(np.append(True, (np.diff(query) != 0) | (np.diff(shelf[cell]) != 0))[: len(query)])
            of = pa.array(query[begins])
            cells = pa.ListArray.from_arrays(pa.array(np.append(begins, len(query)).astype(np.int32)), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(limit[query[begins]]), pa.array(shelf[cell[begins]].astype(np.int32)), cells], names=["query_id", "query_vector", "limit", "shelf", "cells"])

    usable = queries.where(finite(F.col("query_vector"), index.centres.shape[1]))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    return usable.mapInArrow(run, f"query_id {kinds['query_id']}, query_vector {kinds['query_vector']}, limit double, shelf int, cells array<int>")


def nearest_rows(query: np.ndarray, row: np.ndarray, distance: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which of these pairs are among the k nearest of their query; of equal ones those whose row is first in order."""
    by = np.lexsort((order[row], distance, query))
    sorted_ = query[by]
    return by[np.arange(len(by)) - np.searchsorted(sorted_, sorted_) < k]


def found_in_cells(index: Cells, dealt: DataFrame, k: int) -> DataFrame:
    """(query_id, key, distance, cell): the k nearest of each query, within its limit, in each block of the cells that it asks (`on_shelves`).

    The cells that are asked are read, no others. A block and a group of queries of its shelf meet in one task; both are bounded.
    """
    cells = [r.cell for r in dealt.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most as many as the index has
    shelf = index.shelf
    counts = dealt.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED)).cast("int").alias("groups"))
    counts = F.broadcast(counts)
    shelves = F.broadcast(index.spark.createDataFrame([(c, int(h)) for c, h in enumerate(shelf)], "cell int, shelf int"))
    blocks = F.broadcast(index.spark.createDataFrame([(int(h), max(1, -(-int(index.sizes[shelf == h].max()) // BLOCK))) for h in np.unique(shelf)], "shelf int, blocks int"))
    asked = dealt.join(counts, "shelf").join(blocks, "shelf")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = index.rows.where(F.col("cell").isin(cells)).join(shelves, "cell").join(counts, "shelf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    kind, key_kind = dealt.schema["query_id"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()

    def meet(held: pa.Table, queries: pa.Table) -> pa.Table:
        held = held.sort_by("cell")
        q, v = (unit(np.asarray(x.combine_chunks().flatten(), np.float64).reshape(len(x), -1)) if len(x) else np.zeros((0, 1)) for x in (queries["query_vector"], held["vector"]))
        order = np.empty(len(v), np.int64)
        order[np.asarray(pa.compute.sort_indices(held["key"]))] = np.arange(len(v))
        limit, cell = queries["limit"].to_numpy(), held["cell"].to_numpy()
        asks = queries["cells"].combine_chunks()
        who, what = np.repeat(np.arange(len(q)), np.asarray(pa.compute.list_value_length(asks))), np.asarray(asks.flatten())
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c in np.intersect1d(cell, what).tolist():
            a, b = np.searchsorted(cell, [c, c + 1]).tolist()
            mine = who[what == c]
            step = max(1, PAIRS // (b - a))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                distance = np.round(1 - q[some] @ v[a:b].T, PLACES) + 0.0
                most = limit[some]
                if b - a > k and (most >= FAR).any():
                    most = np.minimum(most, np.partition(distance, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(distance <= most[:, None])
                pairs = some[i], j + a, distance[i, j]
                best = nearest_rows(*pairs, order, k)
                found.append(tuple(x[best] for x in pairs))
        query, row, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        best = nearest_rows(query, row, distance, order, k)
        query, row = pa.array(query[best]), pa.array(row[best])
        return pa.table({"query_id": queries["query_id"].take(query), "key": held["key"].take(row), "distance": pa.array(distance[best]), "cell": held["cell"].take(row)})

    units = ["shelf", "block", "part"]
    held = rows.select(*units, "cell", "key", "vector").groupBy(*units)
    return held.cogroup(asked.select(*units, "query_id", "query_vector", "limit", "cells").groupBy(*units)).applyInArrow(meet, f"query_id {kind}, key {key_kind}, distance double, cell int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def nearest_of_all(index: Cells, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, key, distance, cell, rank): the k nearest of all rows, begun in each query's `probes` nearest cells."""
    dealt = kept(on_shelves(index, queries.select("query_id", "query_vector"), probes), "probes")
    first = kept(ranked(found_in_cells(index, dealt, k), k), "nearest")
    # with fewer than k rows so far, whatever is left may be among them
    limits = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(FAR)).alias("limit"))
    seen = dealt.groupBy("query_id").agg(F.first("query_vector").alias("query_vector"), F.flatten(F.collect_list("cells")).alias("seen"))
    rest = kept(on_shelves(index, seen.join(limits, "query_id").select("query_id", "query_vector", "limit", "seen"), probes), "probes")
    return ranked(first.drop("rank").union(found_in_cells(index, rest, k)), k)


def search(index: Cells, queries: DataFrame, k: int, probes: int = 4, exact: bool = False) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows of the queries (query_id, query_vector; ids are unique).

    Without `exact`, of the rows in each query's `probes` nearest cells (`probes_for` finds how many it takes). With it, of all rows.
    """
    queries = queries.select("query_id", "query_vector")
    if exact:
        found = nearest_of_all(index, queries, k, probes)
    else:
        found = ranked(found_in_cells(index, kept(on_shelves(index, queries, probes), "probes"), k), k)
    return found.drop("cell").withColumnRenamed("key", index.key)


def probes_for(index: Cells, k: int, recall: float = 0.97, asked: int = 300) -> int:
    """The least number of probes with which `asked` stored vectors, drawn by a hash, find that share of their k nearest.

    What is nearest is found the exact way; how far down a query's cells each of it lies is counted.
    """
    drawn = index.rows.orderBy(F.xxhash64("key", "vector", F.lit(1))).limit(asked)
    queries = kept(drawn.select(F.monotonically_increasing_id().alias("query_id"), F.col("vector").alias("query_vector")), "asked")
    order = nearest_cells(index, queries, len(index.centres))
    nearest = nearest_of_all(index, queries, k, 4)
    steps = sorted((r.step, r["count"]) for r in nearest.join(order, ["query_id", "cell"]).groupBy("step").count().collect())
    wanted, held = recall * sum(n for _, n in steps), 0
    for step, n in steps:
        held += n
        if held >= wanted:
            return step
    return 1
