"""Connected components of links between long ids, without gathering them anywhere.

Tasks first shrink their own links to a forest. Then large-star and small-star
steps (Kiveris et al., 2014) alternate until nothing changes: both are an
aggregation and a join by node, and a hub is aggregated before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import staged

#: Links that a task shrinks at once.
RUN = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component with that least node, over the links given."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def shrink(links: DataFrame) -> DataFrame:
    """The links with each task's share replaced by a forest with the same components."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out():
            a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= RUN:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link: root is the least node that it reaches."""
    edges = staged(shrink(links.where("a <> b")), "forest")
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == seen:
            break
        seen = now
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.union(tops.join(roots.select("node"), "node", "left_anti"))
