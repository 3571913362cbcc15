"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order of similarity.
Inverted lists hold, for each label and reference point, the vectors that name
it among their first `prefix`. Within a list the shared points of two vectors are counted; those that share at least
`shared` are candidates, in the list of the least point they share, and only these are verified: they link
if their cosine in double precision reaches the threshold.

Equal vectors of a label are one class with a count, so copies are never
expanded into pairs, and neither are near copies: a part of a list gives for each vector the number of its links there,
and a forest of them. Vectors that are null, zero, or hold null or non-finite
components, and those without a label, link with nothing: each is its own
component. Repeated rows are copies of each other. Vectors of another length
than the reference points of their label link by plain comparison among
their own length. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import in_block_pairs, only, staged, tidy
from folio.llm.components import components, forest

THRESHOLD = 0.98
#: Reference points: about this many times the root of the number of classes, within the bounds.
POINT_FACTOR, LEAST_POINTS, MOST_POINTS = 2, 16, 2_048
#: Nearest points that describe a vector, and how many of them candidates share.
PREFIX, SHARED = 8, 2
#: Members of a block of a list, and pairs whose cosines are computed together.
BLOCK, PAIRS = 1_024, 100_000
#: Share of candidates from which whole blocks are multiplied.
DENSE = 0.2


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def cosines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Cosines of all rows of one with all rows of two."""
    return (one @ two.T) / np.sqrt((one * one).sum(1))[:, None] / np.sqrt((two * two).sum(1))[None, :]


def scaled(v: np.ndarray) -> np.ndarray:
    """The same directions with a greatest component of 1, so that no square over- or underflows."""
    return v / np.abs(v).max(1)[:, None]


def in_lists(classes: DataFrame, points: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """(label, point, class_id, copies, vector, first) of each class for every point of its prefix; point -1 where no points of its length exist."""
    sent = classes.sparkSession.sparkContext.broadcast(points)

    def run(batches):
        for batch in batches:
            rows, point, first = [], [], []
            sizes = np.asarray(batch.column("vector").value_lengths())
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                p = sent.value.get(n)
                if p is None:
                    near = np.full((len(at), 1), -1, np.int16)
                else:
                    v = scaled(matrix(batch.column("vector").take(pa.array(at))))
                    near = np.argsort(-cosines(v, p), axis=1, kind="stable")[:, :prefix].astype(np.int16)
                rows.append(np.repeat(at, near.shape[1]))
                point.append(near.ravel())
                first += [x.tobytes() for x in np.repeat(near, near.shape[1], axis=0)]
            take = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
            named = {"label": batch.column("label").take(take), "point": pa.array(np.concatenate([np.zeros(0, np.int16), *point]).astype(np.int32))}
            named |= {c: batch.column(c).take(take) for c in ("class_id", "copies", "vector")}
            yield pa.RecordBatch.from_pydict(named | {"first": pa.array(first, pa.binary())})

    kind, vector = (classes.schema[c].dataType.simpleString() for c in ("label", "vector"))
    return classes.select("label", "class_id", "copies", "vector").mapInArrow(tidy(run), f"label {kind}, point int, class_id long, copies long, vector {vector}, first binary")


def candidates(point: int, first: np.ndarray, x: np.ndarray, y: np.ndarray, shared: int) -> np.ndarray:
    """Which of the members x and y of one inverted list share enough points, and none before the list's own."""
    if point < 0:
        return np.ones((len(x), len(y)), bool)
    has = np.zeros((len(first), int(first.max(initial=0)) + 1), np.float32)
    np.put_along_axis(has, first.astype(np.int64), 1, axis=1)
    enough = has[x] @ has[y].T >= min(shared, first.shape[1])
    return enough & (has[x, :point] @ has[y, :point].T == 0)


def links_of_list(point: int, v: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between the members x and y of one inverted list, each pair once."""
    may = candidates(point, first, x, y, shared)
    if np.array_equal(x, y):
        may = np.triu(may, 1)
    if np.count_nonzero(may) > DENSE * may.size:
        i, j = np.nonzero(may & (cosines(v[x], v[y]) >= threshold))
        return x[i], y[j]
    i, j = np.nonzero(may)
    norm = np.sqrt((v * v).sum(1))
    ok = [np.zeros(0, bool)]
    for lo in range(0, len(i), PAIRS):
        a, b = x[i[lo : lo + PAIRS]], y[j[lo : lo + PAIRS]]
        ok.append(np.einsum("ij,ij->i", v[a], v[b]) / norm[a] / norm[b] >= threshold)
    ok = np.concatenate(ok)
    return x[i[ok]], y[j[ok]]


def class_links(classes: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK, most: int = MOST_POINTS) -> DataFrame:
    """The links between classes (label, class_id, copies, vector) of one label, as far as the index finds them.

    Rows with b are a forest (a, b) of each part of the index, the others the number of vectors that a class links with there.
    """
    number = classes.count()
    wanted = int(min(most, max(LEAST_POINTS, POINT_FACTOR * number**0.5)))
    drawn = classes.orderBy(F.xxhash64("vector"), "class_id").limit(wanted).select("vector").collect()
    points: dict[int, np.ndarray] = {}
    for n in {len(r[0]) for r in drawn}:
        points[n] = scaled(np.array([r[0] for r in drawn if len(r[0]) == n], np.float64))
    lists = staged(in_lists(classes, points, prefix), "lists")

    def verify(key, table):
        _, point, a, b = (k.as_py() for k in key)
        ids, copies, blk = (table[c].to_numpy() for c in ("class_id", "copies", "block"))
        sizes = np.asarray(table["vector"].combine_chunks().value_lengths())
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            mine = table.take(pa.array(at))
            first = np.frombuffer(b"".join(mine["first"].to_pylist()), np.int16).reshape(len(at), -1)
            i, j = links_of_list(point, scaled(matrix(mine["vector"])), first, np.flatnonzero(blk[at] == a), np.flatnonzero(blk[at] == b), threshold, shared)
            left.append(at[i])
            right.append(at[j])
        i, j = np.concatenate(left), np.concatenate(right)
        linked = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
        some = np.flatnonzero(linked)
        child, root = forest(ids[i], ids[j])
        return pa.table(
            {
                "a": np.concatenate((ids[some], child)),
                "b": pa.array([None] * len(some) + root.tolist(), pa.int64()),
                "linked": pa.array(linked[some].astype(np.int64).tolist() + [None] * len(child), pa.int64()),
            }
        )

    units = in_block_pairs(lists, ["label", "point"], "class_id", block)
    return units.groupBy("label", "point", "unit_a", "unit_b").applyInArrow(verify, "a long, b long, linked long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    v = only(rows, "vec_id", "embedding", "label").withColumnRenamed("embedding", "vector")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(whole & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # 128 bits name the vector, so that no exchange is dealt by the vector itself
    v = v.withColumn("usable", usable).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    good = v.where("usable")
    classes = staged(good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "classes")
    found = staged(class_links(classes.select("label", "class_id", "copies", "vector"), threshold, prefix, shared), "links")
    roots = components(found.where("b is not null").select("a", "b"))
    reach = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("linked").alias("linked"))
    known = (
        classes.join(reach, "class_id", "left")
        .join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("label", "h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    )
    known = staged(known, "known")
    linked = good.select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
