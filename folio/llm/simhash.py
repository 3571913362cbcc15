"""SimHash near-duplicates found through pivot distance tables.

Fingerprints are collapsed to distinct values first, so a group of copies is
one row. Reference fingerprints (pivots) are drawn from them; the table holds
the Hamming distances of every fingerprint to all pivots. A fingerprint lives in
the cell of its nearest pivot, and by the triangle inequality one that links to
it has a distance to that pivot of at most its own least distance + 2 * reach:
it is a guest there, in one of the two cells that a pair could meet in. Within
a cell, pairs whose distances to some pivot differ by more than reach are
discarded by their table rows; the survivors are verified bit by bit. The
search is exact for any choice of pivots.

Null or empty texts have fingerprint zero. A null doc_id gets its component
like any other. Repeated rows and extra columns do not matter; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import only, raw_bytes, staged, tidy
from folio.llm.components import components, forest

SEED = 42
#: Differing bits at which fingerprints still link.
REACH = 2
#: Pivots: about this many times the root of the number of distinct fingerprints, within the bounds.
PIVOT_FACTOR, LEAST_PIVOTS, MOST_PIVOTS = 2, 16, 8_192
#: Members of a block of a cell.
BLOCK = 4_096
#: Coordinates of the table that are compared before bits are.
COORDINATES = 4
#: Fingerprints whose distances to all pivots a task holds at once.
ROWS = 512
#: Shingles whose bits are counted together.
RUN = 100_000


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """The space-joined runs of `width` words, or the one run of all words if there are fewer."""
    words = (text or b"").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    if width == 3:
        return [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), RUN):
        ones += np.unpackbits(h[lo : lo + RUN].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(texts: list[bytes | None], width: int) -> np.ndarray:
    """The fingerprint of each text: a bit is set if over half of the shingles' hashes have it."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        parts = shingles(text, width)
        if parts:
            out[i] = majority(np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts)))
    return out


def with_fingerprints(docs: DataFrame, width: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the fingerprint, as a signed long."""
    from pyspark.sql import types as T

    wanted = only(docs, *dict.fromkeys([*keep, text]))
    schema = T.StructType([*[wanted.schema[k] for k in keep], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(raw_bytes(batch.column(text)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(fp)], names=[*keep, "fp"])

    return wanted.mapInArrow(tidy(run), schema)


def table_rows(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows of the pivot distance table."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def in_cells(fps: DataFrame, pivots: np.ndarray, reach: int) -> DataFrame:
    """Each fingerprint in its home cell and, as a guest, in the cells of lower number where a partner could live."""
    sent = fps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = sent.value
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(every), ROWS):
                fp = every[lo : lo + ROWS]
                d = table_rows(fp, p)
                home = d.argmin(1)
                near = d <= d.min(1)[:, None] + 2 * reach
                near &= np.arange(len(p))[None, :] < home[:, None]
                row, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((home, cell)).astype(np.int32)), pa.array(np.concatenate((fp, fp[row])).view(np.int64)), pa.array(np.arange(len(home) + len(row)) < len(home))],
                    names=["cell", "fp", "home"],
                )

    return fps.select("fp").mapInArrow(run, "cell int, fp long, home boolean")


def linked(one: np.ndarray, two: np.ndarray, pivots: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in one, in two) of all pairs within reach, by the table and then by bits."""
    rows, columns = [], []
    ta, tb = table_rows(one, pivots).astype(np.int8), table_rows(two, pivots).astype(np.int8)
    order = np.argsort(tb[:, 0], kind="stable")
    two, tb = two[order], tb[order]
    for d in np.unique(ta[:, 0]).tolist():
        mine = np.flatnonzero(ta[:, 0] == d)
        lo, hi = np.searchsorted(tb[:, 0], [d - reach, d + reach + 1])
        step = max(1, 2_000_000 // max(1, hi - lo))
        for s in range(0, len(mine) if hi > lo else 0, step):
            part = mine[s : s + step]
            ok = np.ones((len(part), hi - lo), bool)
            for k in range(1, ta.shape[1]):
                ok &= np.abs(ta[part, k][:, None] - tb[lo:hi, k][None, :]) <= reach
            i, j = np.nonzero(ok)
            true = np.bitwise_count(one[part[i]] ^ two[lo + j]) <= reach
            rows.append(part[i[true]])
            columns.append(order[lo + j[true]])
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(rows), np.concatenate(columns)


def fingerprint_links(fps: DataFrame, reach: int = REACH, block: int = BLOCK, most: int = MOST_PIVOTS, whole: bool = False) -> DataFrame:
    """Links (a, b) between distinct values of fps.fp with the components of all pairs within reach; with `whole`, all those pairs.

    Each pair of blocks of a cell finds all of its links, but gives a forest of them: a large group of near copies has as many rows as members.
    """
    spark = fps.sparkSession
    number = fps.count()
    wanted = int(min(most, max(LEAST_PIVOTS, PIVOT_FACTOR * number**0.5)))
    drawn = [r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()]
    pivots = np.array(drawn or [0], np.int64).view(np.uint64)
    cells = staged(in_cells(fps, pivots, reach), "cells")
    sent = spark.sparkContext.broadcast(pivots)

    def verify(key, table):
        p = sent.value
        cell, a, b, among = (k.as_py() for k in key)
        fp, home, blk = (table[c].to_numpy() for c in ("fp", "home", "block"))
        fp = fp.view(np.uint64)
        # the cell's own pivot first, then others spread over the table
        own = p[[cell, *[(cell + k * max(1, len(p) // COORDINATES)) % len(p) for k in range(1, COORDINATES)]]]
        lives = np.flatnonzero(home & (blk == a)) if among else np.flatnonzero(home)
        out = []
        for others, same in ((np.flatnonzero(home & (blk == b)), False),) if among else ((np.flatnonzero(~home), False), (lives if b == 0 else lives[:0], True)):
            i, j = linked(fp[lives], fp[others], own, reach)
            i, j = lives[i], others[j]
            once = fp[i] < fp[j] if same else np.ones(len(i), bool)
            out.append((fp[i[once]], fp[j[once]]))
        left, right = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        if not whole:
            left, right = forest(left, right)
        return pa.table({"a": left, "b": right})

    return in_units(cells, block).groupBy("cell", "unit_a", "unit_b", "among").applyInArrow(verify, "a long, b long")


def in_units(cells: DataFrame, limit: int) -> DataFrame:
    """Cuts those who live in a cell, and its guests, into blocks of about `limit`, and gives a unit for each two blocks that have to meet.

    Guests meet only those who live there, who are few, so it is these that are copied: to the unit of each block of
    guests. If they fill several blocks, they also meet among themselves, block by block. The unit with the first block
    of guests is where a block that lives there meets itself.
    """
    blocks = [F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("home") == at, True)) / F.lit(limit))).cast("int").alias(name) for at, name in ((True, "homes"), (False, "guests"))]
    cut = cells.join(cells.groupBy("cell").agg(*blocks), "cell")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))

    def unit(a: Column, b: Column, among: bool) -> Column:
        return F.struct(a.alias("unit_a"), b.alias("unit_b"), F.lit(among).alias("among"))

    own = F.col("block")
    every = {name: F.sequence(F.lit(0), F.col(name) - 1) for name in ("homes", "guests")}
    with_guests = F.transform(every["guests"], lambda g: unit(own, g, False))
    with_others = F.transform(F.filter(every["homes"], lambda h: h != own), lambda h: unit(F.least(own, h), F.greatest(own, h), True))
    as_guest = F.transform(every["homes"], lambda h: unit(h, own, False))
    units = F.explode(F.when(F.col("home"), F.concat(with_guests, with_others)).otherwise(as_guest)).alias("unit")
    return cut.select("cell", "fp", "home", "block", units).select("cell", "fp", "home", "block", "unit.*")


def near_duplicates(docs: DataFrame, width: int = 3, reach: int = REACH, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (the least doc_id that links reach) of every document."""
    prints = staged(with_fingerprints(docs, width, text), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = staged(fingerprint_links(distinct, reach), "links")
    roots = components(links)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = staged(member, "members")
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
