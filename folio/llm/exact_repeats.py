"""Exact repeated byte strings: suffix arrays per shard, merged across shards.

Every string of `length` bytes (a window) is dealt by the least hash of its
k-grams, which equal windows share. Consecutive windows of one least hash are a
piece of text. Pieces whose hash occurs once in the corpus (in
their own text, too) hold nothing repeated and go no further. Equal pieces are counted together; pieces that
occur twice are repeated as a whole. Where different pieces share a hash,
their text goes to shards: each builds a suffix array (Larsson-Sadakane) and
common prefixes (Kasai), and places that share `length` bytes are one
class. A hash with more text than a shard holds is cut into several, which
publish their classes as sorted fingerprints that are merged by binary search.
All steps are linear in the text; common hashes are counted before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import fold, only, shuffles_dropped, staged, tidy, unstage
from folio.llm.suffix_array import common_prefixes, suffix_array, words

#: Bytes of a k-gram, at most a quarter of a window.
GRAM = 24
#: Bytes of text that a shard is meant to hold, and those after which it is cut.
SHARD, CUT = 512 << 10, 2 << 20
#: Bytes of text whose windows are merged together.
MERGE = 200_000

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_hashes(data: bytes, size: int, scope: int) -> np.ndarray:
    """A hash of the `size` bytes (a multiple of eight) at each position."""
    w = words(data, "<")
    n = len(data) - size + 1
    h = np.full(n, np.uint64(scope & (2**64 - 1)))
    for k in range(0, size, 8):
        h = (h ^ w[k : k + n]) * A
        h ^= h >> np.uint64(29)
    h = (h ^ h >> np.uint64(30)) * B
    h = (h ^ h >> np.uint64(27)) * C
    return h ^ h >> np.uint64(31)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    n = len(h) - width + 1
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[width - size : width - size + n])


def pieces_of(data: bytes, length: int, scope: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window and number of windows of each piece, and whether its hash occurs more than once in the data."""
    size = max(8, min(GRAM, length // 4) // 8 * 8)
    h = gram_hashes(data, size, scope)
    m = least_of(h, length - size + 1)
    first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    key = m[first]
    low = np.uint64(0xFFFF)
    taken = np.zeros(1 << 16, bool)
    taken[key & low] = True
    like = np.sort(h[taken[h & low]])
    twice = np.searchsorted(like, key, "right") - np.searchsorted(like, key) > 1
    return key, first, np.diff(np.append(first, len(m))), twice


PIECE = "key long, fp long, d1 long, d2 int, start int, windows int, twice boolean"


def all_pieces(rows: DataFrame, length: int) -> DataFrame:
    """The pieces of all rows (d1, d2, scope, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, scope, body = (batch.column(k).to_pylist() for k in range(4))
            out: list[tuple] = []
            for i, data in enumerate(body):
                if data is None or len(data) < length:
                    continue
                key, start, n, twice = pieces_of(data, length, scope[i])
                fp = [xxhash.xxh64_intdigest(data[s : s + m + length - 1], 7) for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                out.append((key.view(np.int64), np.array(fp, np.uint64).view(np.int64), np.full(len(key), d1[i], np.int64), np.full(len(key), d2[i], np.int32), start.astype(np.int32), n.astype(np.int32), twice))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["key", "fp", "d1", "d2", "start", "windows", "twice"])

    return rows.mapInArrow(tidy(run), PIECE)


def piece_texts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The text of pieces: `wanted` has key, fp, d1, d2, start, windows and what else is to be kept."""
    rest = [c for c in wanted.columns if c not in ("d1", "d2", "start", "windows")]
    lists = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "windows", *rest)).alias("wanted"))
    both = rows.select("d1", "d2", "body").join(lists.hint("shuffle_hash"), ["d1", "d2"])
    cut = both.select("d1", "d2", F.explode(F.transform("wanted", lambda x: F.struct(x.alias("w"), F.substring(F.col("body"), x["start"] + 1, x["windows"] + F.lit(length - 1)).alias("text")))).alias("e"))
    return cut.select("d1", "d2", "e.w.*", "e.text").dropDuplicates(["key", "fp"])


def classes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all texts: which text, where in it, and the number of its class of equal windows."""
    data = b"".join(texts)
    sa, _ = suffix_array(data)
    number = np.cumsum(common_prefixes(data, sa, length) < length)
    of = np.empty(len(data), np.int64)
    of[sa] = number
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(data))
    whole = place + length <= ends[owner]
    return owner[whole], (place - (ends - sizes)[owner])[whole], of[whole]


FOUND = "d1 long, d2 int, first long, last long, slice int, list binary"
#: An entry of a published list: the window's fingerprint, where it is if one document alone has it here, and what the shard counted.
ENTRY = np.dtype([("print", "<u8"), ("rest", "<u8"), ("d1", "<i8"), ("d2", "<i4"), ("lone", "?"), ("at", "<i8"), ("weight", "<i8")])


def joined_runs(d1: np.ndarray, d2: np.ndarray, at: np.ndarray, length: int) -> pa.Table:
    """Windows as maximal runs of bytes of their documents."""
    order = np.lexsort((at, d2, d1))
    d1, d2, at = d1[order], d2[order], at[order]
    new = np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (at[1:] > at[:-1] + length))[: len(at)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return pa.table({"d1": pa.array(d1[first], pa.int64()), "d2": pa.array(d2[first], pa.int32()), "first": pa.array(at[first], pa.int64()), "last": pa.array(at[last] + length, pa.int64())})


def search_shards(texts: DataFrame, length: int) -> DataFrame:
    """Runs (d1, d2, first, last) of repeated windows in pieces that occur once.

    texts: key, fp, d1, d2, start, windows, copies, text.
    """
    size = F.octet_length("text")
    total = texts.agg(F.sum(size)).first()[0] or 0
    dealt = texts.withColumn("bucket", fold(F.col("key"), max(1, -(-total // SHARD))))
    held = staged(dealt.groupBy("bucket").agg(F.sum(size).alias("held")).withColumn("parts", F.ceil(F.col("held") / F.lit(CUT)).cast("int")), "shards")
    cut = held.where("parts > 1").agg(F.sum("held")).first()[0] or 0
    slices = -(-cut // MERGE)
    dealt = dealt.join(held, "bucket").withColumn("part", F.pmod("fp", "parts").cast("int"))

    def search(key, table):
        body = table["text"].to_pylist()
        d1, d2, start, copies = (table[c].to_numpy() for c in ("d1", "d2", "start", "copies"))
        owner, place, number = classes(body, length)
        kinds = int(number.max(initial=0)) + 1
        weight = np.bincount(number, weights=copies[owner], minlength=kinds).astype(np.int64)
        again = weight > 1
        single = copies[owner] == 1
        hit = again[number] & single
        out = joined_runs(d1[owner[hit]], d2[owner[hit]], start[owner[hit]] + place[hit], length)
        out = out.append_column("slice", pa.nulls(len(out), pa.int32())).append_column("list", pa.nulls(len(out), pa.binary()))
        if table["parts"][0].as_py() == 1:
            return out
        # one entry for each class, and one for each further place of a document that has it alone
        first = np.zeros(len(number), bool)
        first[np.unique(number, return_index=True)[1]] = True
        shown = np.flatnonzero(first | (single & ~again[number]))
        entry = np.zeros(len(shown), ENTRY)
        prints = [xxhash.xxh3_128_digest(body[i][p : p + length]) for i, p in zip(owner[shown].tolist(), place[shown].tolist(), strict=True)]
        entry["print"], entry["rest"] = np.frombuffer(b"".join(prints), "<u8").reshape(-1, 2).T
        entry["d1"], entry["d2"], entry["at"] = d1[owner[shown]], d2[owner[shown]], start[owner[shown]] + place[shown]
        entry["lone"] = (single & ~again[number])[shown]
        entry["weight"] = np.where(first[shown], weight[number[shown]], 0)
        entry.sort(order=["print", "rest"])
        ends = np.searchsorted(entry["print"], np.array([((k + 1) << 64) // slices - 1 for k in range(slices)], np.uint64), "right")
        lists = [entry[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        none = {c: pa.nulls(slices, out.schema.field(c).type) for c in ("d1", "d2", "first", "last")}
        return pa.concat_tables([out, pa.table({**none, "slice": pa.array(range(slices), pa.int32()), "list": pa.array(lists, pa.binary())})])

    found = staged(dealt.groupBy("bucket", "part").applyInArrow(search, FOUND), "found")
    inside = found.where("list is null").select("d1", "d2", "first", "last")
    if not slices:
        return inside

    def merge(key, table):
        lists = [np.frombuffer(x, ENTRY) for x in table["list"].to_pylist()]
        every = np.concatenate(lists)
        # the distinct fingerprints in order; each entry finds its own by binary search
        both = np.unique(every[["print", "rest"]])
        weight = np.zeros(len(both), np.int64)
        spots = []
        for x in lists:
            lo, hi = np.searchsorted(both["print"], x["print"]), np.searchsorted(both["print"], x["print"], "right")
            spot = lo.copy()
            for k in np.flatnonzero(hi - lo > 1).tolist():
                spot[k] += np.searchsorted(both["rest"][lo[k] : hi[k]], x["rest"][k])
            np.add.at(weight, spot, x["weight"])
            spots.append(spot)
        again = weight > 1
        hit = every["lone"] & again[np.concatenate(spots)]
        return joined_runs(every["d1"][hit], every["d2"][hit], every["at"][hit], length)

    return inside.union(found.where("list is not null").groupBy("slice").applyInArrow(merge, "d1 long, d2 int, first long, last long"))


def repeated_runs(rows: DataFrame, length: int) -> DataFrame:
    """(d1, d2, runs) of the rows (d1, d2, scope, body) with bytes that a repeated window covers, stored.

    A window counts as repeated if it starts anywhere else within its scope.
    (d1, d2) names a row's content: rows that share it must have equal bodies.
    """
    with shuffles_dropped(rows.sparkSession):
        return runs_of(only(rows, "d1", "d2", "scope", "body"), length)


def runs_of(rows: DataFrame, length: int) -> DataFrame:
    pieces = all_pieces(rows, length)
    often = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("key")
    pieces = staged(pieces.drop("twice").join(often, "key"), "pieces")
    kinds = pieces.groupBy("key", "fp").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("d1", "d2", "start", "windows")).alias("at")
    )
    kinds = staged(kinds.select("key", "fp", "copies", "at.*"), "kinds")
    known = F.col("copies") > 1
    whole = pieces.join(kinds.where(known).select("key", "fp"), ["key", "fp"]).select("d1", "d2", F.col("start").cast("long").alias("first"), (F.col("start") + F.col("windows") + F.lit(length - 1)).cast("long").alias("last"))
    # a piece can also repeat itself within: such are at least two windows of an own
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max((~known).cast("int")).alias("open"), F.max(F.when(~known, F.col("windows"))).alias("w"))
    # stored, so that the join reads both sides by plain exchanges and a key with many pieces can be split
    mixed = staged(several.where("open = 1 and (k > 1 or w > 1)").select("key"), "mixed")
    unclear = kinds.join(mixed, "key").select("key", "fp", "copies", "d1", "d2", "start", "windows")
    texts = staged(piece_texts(rows, unclear, length), "texts")
    inside = search_shards(texts, length)
    unstage(texts)
    runs = whole.union(inside).distinct()
    runs = staged(runs.groupBy("d1", "d2").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    unstage(pieces, kinds, mixed)
    return runs


def covered(runs: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside of the maximal runs."""
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])
