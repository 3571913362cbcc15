"""Benchmark decontamination through a distributed positional inverted index.

The index of the training documents is a stored table: one row for each term of a shard (some megabytes
of consecutive documents) with the sorted places of the term in the shard. So a frequent term is split
by shard, and no list is longer than a shard. It is built in one pass that shuffles nothing, answers any
number of test sets, and a test set reads only the lists of its own terms: they are joined by
term before anything leaves the JVM.

Test items are cut into windows. The frequencies of all terms are summed over the whole index, and a
window's rarest term says in which shards it could occur; a window with a term that the index does not know
occurs nowhere. A shard gets the items with such windows and the lists of the test terms that it has: the
places of the rarest term propose starts, and the other lists, shifted by their offset in the window, are
intersected from rare to frequent. With `slack`, a term may lie up to so many places off (proximity).

Null or empty texts have no words. Repeated rows each get their own result. Items without words occur
nowhere; item rows with a null id still mark words, but name no item. Items of one name count once. Extra
columns of either table are ignored; an empty table of documents gives no rows. A text longer than a shard is a
shard of its own, and ties between equally rare terms fall to the lesser term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import raw_bytes, staged, tidy

#: Lower-cases A-Z and turns every byte that is no word byte into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text of a shard.
SHARD_BYTES = 8 << 20
#: Words of test items that a shard is asked for together.
BLOCK_WORDS = 2_000_000
#: Proposed starts that are looked at together.
STARTS = 500_000
#: Bytes of test terms, and spans and names that were found, up to which they are sent to all tasks.
SENT_BYTES, SENT_HITS = 16 << 20, 500_000
#: Bytes of a word beyond which it is hashed by itself.
LONG = 256

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Index(NamedTuple):
    """documents: shard, ord, n_words, kept; postings: term, shard, n, places. The term that is empty holds where documents begin."""

    documents: DataFrame
    postings: DataFrame


def word_hashes(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time; eight bytes follow the last word."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = length.astype(np.uint64) * A
    live = np.flatnonzero(length <= LONG)
    done = 0
    while len(live):
        rest = length[live] - done
        part = eight[start[live] + done]
        short = rest < 8
        part[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        x = (h[live] ^ part) * B
        h[live] = (x ^ x >> np.uint64(29)) * A
        live, done = live[rest > 8], done + 8
    for k in np.flatnonzero(length > LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + length[k]])
    return h ^ h >> np.uint64(32)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the highest bit set where more follow; and how many bytes each value takes."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 6))
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        more = (size[at] > k + 1).astype(np.uint64) << np.uint64(7)
        out[end[at] - size[at] + k] = (v[at] >> np.uint64(7 * k)) & np.uint64(127) | more
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    """The values of `packed`."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    shift = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * shift), first) if len(last) else np.zeros(0, np.int64)


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of binary values that lie one after the other."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(flat, np.uint8).tobytes())])


def lists_of(texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Words of each document of a shard; its terms, how often each occurs, and its places."""
    data = b" ".join([*[(t or b"").translate(FOLD) for t in texts], bytes([32] * 8)])
    word = np.frombuffer(data, np.uint8) != 32
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    start, length = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    upto = np.searchsorted(start, ends)
    counts = np.diff(upto, prepend=0)
    h = word_hashes(data, start, length)
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order[1:]] != h[order[:-1]])[: len(order)]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    step = np.diff(order, prepend=0)
    step[first] = order[first]
    bytes_, sizes = packed(np.concatenate((np.diff(upto - counts, prepend=0), step)))
    places = np.add.reduceat(sizes, np.concatenate(([0], first + len(texts)))) if len(sizes) else sizes
    # the spelling of each term, from its first place
    at, size = start[order[first]], length[order[first]]
    spelled = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    terms = binaries(np.frombuffer(data, np.uint8)[spelled], np.concatenate(([0], size)))
    return counts, terms, np.concatenate(([len(texts)], n)), binaries(bytes_, places)


def shards(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of documents with no more bytes than a shard is meant to have, one document at least."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        if k > lo and held + len(t or b"") > SHARD_BYTES:
            yield lo, k
            lo, held = k, 0
        held += len(t or b"")
    if lo < len(texts):
        yield lo, len(texts)


def build_index(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> Index:
    """The stored index of whole texts, with the columns `keep` of each document."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]).alias("kept"))
    kept = [f for f in rows.schema["kept"].dataType.fields if f.name in keep]
    schema = T.StructType([*T._parse_datatype_string("shard long, ord int, n_words long").fields, T.StructField("kept", T.StructType(kept)), *T._parse_datatype_string("term binary, n int, places binary").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = (task.partitionId() if task else 0) << 32
        for batch in batches:
            whole = batch.column(0)
            body = raw_bytes(whole.field(text))
            every = pa.StructArray.from_arrays([whole.field(f.name) for f in kept], names=[f.name for f in kept])
            for lo, hi in shards(body):
                counts, terms, n, places = lists_of(body[lo:hi])
                size = hi - lo
                mine = every.slice(lo, size)
                none = [pa.nulls(size, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())]
                own = [pa.array(np.full(size, shard)), pa.array(np.arange(size, dtype=np.int32)), pa.array(counts.astype(np.int64)), mine]
                yield pa.RecordBatch.from_arrays([*own, *none], names=names)
                size = len(n)
                own = [pa.array(np.full(size, shard)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, mine.type)]
                yield pa.RecordBatch.from_arrays([*own, terms, pa.array(n.astype(np.int32)), places], names=names)
                shard += 1

    stored = staged(rows.mapInArrow(tidy(run), schema), "index")
    return Index(stored.where("term is null").select("shard", "ord", "n_words", "kept"), stored.where("term is not null").select("term", "shard", "n", "places"))


def grid_of(items: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term numbers of each window, -1 beyond its end; its length; its item) of all windows of which every term is known."""
    rows, owner = [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)]
    for k, ids in enumerate(items):
        if len(ids) >= width:
            mine = np.lib.stride_tricks.sliding_window_view(ids, width)
        else:
            mine = np.full((1, width), -1, np.int64)
            mine[0, : len(ids)] = ids
            mine = mine if (ids >= 0).all() else mine[:0]
        mine = mine[(mine[:, : len(ids)] >= 0).all(1)]
        rows.append(mine)
        owner.append(np.full(len(mine), k))
    grid = np.concatenate(rows)
    return grid, (grid >= 0).sum(1), np.concatenate(owner)


def matches(lists: list[np.ndarray], starts: np.ndarray, total: int, items: list[np.ndarray], width: int, slack: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first place, last place, item) of all places of the items' windows in a shard.

    lists: the places of each term; starts: where each document begins; items: term numbers, -1 where the shard has no such term.
    """
    grid, length, owner = grid_of(items, width)
    df = np.array([len(x) for x in lists], np.int64)
    first = np.cumsum(df) - df
    places = np.concatenate([np.zeros(0, np.int64), *lists])
    keys = np.repeat(np.arange(len(lists)), df) << 40 | places
    frequency = np.where(grid >= 0, df[grid], np.iinfo(np.int64).max) if len(df) else grid
    order = np.argsort(frequency, axis=1, kind="stable")
    rare = grid[np.arange(len(grid)), order[:, 0]] if len(grid) else length
    ends = np.append(starts[1:], total)
    proposed = np.cumsum(df[rare]) if len(rare) else rare
    lo = 0
    while lo < len(grid):
        base = proposed[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(proposed, base + STARTS, "right")))
        n = df[rare[lo:hi]]
        window = np.repeat(np.arange(lo, hi), n)
        anchor = places[first[rare[window]] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc = np.searchsorted(starts, anchor, "right") - 1
        start = anchor - order[window, 0]
        low = high = anchor
        for k in range(1, width):
            more = length[window] > k
            if not more.any():
                break
            offset = order[window, k]
            term = grid[window, offset]
            # no match leaves its document
            least = np.maximum(start + offset - slack, starts[doc])
            most = np.minimum(start + offset + slack, ends[doc] - 1)
            spot = np.minimum(np.searchsorted(keys, np.maximum(term, 0) << 40 | least), len(keys) - 1)
            place = places[spot]
            ok = ~more | ((keys[spot] >> 40 == term) & (place >= least) & (place <= most))
            low = np.where(more, np.minimum(low, place), low)[ok]
            high = np.where(more, np.maximum(high, place), high)[ok]
            window, start, doc = window[ok], start[ok], doc[ok]
        yield doc, low, high, owner[window]
        lo = hi


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of inclusive ranges, as maximal ones."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
HIT = "shard long, ord int, spans array<struct<first:long,last:long>>, items array<string>"


def spans_array(lists: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in x] for x in lists], SPAN)


def answer(lists: pa.Table, asked: pa.Table, width: int, slack: int) -> pa.Table:
    """What a shard, by its lists (term, n, places), has of the items (item, terms) it is asked for, as rows of HIT."""
    shard = lists["shard"][0].as_py() if lists.num_rows else 0
    n = lists["n"].to_numpy()
    step = unpacked(b"".join(lists["places"].to_pylist()))
    ends = np.cumsum(n)
    place = np.cumsum(step)
    place -= np.repeat(np.concatenate(([0], place[ends[:-1] - 1])) if len(n) else n, n)
    every = dict(zip(lists["term"].to_pylist(), np.split(place, ends[:-1]), strict=True))
    starts = every.pop(b"", np.zeros(0, np.int64))
    number = {t: k for k, t in enumerate(every)}
    # of items with one text and name one is enough
    names, terms = asked["item"].to_pylist(), asked["terms"].to_pylist()
    items = [np.array([number.get(t, -1) for t in words], np.int64) for words in terms]
    total = int(max((x[-1] + 1 for x in every.values()), default=0))
    spans: dict[int, set[tuple[int, int]]] = {}
    found: dict[int, set[str]] = {}
    for doc, low, high, owner in matches(list(every.values()), starts, total, items, width, slack):
        begin = starts[doc]
        rows = np.unique(np.stack((doc, low - begin, high - begin, owner), 1), axis=0) if len(doc) else np.zeros((0, 4), np.int64)
        for d, a, b, k in rows.tolist():
            spans.setdefault(d, set()).add((a, b))
            if names[k] is not None:
                found.setdefault(d, set()).add(names[k])
    docs = sorted(spans)
    return pa.table(
        {
            "shard": pa.array([shard] * len(docs), pa.int64()),
            "ord": pa.array(docs, pa.int32()),
            "spans": spans_array([joined(spans[d]) for d in docs]),
            "items": pa.array([sorted(found.get(d, ())) for d in docs], pa.list_(pa.string())),
        }
    )


def items_of(bench: DataFrame, text: str, item_id: str) -> DataFrame:
    """item, number and terms of the rows of a test set that have words."""
    rows = bench.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for batch in batches:
            words = [(t or b"").translate(FOLD).split() for t in raw_bytes(batch.column(1))]
            full = [k for k, w in enumerate(words) if w]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full, pa.int64())), pa.array(range(number, number + len(full)), pa.int64()), pa.array([words[k] for k in full], pa.list_(pa.binary()))], names=["item", "number", "terms"])
            number += len(full)

    return rows.mapInArrow(run, "item string, number long, terms array<binary>")


def search(index: Index, bench: DataFrame, width: int = 10, slack: int = 0, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """shard, ord, spans (ranges of hit words) and items (sorted names) of the documents in which windows occur."""
    items = staged(items_of(bench, text, item_id), "items")
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    if not total:
        return bench.sparkSession.createDataFrame([], HIT)
    blocks = -(-total // BLOCK_WORDS)
    items = items.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    terms = items.select("block", F.explode("terms").alias("term")).distinct()
    begins = items.select("block", F.lit(b"").alias("term")).distinct()
    terms = staged(terms.union(begins), "terms")
    size = terms.agg(F.sum(F.octet_length("term") + F.lit(32))).first()[0]
    used = staged(index.postings.join(F.broadcast(terms) if size <= SENT_BYTES else terms, "term"), "lists")
    # the rarest term of each window, over the whole index
    often = used.groupBy("block", "term").agg(F.sum("n").alias("often"))
    place = items.select("block", "number", F.posexplode("terms").alias("at", "term")).join(often, ["block", "term"], "left")
    said = place.groupBy("block", "number").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("often", F.lit(0)).alias("often"), "term"))).alias("words"))
    windows = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width - 1), F.lit(1)))
    rarest = F.transform(windows, lambda i: F.array_min(F.transform(F.slice("words", i, F.lit(width)), lambda w: F.struct(w["often"].alias("often"), w["term"].alias("term")))))
    anchors = said.select("block", "number", F.explode(F.array_distinct(rarest)).alias("a")).where("a.often > 0").select("block", "number", "a.term")
    asked = anchors.join(used.select("block", "term", "shard"), ["block", "term"]).select("block", "shard", "number").distinct()
    asked = asked.join(items, ["block", "number"]).select("block", "shard", "item", "terms")

    def intersect(lists: pa.Table, asked: pa.Table) -> pa.Table:
        return answer(lists, asked, width, slack)

    lists = used.select("block", "shard", "term", "n", "places")
    hits = lists.groupBy("block", "shard").cogroup(asked.groupBy("block", "shard")).applyInArrow(intersect, HIT)
    if blocks == 1:
        return staged(hits, "hits")

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [joined([(x["first"], x["last"]) for x in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans_array(spans), batch.column(3)], names=["shard", "ord", "spans", "items"])

    both = hits.groupBy("shard", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return staged(both.mapInArrow(united, HIT), "hits")


def with_hits(index: Index, hits: DataFrame) -> DataFrame:
    """kept, n_words, spans and items of every document of the index."""
    size = hits.agg(F.sum(F.size("spans") + F.size("items"))).first()[0] or 0
    found = index.documents.join(F.broadcast(hits) if size <= SENT_HITS else hits, ["shard", "ord"], "left")
    none = F.array().cast("array<struct<first:long,last:long>>"), F.array().cast("array<string>")
    return found.select("kept", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def find_occurrences(docs: DataFrame, bench: DataFrame, width: int = 10, slack: int = 0, text: str = "text", item_id: str = "item_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A struct `kept` of the columns `keep` of every document, its number of words, the hit word ranges and the items that occur.

    slack = 0 finds exact phrases; a larger one also finds windows whose words lie up to so many places off.
    """
    index = build_index(docs, text, keep)
    return with_hits(index, search(index, bench, width, slack, text, item_id))


def contamination(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_occurrences(docs, bench, width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return found.select(
        "kept.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def contaminated_brute(texts: list[str | None], items: list[tuple[str, str | None]], width: int = 10) -> list[tuple[int, int, int, str]]:
    """The same by plain search, for tests."""
    out = []
    windows = []
    for name, body in items:
        w = (body or "").encode().translate(FOLD).split()
        windows += [(name, w[i : i + width]) for i in range(max(1, len(w) - width + 1) if w else 0)]
    for t in texts:
        w = (t or "").encode().translate(FOLD).split()
        hit, names = set(), set()
        for name, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    names.add(name)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out
