"""Near copies by the Jaccard similarity of word shingles: SimHash pivots first, prefixes for the rest, whole sets to verify.

A text is its set of hashed shingles. Candidates come from two sides. The SimHash operator's
pivot tables link the fingerprints of the sets, which finds the closest copies but misses most at a similarity of 0.8.
So a prefix filter completes them: all sets are put in one order, least common
shingles first (as far as a sample of texts knows; any order is correct). Two sets
that reach the similarity share a shingle among their first
n - ceil(least * n) + 1, so the texts that share none there are never compared.
Sizes and places bound what a pair can still share, and so do bitmaps that hold for each bit whether an odd
number of shingles falls on it: bits that differ are shingles that differ. What is left is verified by
whole sets. Each shingle's texts are first compared with one of them; then those
that are not yet linked are compared with each other: shingles that have the same texts count as one, the texts of a
rare one are paired, and those of a frequent one meet in blocks, by bitmaps first. Whole sets go only to blocks where
pairs are left, each pair where its least shingle is, and these give a forest of their links. So every link
counts, but groups of copies are not expanded into pairs.

Equal texts are one. Null texts and those without words are one group. A null
doc_id gets its component like any other. Repeated rows and extra columns do
not matter; an empty table gives no rows. A text of any length is one set, in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import simhash
from folio.llm.common import in_block_pairs, only, raw_bytes, shuffles_dropped, staged, tidy, unstage
from folio.llm.components import components, forest

#: Words of a shingle, and the similarity from which texts link.
WIDTH, LEAST = 5, 0.8
#: Differing bits up to which fingerprints propose a pair.
REACH = 3
#: Texts that the order of shingles is learned from, and shingles of which it knows that several of those have them.
SAMPLE, COMMON = 24_000, 2_000_000
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
#: Texts whose sets a task holds at once.
ROWS = 500
#: Texts of pairs to verify whose ids are sent to all tasks.
SENT = 1_000_000
#: Shares of the shingles whose places are exchanged one after the other, so that only one share's lie on disk.
SHARES = 4
#: Texts up to which those of a shingle are paired; members of a block beyond that, and shingles that are counted together there.
FEW, BLOCK, COLUMNS = 32, 1_024, 4_096
#: Pairs of bitmaps that are compared at once.
AT_ONCE = 50_000
#: Room for rounding: it lets candidates through and never holds one back.
EPSILON = 1e-9

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """The hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, width: int, known: WordHashes) -> np.ndarray:
    """The distinct hashes, in order, of the runs of `width` words, or of the one run of all words if there are fewer."""
    words = (text or b"").lower().split()
    if len(known) > REMEMBERED:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    if not size:
        return w
    n = len(w) - size + 1
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = (h ^ w[k : k + n]) * A
        h ^= h >> np.uint64(29)
    h *= B
    return np.unique(h ^ h >> np.uint64(32))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, ROWS at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def common_shingles(docs: DataFrame, width: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several sampled texts have, and how many have each."""
    drawn = only(docs, text).where(F.col(f"`{text}`").isNotNull())
    # row by row, so that many equal texts do not fill the sample
    some = drawn.where(F.rand(7) < min(1.0, SAMPLE / max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in sliced(batches):
            sets = [shingle_set(t, width, known) for t in set(raw_bytes(batch.column(0)))]
            value, count = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int32))], names=["token", "count"])

    often = some.mapInArrow(tidy(run), "token long, count int").groupBy("token").agg(F.sum("count").alias("n")).where("n > 1")
    rows = often.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    value, count = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(value)
    return value[order], count[order].astype(np.int32)


def prefix_of(h: np.ndarray, least: float, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any set that reaches the similarity has one among its own first."""
    n = len(h)
    if not n:
        return h
    heavy = np.zeros(n, np.int32)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        heavy = np.where(common[at] == h, weight[at], 0)
    return h[np.lexsort((h, heavy))[: n - math.ceil(least * n - EPSILON) + 1]]


def bitmap(h: np.ndarray) -> bytes:
    """For each bit whether an odd number of shingles falls on it; as many bits as the next power of two from the number of shingles."""
    bits = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def could_agree(a: bytes, b: bytes, na: int, nb: int, least: float) -> bool:
    """Whether the bitmaps leave room for the similarity: each differing bit is at least one shingle that one text alone has."""
    while len(a) != len(b):
        long, b = (a, b) if len(a) > len(b) else (b, a)
        half = len(long) // 2
        a = (int.from_bytes(long[:half]) ^ int.from_bytes(long[half:])).to_bytes(half)
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return differing <= (na + nb) * (1 - least) / (1 + least) + EPSILON


def with_prefixes(docs: DataFrame, width: int, least: float, text: str) -> DataFrame:
    """doc_id, id (one for equal texts, 0 for those without words), n (shingles), prefix, fp (fingerprint of the set) and bits."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width, text))
    wanted = only(docs, "doc_id", text).withColumn("id", F.xxhash64(F.col(f"`{text}`")))
    schema = T.StructType([wanted.schema["doc_id"], *T._parse_datatype_string("id long, n int, prefix array<long>, fp long, bits binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in sliced(batches):
            sets = [shingle_set(t, width, known) for t in raw_bytes(batch.column(1))]
            n = np.array([len(h) for h in sets], np.int32)
            found = [prefix_of(h, least, *sent.value) for h in sets]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            ids = np.where(n > 0, batch.column(2).to_numpy(), 0)
            fp = np.array([simhash.majority(h) for h in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(ids), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(fp), pa.array(map(bitmap, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return wanted.mapInArrow(tidy(run), schema)


def could_link(a: str, b: str, least: float):
    """Whether sizes, and the places of a shingle that is the first of both, leave room for the similarity."""
    na, nb, pa_, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    fits = F.least(na, nb) >= F.greatest(na, nb) * least - EPSILON
    return fits & (F.least(na - pa_, nb - pb) >= (na + nb) * (least / (1 + least)) - EPSILON)


def proposed(kinds: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints the pivot tables link, each fingerprint standing for one of its texts, and of that with its others."""
    spoken = kinds.where("n > 0")
    prints = staged(spoken.groupBy("fp").agg(F.min("id").alias("lead")), "prints")
    links = staged(simhash.fingerprint_links(prints, reach), "linked")
    one, two = (prints.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_id")) for c in ("a", "b"))
    across = links.join(one, "a").join(two, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    within = spoken.join(prints, "fp").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    return across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verified(pairs: DataFrame, kinds: DataFrame, docs: DataFrame, width: int, least: float, text: str) -> DataFrame:
    """The pairs (a, b) of ids whose texts reach the similarity, stored."""

    def side(c: str) -> DataFrame:
        return kinds.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [could_agree(x, y, m, n, least) for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("bitsa", "bitsb", "na", "nb")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(may), "a long, b long"), "near")
    sets = whole_sets(near.select(F.col("a").alias("id")).union(near.select("b")), docs, width, text)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= (len(x) + len(y) - shared) * least - EPSILON)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = near.join(sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    links = staged(both.mapInArrow(tidy(exact), "a long, b long"), "links")
    unstage(near, sets)
    return links


def whole_sets(ids: DataFrame, docs: DataFrame, width: int, text: str) -> DataFrame:
    """id and h (the set) of the texts of the given ids, stored."""
    wanted = staged(ids.distinct(), "wanted")
    texts = only(docs, text).select(F.xxhash64(F.col(f"`{text}`")).alias("id"), F.col(f"`{text}`").alias("t"))
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "id", "left_semi").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in sliced(batches):
            found = [shingle_set(t, width, known).tobytes() for t in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "h"])

    sets = staged(texts.mapInArrow(tidy(run), "id long, h binary"), "sets")
    unstage(wanted)
    return sets


def similar(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets at x and at y reach the similarity, for all pairs."""
    size = np.array([len(h) for h in sets])
    value, count = np.unique(np.concatenate(sets), return_counts=True)
    value = value[count > 1]
    at = [np.searchsorted(value, h) for h in sets]
    at = [a[(a < len(value)) & (value[np.minimum(a, len(value) - 1)] == h)] if len(value) else a[:0] for a, h in zip(at, sets, strict=True)]
    owner, column = np.repeat(np.arange(len(sets)), [len(a) for a in at]), np.concatenate(at)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(value), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, len(value) - lo)), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        shared += has[x] @ has[y].T
    return shared >= (size[x][:, None] + size[y][None, :] - shared) * least - EPSILON


def folded(bits: bytes, size: int) -> bytes:
    """A bitmap as one of `size` bytes."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half]) ^ int.from_bytes(bits[half:])).to_bytes(half)
    return bits


def could_agree_each(bits: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """`could_agree` of the texts at each i and j."""
    size = np.array([len(b) for b in bits])
    both = np.minimum(size[i], size[j])
    ok = np.zeros(len(i), bool)
    for s in np.unique(both).tolist():
        maps = np.zeros((len(bits), s // 8), np.uint64)
        for k in np.flatnonzero(size >= s).tolist():
            maps[k] = np.frombuffer(folded(bits[k], s), np.uint64)
        at = np.flatnonzero(both == s)
        for lo in range(0, len(at), AT_ONCE):
            part = at[lo : lo + AT_ONCE]
            differing = np.bitwise_count(maps[i[part]] ^ maps[j[part]]).sum(1, dtype=np.int64)
            ok[part] = differing <= (n[i[part]] + n[j[part]]) * (1 - least) / (1 + least) + EPSILON
    return ok


def linked_in_blocks(rest: DataFrame, kinds: DataFrame, docs: DataFrame, width: int, least: float, text: str) -> DataFrame:
    """A forest (a, b) of the links between the texts (token, id, n, root) of each shingle that are not linked yet, stored."""
    unit = ["token", "unit_a", "unit_b"]
    every = rest.groupBy("id").agg(F.collect_list("token").alias("tokens"))
    units = in_block_pairs(rest.select("token", "id", "n", "root").join(every, "id").join(kinds.select("id", "bits"), "id"), ["token"], "id", BLOCK)

    def may(key, table):
        """The texts of pairs that could link and have no lesser shingle in common, where they meet as well."""
        token, a, b = (k.as_py() for k in key)
        ids, n, root, block = (table[c].to_numpy() for c in ("id", "n", "root", "block"))
        x, y = np.flatnonzero(block == a), np.flatnonzero(block == b)
        one, two = ([c[z] for c in (ids, n, root)] for z in (x[:, None], y[None, :]))
        fits = (np.minimum(one[1], two[1]) >= np.maximum(one[1], two[1]) * least - EPSILON) & (one[2] != two[2])
        if a == b:
            fits &= one[0] < two[0]
        i, j = np.nonzero(fits)
        i, j = x[i], y[j]
        ok = could_agree_each(table["bits"].to_pylist(), n, i, j, least)
        i, j = i[ok], j[ok]
        lesser = [np.array([t for t in held if t < token], np.int64) for held in table["tokens"].to_pylist()]
        known = np.unique(np.concatenate(lesser))
        has = np.zeros((len(ids), len(known)), bool)
        for k, held in enumerate(lesser):
            has[k, np.searchsorted(known, held)] = True
        has = np.packbits(has, axis=1)
        wanted = np.zeros(len(ids), bool)
        for lo in range(0, len(i), AT_ONCE):
            p, q = i[lo : lo + AT_ONCE], j[lo : lo + AT_ONCE]
            here = ~(has[p] & has[q]).any(1)
            wanted[p[here]] = wanted[q[here]] = True
        out = ids[wanted]
        return pa.table([*[pa.array(np.full(len(out), v, k)) for v, k in ((token, np.int64), (a, np.int32), (b, np.int32))], pa.array(out)], names=[*unit, "id"])

    members = staged(units.groupBy(*unit).applyInArrow(may, "token long, unit_a int, unit_b int, id long"), "in_blocks")
    sets = whole_sets(members.select("id"), docs, width, text)

    def verify(table):
        ids, every = table["id"].to_numpy(), np.arange(len(table))
        i, j = np.nonzero(np.triu(similar([np.frombuffer(h, np.uint64) for h in table["h"].to_pylist()], every, every, least), 1))
        child, top = forest(ids[i], ids[j])
        return pa.table({"a": child, "b": top})

    links = staged(members.join(sets, "id").select(*unit, "id", "h").groupBy(*unit).applyInArrow(verify, "a long, b long"), "links")
    unstage(members, sets)
    return links


def shared_places(prints: DataFrame) -> list[DataFrame]:
    """token, id, n, pos and lead (a text of the token) of the prefixes' shingles that several texts have, stored by shares of the shingles."""
    places = prints.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shares = []
    for k in range(SHARES):
        mine = places.where(F.pmod("token", F.lit(SHARES)) == k)
        often = mine.groupBy("token").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("token", "lead")
        shares.append(staged(mine.join(often, "token").dropDuplicates(["token", "id"]), "held"))
    return shares


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, reach: int = REACH, text: str = "text") -> DataFrame:
    """doc_id and component_id (the least doc_id that links reach) of every document."""
    with shuffles_dropped(docs.sparkSession):
        owners, member = members_of_groups(docs, width, least, reach, text)
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    return owners.join(named, "id").select("doc_id", "component_id")


def members_of_groups(docs: DataFrame, width: int, least: float, reach: int, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id and id of every document; id, least doc_id that has it, and root of every distinct text; both stored."""
    prints = staged(with_prefixes(docs, width, least, text), "prefixes")
    owners = staged(prints.select("doc_id", "id"), "owners")
    kinds = staged(prints.select("id", "n", "fp", "bits").dropDuplicates(["id"]), "kinds")
    shares = shared_places(prints)
    unstage(prints)
    held = reduce(DataFrame.union, shares)
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    first = held.alias("x").join(held.where("id = lead").alias("y"), "token").where("x.id <> y.id").where(could_link("x", "y", least)).select(*pair)
    first = staged(first.union(proposed(kinds, reach)).distinct(), "first")
    links = verified(first, kinds, docs, width, least, text)
    roots = staged(components(links), "roots")
    # what one comparison for each shingle left apart
    rooted = held.join(roots, held["id"] == roots["node"], "left").select("token", "id", "n", "pos", F.coalesce("root", "id").alias("root"))
    sign = [F.bit_xor(F.xxhash64("id")).alias("sign"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("sign2")]
    apart = rooted.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("texts"), F.sum(F.col("pos").cast("long")).alias("place"), *sign)
    # of shingles that the same texts have, the first in order: its places leave most room
    apart = apart.where("r < s").groupBy("texts", "sign", "sign2").agg(F.min_by("token", F.struct("place", "token")).alias("token"))
    rest = staged(rooted.join(apart.select("token", "texts"), "token"), "rest")
    unstage(*shares)
    few = rest.where(F.col("texts") <= FEW)
    more = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & could_link("x", "y", least))
    more = staged(more.select(*pair).distinct().join(first, ["a", "b"], "left_anti"), "more")
    late = verified(more, kinds, docs, width, least, text).union(linked_in_blocks(rest.where(F.col("texts") > FEW), kinds, docs, width, least, text))
    if not late.isEmpty():
        roots = staged(components(links.union(late)), "roots")
    member = kinds_members(owners, roots)
    unstage(first, rest, more, kinds)
    return owners, member


def kinds_members(owners: DataFrame, roots: DataFrame) -> DataFrame:
    """id, least doc_id that has it, and root of every distinct text, stored."""
    least = owners.groupBy("id").agg(F.min("doc_id").alias("least"))
    return staged(least.join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root")), "members")
