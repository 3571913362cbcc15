"""A Merkle manifest of a table: one digest for all rows, and for each row a proof that it is among them.

A row is a leaf: the SHA-256 of its fields, each with its length. The leaves of a
group stand in the order of the key; runs of `FAN` neighbours become their digest
until one is left, the group's root; the groups' roots, in the order of the groups,
make the root of the table in the same way.

The work is done in three steps. Executors place the leaves by a range sort (a group
of any size is spread over all tasks) and reduce blocks of FAN ** DEPTH leaves, one
row a block. The digests of blocks are reduced again until at most `TOP` are left: that
is the top tree, which the driver builds. The path from each of its nodes to the root is
broadcast (at most TOP rows), and executors walk back down: they finish the proof of each leaf and fold it
(or what a tampered row would give) with its siblings up to the root.

Rows whose key is null come first. Rows with the same key stand in the order of
their leaves, so equal rows have neighbouring leaves and proofs of their own. A null
group comes before the others, and is told from an empty one. Null fields are written
as `-`. Columns that are no fields are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import only, staged, tidy, unstage

#: Neighbours that become one node, and levels that a block has.
FAN, DEPTH = 8, 3
#: Nodes that the driver makes a tree of; their paths are broadcast.
TOP = 4096
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "path array<struct<left: string, right: string>>"


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of values: each its number of UTF-8 bytes, a colon and itself, or `-` if null."""

    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields.values())), 256)


def digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def upwards(nodes: list[bytes], total: int, depth: int, fan: int = FAN) -> list[list[bytes]]:
    """The levels above `nodes`, at most `depth` of them; `total` nodes of the whole group are on the level of `nodes`."""
    levels = [nodes]
    while total > 1 and len(levels) <= depth:
        below = levels[-1]
        levels.append([digest(below[k : k + fan]) for k in range(0, len(below), fan)])
        total = -(-total // fan)
    return levels


def siblings(levels: list[list[bytes]], at: int, fan: int = FAN) -> list[tuple[bytes, bytes]]:
    """What stands left and right of the node's run on each level, from the node up to the last level but one."""
    out = []
    for level in levels[:-1]:
        low = at // fan * fan
        out.append((b"".join(level[low:at]), b"".join(level[at + 1 : low + fan])))
        at //= fan
    return out


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = digest([left, node, right])
    return node


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds pos, the place of a row among those of its group g, from 0, and total, their number.

    A range sort over all rows, the numbers of rows of each task and group, and their
    running sums give the places; no group is ever in one task.
    """
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    held = staged(salted.repartitionByRange("g", *order, "_salt").sortWithinPartitions("g", *order, "_salt").drop("_salt").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("g")
    counts = counts.select(
        "g", "_part", "_first", F.sum("_n").over(whole).alias("total"),
        (F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    return held.join(counts, ["g", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    """One row for each `size` neighbours of a group: g, block, total and rows, a list of structs in order of pos."""
    rest = [c for c in nodes.columns if c not in ("g", "pos", "total")]
    block = F.floor(F.col("pos") / F.lit(size)).cast("long").alias("block")
    return staged(nodes.groupBy("g", block).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("rows")), "blocks")


def hex_digests(column: pa.Array) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def held_rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.StructArray]]:
    """The blocks of a batch: their other columns, and the structs of their rows."""
    names = [n for n in batch.schema.names if n != "rows"]
    at = batch.schema.get_field_index("rows")
    for k, row in enumerate(batch.select(names).to_pylist()):
        yield row, batch.column(at)[k].values


def reduced(blocks: DataFrame, depth: int) -> DataFrame:
    """The nodes `depth` levels above the rows of blocks: g, pos, total, digest."""
    size = FAN**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, inner in held_rows(batch):
                (node,) = upwards(hex_digests(inner.field("digest")), row["total"], depth)[-1]
                out.append({"g": row["g"], "pos": row["block"], "total": -(-row["total"] // size), "digest": bytes.fromhex(node.decode())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.binary())]))

    return blocks.mapInArrow(tidy(run), "g string, pos long, total long, digest binary")


def paths_below(blocks: DataFrame, depth: int) -> DataFrame:
    """The paths of the rows of blocks, from those of the blocks (g, block, rows, total, path, subroot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string())])
        for batch in batches:
            for row, inner in held_rows(batch):
                levels = upwards(hex_digests(inner.field("digest")), row["total"], depth)
                out = []
                for k, pos in enumerate(inner.field("pos").to_pylist()):
                    own = [{"left": a.decode(), "right": b.decode()} for a, b in siblings(levels, k)]
                    out.append({"g": row["g"], "pos": pos, "path": own + row["path"], "subroot": row["subroot"]})
                yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.mapInArrow(tidy(run), f"g string, pos long, {PATH}, subroot string")


def top_tree(nodes: list[tuple[str, int, int, bytes]]) -> tuple[list[tuple], str]:
    """(g, pos, path, subroot) of at most TOP nodes (g, pos, total, digest), and the root."""
    groups: dict[str, list[bytes]] = {}
    for g, _, _, d in sorted(nodes, key=lambda x: (x[0].encode(), x[1])):
        groups.setdefault(g, []).append(d)
    trees = {g: upwards(x, len(x), len(x)) for g, x in groups.items()}
    roots = upwards([t[-1][0] for t in trees.values()], len(trees), len(trees))
    out = []
    for k, (g, tree) in enumerate(trees.items()):
        for i in range(len(tree[0])):
            path = [(a.decode(), b.decode()) for a, b in siblings(tree, i) + siblings(roots, k)]
            out.append((g, i, path, tree[-1][0].decode()))
    return out, roots[-1][0].decode() if nodes else ""


def paths(nodes: DataFrame, depth: int, top: int) -> tuple[DataFrame, str]:
    """The path of every node (g, pos, total, digest) to the root: g, pos, path, subroot; and the root.

    Nodes are reduced in blocks until at most `top` are left; those go to the driver.
    More groups than that, each of one node, are placed and reduced in their turn.
    """
    spark = nodes.sparkSession
    nodes = staged(nodes, "nodes")
    n, largest = nodes.agg(F.count(F.lit(1)), F.max("total")).first()
    if n <= top:
        rows = [(r.g, r.pos, r.total, r.digest.hex().encode()) for r in nodes.collect()]
        unstage(nodes)
        found, root = top_tree(rows)
        return F.broadcast(spark.createDataFrame(found, f"g string, pos long, {PATH}, subroot string")), root
    if largest > 1:
        blocks = in_blocks(nodes, FAN**depth)
        above, root = paths(reduced(blocks, depth), depth, top)
        return paths_below(blocks.join(above.withColumnRenamed("pos", "block"), ["g", "block"]), depth), root
    roots = placed(nodes.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest"), "key")
    roots = staged(roots, "subroots")
    above, root = paths(roots.select("g", "pos", "total", "digest"), depth, top)
    named = roots.select("g", "pos", "key", "digest").join(above, ["g", "pos"])
    return named.select(F.col("key").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.lower(F.hex("digest")).alias("subroot")), root


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, changes: dict[str, Column] | None = None, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """For each row: its key, leaf, subroot, root, proof_sha256, folded_root and verified.

    tampered: the rows that are folded from the leaf that `changes` (new values of fields) would give
    them; without it every row is folded from its own leaf, and verifies.
    """
    rows = only(docs, *dict.fromkeys([key, group, *fields]))
    own = {f: F.col(f"`{f}`") for f in fields}
    other = F.when(tampered, F.unhex(leaf(own | (changes or {})))) if tampered is not None else F.lit(None).cast("binary")
    # a null group sorts before an empty one
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g")
    # stored, as a range sort reads its input twice
    leaves = staged(rows.select(g, F.col(f"`{key}`").alias("key"), F.unhex(leaf(own)).alias("digest"), other.alias("other")), "leaves")
    blocks = in_blocks(placed(leaves, "key", "digest"), FAN**depth)
    above, root = paths(reduced(blocks, depth), depth, top)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, inner in held_rows(batch):
                suffix = [(p["left"].encode(), p["right"].encode()) for p in row["path"]]
                rest = b"".join(a + b for a, b in suffix)
                own = hex_digests(inner.field("digest"))
                levels = upwards(own, row["total"], depth)
                proofs, roots = [], []
                for k, (d, x) in enumerate(zip(own, inner.field("other").to_pylist(), strict=True)):
                    path = siblings(levels, k)
                    proofs.append(hashlib.sha256(b"".join([*(a + b for a, b in path), rest])).hexdigest())
                    roots.append(folded(folded(x.hex().encode() if x is not None else d, path), suffix).decode())
                n = len(own)
                columns = [inner.field("key"), pa.array([d.decode() for d in own]), pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    joined = blocks.join(above.withColumnRenamed("pos", "block"), ["g", "block"])
    return joined.mapInArrow(tidy(run), f"`{key}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents, in which every third one (by the CRC-32 of its id) is met with its text in lower case."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, tampered=third, changes={"text": F.translate(F.col("text"), UPPER, LOWER)})
