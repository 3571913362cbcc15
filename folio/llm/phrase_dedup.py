"""Removal of word sequences that have stood in a corpus before, found by recompression.

Words are what lies between white space. A window is a run of `window` words of one
document. Every word that a window covers which also starts earlier (in a document of lesser id,
or earlier in the same one) is removed; windows are judged on the input.

Windows that follow each other and share an anchor (`recompression`) are a piece. A first Spark
round names the anchors of the whole corpus: a piece whose anchor occurs once holds nothing
repeated. A second round names whole pieces: all but the first of equal ones go. Where
different pieces share an anchor, a third names the windows of the first ones, and what is not a window's
first place goes. No step compares pairs, and a name of any frequency is spread over all
tasks: copies in one batch are known to be shared without meeting the others, and the later
rounds reduce before they exchange.

Null texts have no words. Null ids come before all others. Rows that share an id are one document for the
order: of windows at equal places none is earlier, so repeated rows leave each other alone. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import staged, tidy, unstage
from folio.llm.recompression import END, LONG_WORD, Words, anchors
from folio.llm.suffix_dedup import covered

WINDOW = 20
#: Bytes of texts that are recompressed together, and words of a longer text.
BUFFER, PART = 1_500_000, 100_000
#: What stands for a null id in the order.
BEFORE_ALL = -(2**63)


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a text. Very long ones are replaced by a fingerprint behind a byte that no text has."""
    words = (data or b"").split()
    if len(data or b"") > LONG_WORD and any(len(w) > LONG_WORD for w in words):
        words = [b"\xfe" + xxhash.xxh3_128_hexdigest(w).encode() if len(w) > LONG_WORD else w for w in words]
    return words


def buffers(texts: list[bytes | None], window: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Buffers for `Words`, and (text, first word) of what they hold; parts of long texts share all but one word of a window."""
    held: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0
    for k, data in enumerate(texts):
        words = words_of(data)
        for low in range(0, max(1, len(words) - window + 1), PART):
            part = words[low : low + PART + window - 1]
            if len(part) < window:
                continue
            joined = b" ".join(part)
            held += [joined, END]
            owners.append((k, low))
            size += len(joined)
            if size >= BUFFER:
                yield b" ".join(held), owners
                held, owners, size = [], [], 0
    if held:
        yield b" ".join(held), owners


PIECE = "name long, fp1 long, fp2 long, d1 long, d2 int, start int, windows int, copies boolean, again boolean"


def pieces(rows: DataFrame, window: int) -> DataFrame:
    """The pieces of all rows (d1, d2, body).

    copies: the buffer has several pieces of that anchor; again: and this is not the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, owners in buffers(batch.column(2).to_pylist(), window):
                words = Words(data)
                start, name, place = anchors(words, window)
                first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (name[1:] != name[:-1]))[: len(start)])
                windows = np.diff(np.append(first, len(start)))
                name, start = name[first], start[first]
                low, high = words.first[start], words.last[start + windows + window - 2]
                prints = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                fp = np.frombuffer(prints, "<i8").reshape(-1, 2)
                part = np.searchsorted(words.ends, start)
                text, skipped = (np.array(x, np.int64) for x in zip(*owners, strict=True))
                own = start - np.append(0, words.ends + 1)[part] + skipped[part]
                again = np.ones(len(name), bool)
                _, one, of, many = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                again[one] = False
                doc = text[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (name.view(np.int64), np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1]), d1[doc], d2[doc], own.astype(np.int32), windows.astype(np.int32), many[of] > 1, again)],
                    names=["name", "fp1", "fp2", "d1", "d2", "start", "windows", "copies", "again"],
                )

    return rows.select("d1", "d2", "body").mapInArrow(tidy(run), PIECE)


def shared(found: DataFrame) -> DataFrame:
    """The pieces whose anchor occurs more than once.

    Of the pieces of a buffer that share an anchor one stands for all; only these meet, so a hot anchor has a
    row a buffer. The others are dealt by their places.
    """
    dealt = found.withColumn("deal", F.when(F.col("again"), F.xxhash64("d1", "d2", "start")).otherwise(F.lit(0)))
    several = F.count(F.lit(1)).over(Window.partitionBy("name", "deal"))
    return dealt.withColumn("n", several).where("copies or n > 1").drop("deal", "copies", "again", "n")


def window_prints(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(w1, w2, d1, d2, start) of every window of the pieces (d1, d2, start, windows)."""
    lists = wanted.groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "windows")).alias("wanted"))
    both = rows.select("d1", "d2", "body").join(lists.hint("shuffle_hash"), ["d1", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, asked in enumerate(batch.column(3)):
                words = words_of(batch.column(2)[i].as_py())
                at = sorted({p for x in asked.as_py() for p in range(x["start"], x["start"] + x["windows"])})
                prints = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(words[p : p + window])) for p in at]), "<i8").reshape(-1, 2)
                n = len(at)
                columns = [np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1]), np.full(n, d1[i], np.int64), np.full(n, d2[i], np.int32), np.array(at, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w1", "w2", "d1", "d2", "start"])

    return both.mapInArrow(tidy(run), "w1 long, w2 long, d1 long, d2 int, start int")


def repeated_runs(rows: DataFrame, window: int) -> DataFrame:
    """(d1, d2, runs) of the rows (d1, d2, body) with words to remove: runs [first, last) of words."""
    kept = staged(shared(pieces(rows, window)), "shared")
    kinds = kept.groupBy("name", "fp1", "fp2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d1", "start")).alias("at"))
    kinds = staged(kinds, "kinds")
    place = F.struct("d1", "start")
    last = (F.col("start") + F.col("windows") + F.lit(window - 1)).alias("last")
    copies = kept.join(kinds.where("n > 1").select("name", "fp1", "fp2", "at"), ["name", "fp1", "fp2"])
    whole = copies.where(place > F.col("at")).select("d1", "d2", F.col("start").alias("first"), last)
    # where different pieces share an anchor, the first of each kind can hold windows of the others
    mixed = staged(kinds.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("name"), "mixed")
    open_ = staged(kinds.join(mixed, "name").select("name", "fp1", "fp2", "at"), "open")
    firsts = kept.join(open_, ["name", "fp1", "fp2"]).where(place == F.col("at")).select("d1", "d2", "start", "windows")
    prints = staged(window_prints(rows, firsts, window), "windows")
    least = prints.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).where("n > 1").select("w1", "w2", "at")
    least = staged(least, "least")
    single = prints.join(least, ["w1", "w2"]).where(place > F.col("at"))
    single = single.select("d1", "d2", F.col("start").alias("first"), (F.col("start") + F.lit(window)).alias("last"))
    runs = staged(whole.union(single).groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")
    unstage(kept, kinds, mixed, open_, prints, least)
    return runs


def identified(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A struct of the columns `keep`, body, and what names a row's content: d1, d2."""
    body = F.col(f"`{text}`").cast("binary")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), body.alias("body"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(BEFORE_ALL)).alias("d1"),
        F.shiftright(F.xxhash64(F.col("doc_id").isNull(), body), 33).cast("int").alias("d2"),
    )


def spans(docs: DataFrame, window: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row: a struct `kept` of its columns `keep`, its body, and the runs of its words to remove (null: none)."""
    rows = identified(docs, text, list(keep))
    runs = repeated_runs(rows, window)
    return rows.join(runs.hint("shuffle_hash"), ["d1", "d2"], "left").select("kept", "body", "runs")


def without(data: bytes | None, runs: list[dict] | None) -> tuple[int, list[bytes]]:
    """The number of words, and those that stay."""
    words = (data or b"").split()
    left, at = [], 0
    for a, b in covered([(r["first"], r["last"]) for r in runs or ()]):
        left += words[at:a]
        at = b
    return len(words), left + words[at:]


def removals(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by single spaces) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                count, left = without(data, runs)
                n.append(count)
                gone.append(count - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).field(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spans(docs, window, text).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents with all their columns; texts of which words go are what stays, joined by single spaces."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [data if not runs else b" ".join(without(data, runs)[1]) for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            texts = [x.decode() if x is not None else None for x in left]
            yield pa.RecordBatch.from_arrays([*[batch.column(0).field(k) for k in range(len(names))], pa.array(texts, pa.string())], names=[*names, text])

    return spans(docs, window, text, tuple(names)).mapInArrow(tidy(run), schema).select(*docs.columns)
