"""Best-fit packing of token sequences by hierarchical residual packing.

Level 0: each task tokenizes its documents and packs their pieces best-fit
decreasing; only bins left with much room stay open. Higher levels take the
open bins as items, deal them to ever fewer groups, and pack again, until
one group of bounded size is left. Token ids never move: a level only says
where a bin goes (new bin, shift), and these moves are composed.

Null or empty texts are a document of the closing id alone. Repeated rows are
packed each for itself. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import fold, learned, only, staged, tidy

#: Tokens of a sequence.
CAPACITY = 2048
#: A bin with no more room than this is full enough to leave the tree.
SLACK = 8
#: Pieces that a task packs together.
RUN = 200_000
#: Bins that one group of a higher level packs.
GROUP = 8_192
#: Words whose ids a task remembers.
REMEMBERED = 600_000
#: Words that the tokenizer is asked about in one text.
JOINED = 100
#: Characters that are tokenized together.
CHARS = 3_000_000

#: The tokenizer's word pattern for texts of Latin-1 characters, where lower-casing and NFC change no word's extent.
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\t-\\r \\x85\\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: What the tokenizer takes for anything but white space.
SOLID = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SPECIAL = re.compile("<\\|(?:startoftext|endoftext)\\|>")


class Words:
    """Token ids of words, asked of the tokenizer once for each distinct word.

    Words are what lies between white space or, in Latin-1 texts, the pieces that the tokenizer's own
    pattern makes; it encodes each by itself, so the ids of a text are those of its words in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return SOLID.findall(text)
        return SOLID.findall(text) if SPECIAL.search(text) else LATIN_WORDS.findall(text.lower())

    def ask(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, many to a text where the tokenizer takes each for one word."""
        out: list[list[int]] = []
        for lo in range(0, len(words), JOINED):
            part = words[lo : lo + JOINED]
            if all(map(LATIN_WORDS.fullmatch, part)):
                e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                ids, ends = e.ids, np.flatnonzero(np.diff(np.array([*e.word_ids, -1]))) + 1
                if len(ends) == len(part):
                    out += [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                    continue
            out += [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        return out

    def learn(self, words: list[str]) -> None:
        for w, ids in zip(words, self.ask(words), strict=True):
            k, n = len(self.number), len(ids)
            if k == len(self.start):
                self.start, self.size = np.resize(self.start, 2 * k), np.resize(self.size, 2 * k)
            if self.used + n > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + n))
            self.ids[self.used : self.used + n] = ids
            self.start[k], self.size[k] = self.used, n
            self.used += n
            self.number[w] = k

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        lists = [self.split(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.clear()
        counts = np.array([len(x) for x in lists], np.int64)
        words = list(chain.from_iterable(lists))
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            late = [words[k] for k in missing.tolist()]
            self.learn(list(dict.fromkeys(late)))
            at[missing] = [self.number[w] for w in late]
        size = self.size[at]
        total = int(size.sum())
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[np.cumsum(counts)] if len(at) else np.zeros(len(lists), np.int64)
        return np.split(ids, cuts[:-1]) if len(lists) else []


def known_words(path: str) -> Words:
    """What this Python worker has learned; its later tasks go on with it."""
    known = learned("tokens")
    if path not in known:
        known.clear()
        known[path] = Words(path)
    return known[path]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin and offset; for each bin its fill.

    Bins are kept by the room they have; a bit set says which rooms occur, so the
    tightest bin is found by shifting it, whatever the number of bins.
    """
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    fills: list[int] = []
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    for i in order:
        n = sizes[i]
        fitting = rooms >> n
        if fitting:
            r = n + ((fitting & -fitting).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                rooms &= ~(1 << r)
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += n
        if r > n:
            room[r - n].append(b)
            rooms |= 1 << (r - n)
    return where, offset, np.array(fills, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def pack_locally(batches: Iterator[pa.RecordBatch], path: str, capacity: int, closing: int, text: str) -> Iterator[pa.RecordBatch]:
    """Level 0 of one task: its pieces with their bins."""
    words = known_words(path)
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    held: list[tuple[list, np.ndarray]] = []
    count = bins = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, count, bins
        if not held:
            return
        doc = [d for ids, _ in held for d in ids]
        table = np.concatenate([t for _, t in held])
        where, offset, fill = best_fit(table[:, 2], capacity)
        columns = [pa.array(doc, pa.int64()), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, k]) for k in (1, 2, 3)), pa.array(base + bins + where), pa.array(offset), pa.array(fill[where])]
        bins += len(fill)
        held, count = [], 0
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])

    end = np.array([closing], "<u4")
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column(text)
        lo = 0
        while lo < len(ids):
            hi, chars, body = lo, 0, []
            while hi < len(ids) and (hi == lo or chars < CHARS):
                body.append(texts[hi].as_py() or "")
                chars += len(body[-1])
                hi += 1
            doc, rows = [], []
            for d, got in zip(ids[lo:hi], words.encode(body), strict=True):
                whole = np.concatenate((got.astype("<u4"), end))
                for k, s in enumerate(range(0, len(whole), capacity)):
                    part = whole[s : s + capacity]
                    doc.append(d)
                    rows.append((k, s, len(part), zlib.crc32(part)))
            held.append((doc, np.array(rows, np.int64)))
            count += len(rows)
            if count >= RUN:
                yield from flush()
            lo = hi
    yield from flush()


def merge_level(open_bins: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Packs bins (bin, fill) as items within groups; gives (bin, into, shift, fill) with the fill of the new bin.

    Bin numbers of a level carry it in their top bits, so they never meet those of another.
    """

    def pack(key, table):
        table = table.sort_by("bin")
        where, shift, fill = best_fit(table["fill"].to_numpy(), capacity)
        into = (level << 58) + (key[0].as_py() << 32) + where
        return pa.table({"bin": table["bin"], "into": into, "shift": shift, "fill": fill[where]})

    return open_bins.groupBy(fold(F.col("bin"), groups).alias("g")).applyInArrow(pack, "bin long, into long, shift long, fill long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0, slack: int = SLACK, group: int = GROUP, text: str = "text") -> DataFrame:
    """Every piece of every document with the sequence and offset that it gets."""

    def local(batches):
        return pack_locally(batches, path, capacity, closing, text)

    pieces = staged(only(docs, "doc_id", text).mapInArrow(tidy(local, "tokens"), PIECES), "packed")
    open_bins = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
    moves = None
    level = 1
    left = open_bins.count()
    while left:
        groups = -(-left // group)
        step = staged(merge_level(open_bins, groups, level, capacity), f"packed-{level}")
        taken = step.select(F.col("bin").alias("mid"), "into", F.col("shift").alias("more"))
        if moves is None:
            moves = step.select("bin", "into", "shift")
        else:
            went = moves.withColumnRenamed("into", "mid").join(taken, "mid", "left")
            moves = staged(went.select("bin", F.coalesce("into", "mid").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "moves")
        if groups == 1:
            break
        open_bins = step.where((F.col("shift") == 0) & (F.col("fill") < capacity - slack)).select(F.col("into").alias("bin"), "fill")
        before, left = left, open_bins.count()
        if left > 0.9 * before:
            break
        level += 1
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), "offset")
    placed = pieces.join(moves, "bin", "left")
    return placed.select(*out, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
