"""Alignment of two tokenizers' tokens over the same text, and the token pairs that it links.

Both tokenizations of a text cover the same bytes. Where a token of each ends is a cut; the
tokens between two cuts are a group, and every token of one side in it is linked with every one of the other.

A text is a sequence of units: a white space between two other characters begins one. No token
of either vocabulary crosses such a place, so the alignment of a text is that of its units, one
after another. Each distinct unit is tokenized and aligned once in a task: running sums of byte
lengths give the ends, `intersect1d` the cuts, `searchsorted` the group of each token, and
repeats expand groups into links. Texts are then put together from the numbers of their units.

The documents of a pair are counted by a salted aggregation in two stages over the links of each
document. Every pair's count is compared with the highest of its first token. At most `KNOWN` of the
most frequent pairs are broadcast with their counts; links of the others, whose groups are
therefore small, get theirs through an exchange.

Null and empty texts, and those that either vocabulary cannot spell (their bytes differ from a space and the text),
have no tokens: zeros and empty lists. Repeated rows count as documents of their own. Special tokens in texts are
plain text. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import learned, only, staged, tidy

#: Distinct pairs that are broadcast at most (17 bytes each).
KNOWN = 500_000
#: Parts that the rows of a pair are dealt to before they meet.
SALTS = 16
#: Units, and characters of units, that a task remembers.
REMEMBERED, CHARS = 400_000, 40_000_000
#: Characters of units that are tokenized in one text, and aligned together; and of texts that are put together at once.
JOINED, ASKED, TEXTS = 10_000, 1_000_000, 2_000_000
#: A pair of ids as one number: the first tokenizer's above, the second's below.
BELOW = 32

UNIT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Spelling:
    """The bytes of every id of a vocabulary, one after another."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pair:
    """Two tokenizers, and the units that they have aligned in this worker."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        value = byte_values()
        tokens = [self.a.id_to_token(k) for k in range(self.a.get_vocab_size())]
        self.spelled_a = Spelling([bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in tokens])
        byte = re.compile("<0x([0-9A-F]{2})>")
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.spelled_b = Spelling([bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces])
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.written: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, and links, as used by places in `links`
        self.links, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bad = np.zeros(0, bool)

    def encoded(self, parts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each part, the units of which follow each other; None if a vocabulary fails to spell it.

        A part stands behind a word of its own, whose token is taken away again, unless it begins with two white spaces.
        """
        joined = ["".join(p) for p in parts]
        alone = [t[1].isspace() for t in joined]
        a = self.a.encode_batch([t if x else " a" + t for t, x in zip(joined, alone, strict=True)], add_special_tokens=False)
        b = self.b.encode([t[1:] if x else "a" + t for t, x in zip(joined, alone, strict=True)], num_threads=1)  # writes a space before
        for t, x, e, f in zip(joined, alone, a, b, strict=True):
            one, two = (np.array(ids if x else ids[1:], np.int64) for ids in (e.ids, f))
            said = t.encode()
            yield (one, two) if self.spelled_a.of(one).tobytes() == said == self.spelled_b.of(two).tobytes() else None

    def parts(self, units: list[str]) -> Iterator[list[str]]:
        """The units in lists of about JOINED characters. One that begins or ends with white space too many stays alone."""
        held, chars = [], 0
        for u in units:
            if u[1].isspace() or u[-1].isspace():
                yield [u]
                continue
            held.append(u)
            chars += len(u)
            if chars >= JOINED:
                yield held
                held, chars = [], 0
        if held:
            yield held

    def aligned(self, units: list[str]) -> tuple[list[str], np.ndarray, list[str], np.ndarray, np.ndarray]:
        """The units, in another order, with their counts, written groups, links, and whether a vocabulary fails."""
        good, fail, ids = [], [], []
        open_ = list(self.parts(units))
        while open_:
            again = []
            for part, found in zip(open_, self.encoded(open_), strict=True):
                if found is not None:
                    good += part
                    ids.append(found)
                elif len(part) > 1:
                    again += [[u] for u in part]
                else:
                    fail += part
            open_ = again
        a, b = (np.concatenate(x) for x in zip(*ids, strict=True)) if ids else (np.zeros(0, np.int64),) * 2
        unit_ends = np.cumsum(np.array([len(u.encode()) for u in good], np.int64))
        ends_a, ends_b = np.cumsum(self.spelled_a.size[a]), np.cumsum(self.spelled_b.size[b])
        cuts = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        many_a, many_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        # each token of A is repeated for all tokens of B in its group
        links = (np.repeat(a, many_b[group_a]) << BELOW) | b[spans(first_b[group_a], many_b[group_a])]
        unit_of = np.searchsorted(unit_ends, cuts)
        n = len(good)
        per_unit = [np.bincount(unit_of, x, n).astype(np.int64) for x in (many_a, many_b, np.ones(len(cuts)), many_a * many_b)]
        counts = np.concatenate((np.stack(per_unit, axis=1), np.zeros((len(fail), 4), np.int64)))
        # tokens as they are written: those of A, then those of B of each group
        order, mark = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        at_a, at_b = spans(first_a + first_b, many_a), spans(first_a + many_a + first_b, many_b)
        order[at_a], order[at_b] = a, b
        mark[first_a + many_a + first_b - 1] = 1
        mark[first_a + many_a + first_b + many_b - 1] = 2
        tokens = [f"{i}{','if m == 0 else '|' if m == 1 else ';'}" for i, m in zip(order.tolist(), mark.tolist(), strict=True)]
        edges = np.append(0, np.cumsum(per_unit[0] + per_unit[1])).tolist()
        written = ["".join(tokens[x:y])[:-1] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        return good + fail, counts, written + [""] * len(fail), links, np.arange(n + len(fail)) >= n

    def learn(self, units: list[str]) -> None:
        """Aligns units that are not known."""
        low = 0
        while low < len(units):
            high, chars = low, 0
            while high < len(units) and (chars < ASKED or high == low):
                chars += len(units[high])
                high += 1
            part, counts, written, links, bad = self.aligned(units[low:high])
            self.number.update(zip(part, range(len(self.written), len(self.written) + len(part)), strict=True))
            self.written += written
            self.start = np.append(self.start, len(self.links) + np.cumsum(counts[:, 3]) - counts[:, 3])
            self.links = np.append(self.links, links)
            self.counts = np.concatenate((self.counts, counts))
            self.bad = np.append(self.bad, bad)
            self.chars += chars
            low = high

    def texts(self, texts: list[str]) -> Iterator[tuple]:
        """For each text: counts of tokens, groups and links, the groups as text (None without tokens), the distinct links and how often each occurs."""
        if len(self.number) > REMEMBERED or self.chars > CHARS:
            self.clear()
        lists = [UNIT.split(f" {t}") if t else [] for t in texts]
        missing = dict.fromkeys(u for x in lists for u in x if u not in self.number)
        self.learn(list(missing))
        sizes = np.array([len(x) for x in lists], np.int64)
        at = np.fromiter((self.number[u] for x in lists for u in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        fails = np.bincount(owner, self.bad[at], len(texts)) > 0
        sums = np.stack([np.bincount(owner, self.counts[at, k], len(texts)) for k in range(4)], axis=1).astype(np.int64)
        # distinct units of each text, then their links, then the distinct links
        kinds, times = np.unique(owner * len(self.written) + at if len(at) else at, return_counts=True)
        unit, of = (kinds % len(self.written), kinds // len(self.written)) if len(kinds) else (kinds, kinds)
        many = self.counts[unit, 3]
        code, of, times = self.links[spans(self.start[unit], many)], np.repeat(of, many), np.repeat(times, many)
        order = np.lexsort((code, of))
        code, of, times = code[order], of[order], times[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1]))[: len(code)])
        code, of, times = code[first], of[first], np.add.reduceat(times, first) if len(first) else times
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        ends = np.cumsum(sizes)
        for k in range(len(texts)):
            if fails[k] or not sizes[k]:
                yield (0, 0, 0, 0), None, code[:0], times[:0]
                continue
            written = ";".join([self.written[i] for i in at[ends[k] - sizes[k] : ends[k]].tolist()])
            yield tuple(sums[k].tolist()), written, code[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]]


def known_pair(first: str, second: str) -> Pair:
    """What this Python worker has aligned; its later tasks go on with it."""
    known = learned("alignment")
    if (first, second) not in known:
        known.clear()
        known[first, second] = Pair(first, second)
    return known[first, second]


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, {}, links array<long>, times array<long>"


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", written: bool = True) -> DataFrame:
    """For each row: its key, n_a, n_b, n_groups, n_links, the groups, and its distinct links with how often each occurs.

    first, second: paths of a byte-level vocabulary (tokenizers) and of a piece model (sentencepiece). A link
    is a number, the id of the first tokenizer times 2 ** 32 and that of the second. The groups are text
    (`groups`, null without tokens), or with written=False their SHA-256 (`groups_sha256`, '' without tokens).
    """
    name = "groups" if written else "groups_sha256"

    def show(groups: str | None) -> str | None:
        return groups if written else hashlib.sha256(groups.encode()).hexdigest() if groups is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = known_pair(first, second)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and (chars < TEXTS or high == low):
                    chars += len(texts[high] or "")
                    high += 1
                counts, groups, links, times = zip(*pair.texts(texts[low:high]), strict=True)
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in links])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (links, times)]
                numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *numbers, pa.array([show(g) for g in groups], pa.string()), *lists], names=[key, "n_a", "n_b", "n_groups", "n_links", name, "links", "times"])
                low = high

    kind = docs.schema[key].dataType.simpleString()
    return only(docs, key, text).mapInArrow(tidy(run, "alignment"), f"`{key}` {kind}, {ALIGNED.format(f'{name} string')}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, n, best) of every linked pair: how many documents hold it, and whether no pair of its first token has more.

    aligned: has links, the distinct links of a document, and row, a number that deals a pair's rows.
    """
    seen = aligned.select(F.explode("links").alias("link"), F.pmod(F.col("row"), F.lit(SALTS)).alias("salt"))
    parts = seen.groupBy("link", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(parts.groupBy("link").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("link", BELOW)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    # one row for each id of the first vocabulary at most
    return counts.join(F.broadcast(highest), a == F.col("a")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, limit: int) -> int:
    """The least count such that no more than `limit` pairs have it or more, in steps of a tenth."""
    step = F.floor(F.log(F.col("n")) / F.lit(float(np.log(1.1))))
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
    held, least = 0, None
    for s in steps:
        held += s.pairs
        if held > limit:
            break
        least = s.least
    return least if least is not None else int(2**62)


def scored(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", known: int = KNOWN) -> DataFrame:
    """For each row: its key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A link's count is the number of rows that hold it. n_best: links whose count is the highest of their
    first token; count_sum: the sum of counts, both over all occurrences of links.
    """
    aligned = staged(align(docs, first, second, key, text, written=False).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = staged(pair_counts(aligned), "counts")
    least = frequent(counts, known)
    top = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(top["link"].to_numpy())
    table = docs.sparkSession.sparkContext.broadcast((top["link"].to_numpy()[order], top["n"].to_numpy()[order], top["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n, best = table.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy()
            code = lists.flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(links, code), max(0, len(links) - 1))
            found = links[at] == code if len(links) else np.zeros(len(code), bool)
            there = at[found]
            cut = np.searchsorted(of[found], np.arange(batch.num_rows + 1))
            sums = [np.diff(np.append(0, np.cumsum(x))[cut]) for x in ((times[found] * best[there], times[found] * n[there]) if len(links) else (times[:0], times[:0]))]
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(of[~found], minlength=batch.num_rows))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~found].astype(np.int64))) for x in (code, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s.astype(np.int64)) for s in sums], *rest], names=["row", "n_best", "count_sum", "links", "times"])

    looked = staged(aligned.select("row", "links", "times").mapInArrow(tidy(run, "alignment"), "row long, n_best long, count_sum long, links array<long>, times array<long>"), "looked")
    rare = looked.where(F.size("links") > 0).select("row", F.explode(F.arrays_zip("links", "times")).alias("e")).select("row", "e.*")
    rare = rare.join(counts.where(F.col("n") < least), rare["links"] == counts["link"]).select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = looked.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    shown: list[Column | str] = [F.col(f"`{key}`"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.drop("links", "times").join(sums, "row").select(*shown)

