"""A positional full-text index that is kept up, and searched in part.

A folder holds segments: a first one, then one for every change. A row of `postings` is a lexeme in a
range of at most about `DOCS` documents: who has it, where, and the most that one has. Ranges cut hot lexemes, and
`part`, a folder, is a hash of the lexeme, so a search reads the parts of its lexemes and, sorted as they are, few row groups of
them. A folder of its own lists the documents of each range; `gone` lists, by range, the documents of earlier segments that a later one has
replaced or removed. A segment counts from its line in `commits` on, which is written last: a
change that fails midway is not seen, and the next one takes another number.

A search (conjunctions of alternatives, phrases, exclusions; cover density) first reads lexemes,
ranges and maxima alone. They bound the score in each range. The most promising ranges of a question
are scored; of the others only those whose bound reaches the score of the last place. So
results are those of scoring all.

Null texts are documents without lexemes. Keys are not null and unique within a change; the last change of a key counts.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.lexical import STOP_WORDS, WORD, Stemmer, covers, parse
from folio.sources.shared import exists, kept, removed

#: Documents of a range, and characters after which it is cut; folders of lexemes.
DOCS, CHARS, PARTS = 1024, 8_000_000, 32
#: Ranges of a question that are scored before the others are judged by their bounds.
FIRST = 4
#: Bits of a range's number below the segment's, and below the task's.
RANGE_BITS, TASK_BITS = 44, 20
#: The folder of the rows that list a range's documents.
LISTED = -1

ENTRIES = "lexeme string, range long, n int, best int, held binary, keys array<{}>"


def plain(word: str) -> str:
    return word


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0] + 1, ..., n[0] of them, then those from start[1], and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def packed(codes: np.ndarray, ords: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Occurrences (lexeme's code, document's number, position), sorted, as rows: codes, `held`, documents, and the most that one has.

    held: 32-bit numbers of the documents, how often each has the lexeme, and all positions.
    """
    entry = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (ords[1:] != ords[:-1]))[: len(codes)])
    row = np.flatnonzero(np.append(True, codes[entry][1:] != codes[entry][:-1])[: len(entry)])
    many = np.diff(np.append(entry, len(codes))).astype("<i4")
    ends = np.append(row, len(entry))
    cuts = np.append(entry, len(codes))[ends]
    n, said = np.diff(ends), np.diff(cuts)
    size = 2 * n + said
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), "<i4")
    flat[spread(start, n)] = ords[entry]
    flat[spread(start + n, n)] = many
    flat[spread(start + 2 * n, said)] = places
    held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.append(0, np.cumsum(size)) * 4).astype(np.int32)), pa.py_buffer(flat)])
    return codes[entry][row], held, n.astype(np.int32), (np.maximum.reduceat(many, row) if len(row) else many).astype(np.int32)


def unpacked(held: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the documents, how often each has the lexeme, and all positions."""
    x = np.frombuffer(held, "<i4")
    return x[:n], x[n : 2 * n], x[2 * n :]


def range_rows(keys: pa.Array, words: np.ndarray, number: int, lexemes: list[str], held: pa.Array, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The rows of a range: that of its documents, with their keys and numbers of words, and one for each lexeme."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(keys)] + [len(keys)] * len(held), pa.int32()), keys, mask=pa.array([False] + [True] * len(held)))
    arrays = [pa.array([None, *lexemes], pa.string()), pa.array(np.full(len(held) + 1, number, np.int64)), pa.array(np.append(np.int32(len(keys)), n)), pa.array(np.append(np.int32(0), best)), pa.concat_arrays([pa.array([words.astype("<i4").tobytes()], pa.binary()), held]), lists]
    return pa.RecordBatch.from_arrays(arrays, names=["lexeme", "range", "n", "best", "held", "keys"])


def gathered(keys: pa.Array, texts: list[str | None], number: int, stem: Callable[[str], str]) -> pa.RecordBatch:
    """The rows of a range of documents."""
    known: dict[str, int] = defaultdict(count().__next__)
    lists = [WORD.findall((t or "").lower()) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    words = np.fromiter((known[w] for x in lists for w in x), np.int64, int(sizes.sum()))
    lexemes: dict[str, int] = defaultdict(count().__next__)
    lexeme_of = np.array([-1 if w in STOP_WORDS else lexemes[stem(w)] for w in known], np.int64)
    code = lexeme_of[words] if len(words) else words
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    order = np.argsort(code, kind="stable")
    order = order[np.searchsorted(code[order], 0) :]
    codes, held, n, best = packed(code[order], np.repeat(np.arange(len(lists)), sizes)[order], place[order])
    names = list(lexemes)
    return range_rows(keys, sizes, number, [names[k] for k in codes.tolist()], held, n, best)


def alive(rows: pa.Table, gone: pa.Table) -> tuple[pa.Array, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """What a few ranges hold of living documents, numbered anew: keys, words, lexemes; and occurrences (lexeme's code, document, position), sorted.

    rows: of all those ranges; gone: (range, ord) of their dead documents.
    """
    ranges, ns = rows["range"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
    listed = rows["lexeme"].is_null().to_numpy(zero_copy_only=False)
    held = rows["held"].combine_chunks()
    starts = np.frombuffer(held.buffers()[1], "<i4")[held.offset : held.offset + len(held) + 1].astype(np.int64) // 4
    packs = np.frombuffer(held.buffers()[2] or b"", "<i4", int(starts[-1]))
    # the documents of all ranges in order, and the new number of each, -1 for dead ones
    lists = np.flatnonzero(listed)
    lists = lists[np.argsort(ranges[lists], kind="stable")]
    known, base = ranges[lists], np.cumsum(ns[lists]) - ns[lists]
    living = np.ones(int(ns[lists].sum()), bool)
    living[base[np.searchsorted(known, gone["range"].to_numpy())] + gone["ord"].to_numpy()] = False
    number = np.where(living, np.cumsum(living) - 1, -1)
    keys = pa.concat_arrays([rows["keys"][k].values for k in lists.tolist()]).filter(pa.array(living))
    words = packs[spread(starts[lists], ns[lists])][living]
    some = np.flatnonzero(~listed)
    names = rows["lexeme"].take(pa.array(some)).combine_chunks().dictionary_encode()
    n, start = ns[some], starts[some]
    many = packs[spread(start + n, n)]
    ords = number[np.repeat(base[np.searchsorted(known, ranges[some])], n) + packs[spread(start, n)]]
    places = packs[spread(start + 2 * n, starts[some + 1] - start - 2 * n)]
    code, ords = np.repeat(np.repeat(names.indices.to_numpy(), n).astype(np.int64), many), np.repeat(ords, many)
    left = ords >= 0
    code, ords, places = code[left], ords[left], places[left]
    order = np.argsort(code * max(1, len(keys)) + ords, kind="stable")  # places of a document ascend
    return keys, words, names.dictionary.to_pylist(), code[order], ords[order], places[order]


def analysed(rows: DataFrame, key: str, text: str, stemmed: bool, segment: int) -> DataFrame:
    """The rows of all ranges. A range is what a task reads next: DOCS rows, or fewer of long texts."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = Stemmer() if stemmed else plain
        number = (segment << RANGE_BITS) + (TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < min(len(texts), low + DOCS) and (chars < CHARS or high == low):
                    chars += len(texts[high] or "")
                    high += 1
                yield gathered(batch.column(0)[low:high], texts[low:high], number, stem)
                low, number = high, number + 1

    return rows.select(key, text).mapInArrow(run, ENTRIES.format(kind))


def needs(text: str, stemmed: bool) -> dict | None:
    """What a question asks for, and how long a cover of it is at least; None if it asks for nothing."""
    asked = parse(text, None if stemmed else plain)
    if not asked["all_of"]:
        return None
    every = [t for a in asked["all_of"] for t in set(a)]
    # alternatives that share a word can be met by one place
    return asked | {"least": len(asked["all_of"]) if len(set(every)) == len(every) else 1}


@dataclass
class TextIndex:
    """An index at a path: key is the name that its users have for the documents' key, kind its type."""

    spark: SparkSession
    path: str
    key: str
    kind: str
    stemmed: bool
    seen: list[int] | None = None

    # what there is

    def segments(self) -> list[int]:
        """The segments that count: the last whole one and the changes after it. What another writer has added since is not seen."""
        if self.seen is None:
            self.seen = self.committed()
        return self.seen

    def committed(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        lines = self.spark.read.schema("segment int, whole boolean").json(f"{self.path}/commits").collect()  # a line a change since the index began
        whole = max(r.segment for r in lines if r.whole)
        return sorted(r.segment for r in lines if r.segment >= whole)

    def stored(self, name: str, schema: str) -> DataFrame:
        paths = [p for s in self.segments() if exists(self.spark, p := f"{self.path}/{name}/segment={s}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    @property
    def rows(self) -> DataFrame:
        return self.stored("postings", f"{ENTRIES.format(self.kind)}, segment int, part int")

    @property
    def postings(self) -> DataFrame:
        return self.rows.where(F.col("part") != LISTED)

    @property
    def gone(self) -> DataFrame:
        """(range, ord): the documents of each range that a later segment has replaced or removed."""
        return self.stored("gone", "range long, ord int, segment int").select("range", "ord").distinct()

    def documents(self) -> DataFrame:
        """(key, range, ord) of the documents that count."""
        listed = self.rows.where(F.col("part") == LISTED).select("range", F.posexplode("keys").alias("ord", "key"))
        return listed.join(self.gone, ["range", "ord"], "left_anti").select("key", "range", "ord")

    def by_ranges(self, number: Column, run: Callable, schema: str) -> DataFrame:
        """What `run` makes of the rows and the dead documents of each group of ranges that `number` names."""
        rows = self.rows.drop("part", "segment").groupBy(number.alias("group"))
        return rows.cogroup(self.gone.groupBy(number.alias("group"))).applyInArrow(run, schema)

    def held_words(self) -> DataFrame:
        """(key, words, lexeme, positions) of the documents that count; one without lexemes has a row with null for the last two."""
        kind = f"key {self.kind}, words int, lexeme string, positions array<int>"

        def run(group: tuple, rows: pa.Table, gone: pa.Table) -> pa.Table:
            keys, words, lexemes, code, ords, places = alive(rows, gone) if rows.num_rows else (pa.nulls(0), np.zeros(0, np.int32), [], *[np.zeros(0, np.int64)] * 3)
            entry = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (ords[1:] != ords[:-1]))[: len(code)])
            bare = np.setdiff1d(np.arange(len(keys)), ords)
            doc = np.concatenate((ords[entry], bare)).astype(np.int64)
            offsets = np.append(np.append(entry, len(code)), [len(code)] * len(bare)).astype(np.int32)
            said = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32)), mask=pa.array(np.arange(len(doc)) >= len(entry)))
            named = pa.concat_arrays([pa.array(lexemes, pa.string()).take(pa.array(code[entry])), pa.nulls(len(bare), pa.string())])
            return pa.table({"key": keys.take(pa.array(doc)), "words": pa.array(words[doc].astype(np.int32)), "lexeme": named, "positions": said})

        return self.by_ranges(F.col("range"), run, kind)

    def entries(self) -> DataFrame:
        """(key, lexeme, positions) of the documents that count."""
        return self.held_words().where("lexeme is not null").drop("words")

    # changes

    def next_segment(self) -> int:
        """A number that no change has had, not even one that failed."""
        segment = max(self.segments(), default=-1) + 1
        while any(exists(self.spark, f"{self.path}/{n}/segment={segment}") for n in ("gone", "postings")):
            segment += 1
        return segment

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with part and spread, together by both; a lexeme of many ranges is spread over several tasks."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.when(F.col("lexeme").isNull(), LISTED).otherwise(F.pmod(F.xxhash64("lexeme"), F.lit(PARTS)).cast("int"))
        spread = F.pmod(F.xxhash64("range"), F.lit(max(1, 2 * tasks // PARTS)))
        return rows.withColumn("part", part).withColumn("spread", spread).repartition("part", "spread")

    def write(self, found: DataFrame | None, keys: DataFrame | None, segment: int, whole: bool) -> None:
        """One more segment: of the rows in `found`, as they are dealt, and without the documents with the keys in `keys`."""
        if keys is not None:
            old = self.documents().join(keys.select("key").distinct(), "key").select("range", "ord")
            old.repartition("range").write.parquet(f"{self.path}/gone/segment={segment}")
        if found is not None:
            found.drop("spread").sortWithinPartitions("part", "lexeme", "range").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/postings/segment={segment}")
        line = json.dumps({"segment": segment, "whole": whole})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/commits")
        self.seen = None

    def put(self, rows: DataFrame, text: str = "text") -> None:
        """Inserts documents, or replaces those with their keys. The rows come in the same order whenever a task reads them, as those of files do."""
        segment = self.next_segment()
        keys = rows.select(F.col(self.key).alias("key")) if self.segments() else None
        self.write(self.dealt(analysed(rows, self.key, text, self.stemmed, segment)), keys, segment, keys is None)

    def remove(self, keys: DataFrame) -> None:
        """Takes out the documents with these keys."""
        self.write(None, keys.select(F.col(self.key).alias("key")), self.next_segment(), False)

    def merge(self) -> None:
        """One whole segment in place of all, of ranges that are full again; what it replaces is no longer read."""
        segment = self.next_segment()
        full = max(1, -(-self.documents().count() // DOCS))
        base = segment << RANGE_BITS

        def run(group: tuple, rows: pa.Table, gone: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table([])
            keys, words, lexemes, code, ords, places = alive(rows, gone)
            codes, held, n, best = packed(code, ords, places)
            return pa.Table.from_batches([range_rows(keys, words, base + group[0].as_py(), [lexemes[k] for k in codes.tolist()], held, n, best)])

        joined = self.by_ranges(F.pmod(F.xxhash64("range"), F.lit(full)), run, ENTRIES.format(self.kind))
        self.write(self.dealt(joined), None, segment, True)

    def vacuum(self) -> None:
        """Deletes the segments that a whole one has replaced; no search of before may still run."""
        for s in range(min(self.segments())):
            for name in ("gone", "postings"):
                removed(self.spark, f"{self.path}/{name}/segment={s}")

    # searches

    def asked(self, questions: DataFrame) -> DataFrame:
        """(query_id, lexeme, wanted, plan, groups, least) of questions (query_id, query_text); wanted: not an exclusion."""
        kind = questions.schema["query_id"].dataType.simpleString()
        stemmed = self.stemmed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    p = needs(text or "", stemmed)
                    if p is None:
                        continue
                    wanted = {t for a in p["all_of"] for t in a}
                    rows += [(i, t, t in wanted, json.dumps(p), len(p["all_of"]), p["least"]) for t in sorted(wanted | {t for x in p["phrases"] for t, _ in x} | set(p["none_of"]))]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=["query_id", "lexeme", "wanted", "plan", "groups", "least"])

        schema = f"query_id {kind}, lexeme string, wanted boolean, plan string, groups int, least int"
        return kept(questions.select("query_id", "query_text").mapInArrow(run, schema), "asked")

    def of_lexemes(self, asked: DataFrame) -> DataFrame:
        """Postings of the parts that the questions need."""
        part = F.pmod(F.xxhash64("lexeme"), F.lit(PARTS)).cast("int")
        parts = [r.part for r in asked.select(part.alias("part")).distinct().collect()]  # at most PARTS
        return self.postings.where(F.col("part").isin(parts))

    def bounds(self, asked: DataFrame) -> DataFrame:
        """(query_id, range, bound) of the ranges that have a word of every group: the most that a document in it can score."""
        groups = F.from_json("plan", "all_of array<array<string>>")["all_of"]
        met = F.transform(groups, lambda a: F.array_contains(a, F.col("lexeme")))
        hits = self.of_lexemes(asked).select("lexeme", "range", "best").join(asked.where("wanted"), "lexeme")
        # which groups a lexeme meets, as bits of a list
        each = hits.select("query_id", "range", "groups", "least", "best", F.posexplode(met).alias("g", "m")).where("m")
        per = each.groupBy("query_id", "range", "groups", "least").agg(F.count_distinct("g").alias("there"), F.sum("best").alias("most"))
        # a cover ends at a place of its own, and none ends before every group has one
        bound = (F.col("most") - F.col("groups") + 1) / F.col("least")
        return per.where(F.col("there") == F.col("groups")).select("query_id", "range", bound.alias("bound"))

    def scored(self, asked: DataFrame, ranges: DataFrame, limit: int) -> DataFrame:
        """(query_id, key, score): the best `limit` of each question in each of its ranges (query_id, range)."""
        terms = asked.groupBy("query_id").agg(F.first("plan").alias("plan"))
        hits = self.of_lexemes(asked).select("lexeme", "range", "n", "held").join(asked.select("query_id", "lexeme"), "lexeme").join(ranges.select("query_id", "range"), ["query_id", "range"])
        found = hits.groupBy("query_id", "range").agg(F.collect_list(F.struct("lexeme", "n", "held")).alias("terms")).join(terms, "query_id")
        wanted = ranges.select("range").distinct()
        dead = self.gone.join(wanted, "range").groupBy("range").agg(F.collect_list("ord").alias("dead"))
        listed = self.rows.where(F.col("part") == LISTED).select("range", "keys").join(wanted, "range")
        held = found.join(listed, "range").join(dead, "range", "left").select("query_id", "plan", "terms", "dead", "keys")
        kind = asked.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    keys = batch.column(4)[i].values
                    best = scored_range(json.loads(batch.column(1)[i].as_py()), batch.column(2)[i].as_py(), set(batch.column(3)[i].as_py() or ()))
                    names = keys.take(pa.array([k for k, _ in best], pa.int64()))
                    order = sorted(range(len(best)), key=lambda k: (-round(best[k][1], 9), names[k].as_py()))[:limit]  # noqa: B023
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(order), pa.int64())), names.take(pa.array(order, pa.int64())), pa.array([best[k][1] for k in order], pa.float64())], names=["query_id", "key", "score"])

        return held.mapInArrow(run, f"query_id {kind}, key {self.kind}, score double")

    def search(self, questions: DataFrame, limit: int) -> DataFrame:
        """(query_id, key, score, rank): the `limit` best documents of each question (query_id, query_text), by cover density, then key."""
        asked = self.asked(questions)
        bounds = kept(self.bounds(asked), "bounds")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        placed = bounds.withColumn("place", place)
        first = kept(self.best(self.scored(asked, placed.where(F.col("place") <= FIRST), limit), limit), "first")
        least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= limit, F.min("score")).alias("floor"))
        rest = placed.where(F.col("place") > FIRST).join(least, "query_id", "left").where(F.col("bound") >= F.coalesce(F.col("floor"), F.lit(0.0)) - F.lit(1e-9))
        every = first.drop("rank").unionByName(self.scored(asked, kept(rest.select("query_id", "range"), "rest"), limit))
        return self.best(every, limit).withColumnRenamed("key", self.key)

    @staticmethod
    def best(found: DataFrame, limit: int) -> DataFrame:
        order: list[Column | str] = [F.desc(F.round("score", 9)), "key"]
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)


def score(asked: dict, at: dict[str, list[int]]) -> float:
    """The cover density of a document with these positions; 0 if it does not match."""
    if any(t in at for t in asked["none_of"]) or not all(any(t in at for t in a) for a in asked["all_of"]):
        return 0.0
    for phrase in asked["phrases"]:
        spots = [set(at.get(t, ())) for t, _ in phrase]
        if not any(all(s - phrase[0][1] + gap in x for x, (_, gap) in zip(spots, phrase, strict=True)) for s in spots[0]):
            return 0.0
    places = sorted({(x, k) for k, a in enumerate(asked["all_of"]) for t in a for x in at.get(t, ())})
    return covers(places, len(asked["all_of"]))


def scored_range(asked: dict, terms: list[dict], dead: set[int]) -> list[tuple[int, float]]:
    """(document's number, score) of the documents of a range that match; terms: lexeme, n and held."""
    packs = {t["lexeme"]: unpacked(t["held"], t["n"]) for t in terms}
    who = {t: set(x[0].tolist()) for t, x in packs.items()}
    left: set | None = None
    for a in sorted(asked["all_of"], key=lambda a: sum(len(who.get(t, ())) for t in a)):
        some = set().union(*(who.get(t, ()) for t in a))
        left = some if left is None else left & some
        if not left:
            return []
    at: dict = {k: {} for k in (left or set()) - dead}
    for t, (ords, many, places) in packs.items():
        ends = np.cumsum(many)
        for k, o in enumerate(ords.tolist()):
            if o in at:
                at[o][t] = places[ends[k] - many[k] : ends[k]].tolist()
    found = [(o, score(asked, spots)) for o, spots in at.items()]
    return [(o, s) for o, s in found if s > 0]


def created(rows: DataFrame, path: str, key: str = "chunk_id", text: str = "text", stemmed: bool = True) -> TextIndex:
    """A new index of the rows at `path`, a folder that driver and executors share."""
    spark = rows.sparkSession
    index = TextIndex(spark, path, key, rows.schema[key].dataType.simpleString(), stemmed)
    fields = {"key": key, "kind": index.kind, "stemmed": stemmed, "id": uuid.uuid4().hex}
    spark.createDataFrame([(json.dumps(fields),)], "value string").coalesce(1).write.text(f"{path}/facts")
    index.put(rows, text)
    return index


def opened(spark: SparkSession, path: str) -> TextIndex:
    """The index stored at a path."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    return TextIndex(spark, path, facts["key"], facts["kind"], facts["stemmed"])
