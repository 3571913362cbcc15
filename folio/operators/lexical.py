"""Full-text search over an inverted index of stemmed terms with positions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that are counted in one scan, their terms, and rows that are counted at once.
QUERY_BLOCK, TERM_BLOCK, COUNTED = 2_000, 200_000, 500
#: Words that are not indexed.
STOP_WORDS = {"a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "my", "no", "nor", "not", "now", "of", "on", "or", "our", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "too", "up", "very", "was", "we", "were", "what", "when", "where", "which", "who", "whom", "why", "will", "with", "you", "your"}
WORD = re.compile(r"[^\W_]+")


class Stemmer:
    """Suffix stripping after Porter (1980)."""

    # The published rules, as suffix and replacement.
    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def __call__(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self.stem(word)
        return self.known[word]

    @staticmethod
    def shape(w: str) -> str:
        """c and v for consonants and vowels; y is a vowel after a consonant."""
        out = ""
        for i, ch in enumerate(w):
            vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    def measure(self, w: str) -> int:
        return len(re.findall("v+c", self.shape(w)))

    def vowel(self, w: str) -> bool:
        return "v" in self.shape(w)

    def short_end(self, w: str) -> bool:
        return self.shape(w).endswith("cvc") and w[-1] not in "wxy"

    def replaced(self, w: str, rules: list[tuple[str, str]], least: int) -> str:
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                return base + new if self.measure(base) > least else w
        return w

    def stem(self, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and self.vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and self.shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.short_end(w):
                        w += "e"
                    break
        if w.endswith("y") and self.vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self.replaced(w, self.STEP2, 0)
        w = self.replaced(w, self.STEP3, 0)
        for suffix in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if self.measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                    w = base
                break
        if w.endswith("e"):
            base = w[:-1]
            if self.measure(base) > 1 or (self.measure(base) == 1 and not self.short_end(base)):
                w = base
        if w.endswith("ll") and self.measure(w) > 1:
            w = w[:-1]
        return w


def lexemes(text: str, stem: Callable[[str], str]) -> list[tuple[str, int]]:
    """(stem, position) of the words of a text; stop words keep their place but are not listed."""
    return [(stem(w), i) for i, w in enumerate(WORD.findall(text.lower()), 1) if w not in STOP_WORDS]


def index(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Postings (key, lexeme, positions, words) of the rows."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = Stemmer()
        for batch in batches:
            at, terms, places, words = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found: dict[str, list[int]] = {}
                for lexeme, p in lexemes(t or "", stem):
                    found.setdefault(lexeme, []).append(p)
                at += [i] * len(found)
                terms += found
                places += found.values()
                words += [len(WORD.findall(t or ""))] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(words, pa.int32())], names=[key, "lexeme", "positions", "words"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, lexeme string, positions array<int>, words int")


def parse(question: str, stem: Callable[[str], str] | None = None) -> dict[str, list]:
    """A web-style question: words are all required, quotes make phrases, `or` joins its neighbours, `-` excludes.

    Gives all_of (lists of alternatives), phrases (lists of (stem, gap)) and none_of. Words are stemmed, or what `stem` makes of them.
    """
    stem = stem or Stemmer()
    all_of: list[list[str]] = []
    phrases: list[list[tuple[str, int]]] = []
    none_of: list[str] = []
    join = False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', question):
        if word.lower() == "or" and not minus:
            join = bool(all_of)
            continue
        found = lexemes(quoted or word, stem)
        if minus:
            none_of += [t for t, _ in found]
        elif found:
            if len(found) > 1 and quoted:
                phrases.append([(t, p - found[0][1]) for t, p in found])
            for t, _ in found:
                if join and all_of:
                    all_of[-1].append(t)
                    join = False
                else:
                    all_of.append([t])
        join = False if minus else join
    return {"all_of": all_of, "phrases": phrases, "none_of": none_of}


def covers(places: list[tuple[int, int]], needed: int) -> float:
    """Cover density (Clarke, Cormack and Tudhope, 2000): the sum over minimal covers of 1 / their length.

    places: (position, term number), sorted; a cover holds each of the needed terms.
    """
    last: dict[int, int] = {}
    score, left = 0.0, -1
    for p, t in places:
        last[t] = p
        if len(last) == needed:
            start = min(last.values())
            if start > left:
                score += 1.0 / (p - start + 1)
                left = start
    return score


def search(postings: DataFrame, questions: list[tuple[int, str]], limit: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): the chunks that match each question, by cover density.

    The lexemes of the questions, a few words each, go to the scan of the postings; only their postings are shuffled.
    """
    spark = postings.sparkSession
    parsed = {q: parse(text) for q, text in questions}
    pairs = [(q, t) for q, p in parsed.items() for t in {*[t for alternatives in p["all_of"] for t in alternatives], *[t for phrase in p["phrases"] for t, _ in phrase], *p["none_of"]}]
    kind = postings.schema[key].dataType.simpleString()
    schema = f"query_id long, {key} {kind}, score double"
    if not pairs:
        return spark.createDataFrame([], f"{schema}, rank int")
    asked = spark.createDataFrame(pairs, "query_id long, lexeme string")
    joined = postings.join(F.broadcast(asked), "lexeme")
    gathered = joined.groupBy("query_id", key).agg(F.collect_list(F.struct("lexeme", "positions")).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, scores = [], []
            for i, (q, terms) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                p = parsed[q]
                at = {t["lexeme"]: t["positions"] for t in terms}
                if any(t in at for t in p["none_of"]) or not p["all_of"] or not all(any(t in at for t in a) for a in p["all_of"]):
                    continue
                spots = {t: set(at.get(t, ())) for phrase in p["phrases"] for t, _ in phrase}
                if not all(any(all(s + gap in spots[t] for t, gap in phrase) for s in at.get(phrase[0][0], ())) for phrase in p["phrases"]):
                    continue
                places = sorted({(x, k) for k, a in enumerate(p["all_of"]) for t in a for x in at.get(t, ())})
                value = covers(places, len(p["all_of"]))
                if value > 0:
                    keep.append(i)
                    scores.append(value)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(scores, pa.float64())], names=["query_id", key, "score"])

    hits = gathered.mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def plain_terms(text: Column) -> Column:
    """The distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def matched_terms(rows: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): how many distinct terms of a query (query_id, terms) occur in a row's text.

    Rows are counted where they are scanned: the queries go out in blocks of bounded size, as a map from a term to the
    queries that have it, and a task passes on its own `limit` best rows of each query. So a word that
    every row has is counted, and never dealt out.
    """
    spark = rows.sparkSession
    kind, key_kind = queries.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    arrow_kind = to_arrow_type(queries.schema["query_id"].dataType)
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms")).orderBy("query_id")
    found, block, words = None, [], 0

    def counting(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, number, starts, members = sent.value
            sizes = np.diff(starts)
            for whole in batches:
                for low in range(0, whole.num_rows, COUNTED):
                    batch = whole.slice(low, COUNTED)
                    lists = [[number[w] for w in {*t.lower().encode().split()} if w in number] if t else [] for t in batch.column(1).to_pylist()]
                    many = np.array([len(x) for x in lists], np.int64)
                    terms = np.fromiter((i for x in lists for i in x), np.int64, int(many.sum()))
                    n = sizes[terms]
                    ends = np.cumsum(n)
                    query = members[np.repeat(starts[terms] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                    row = np.repeat(np.repeat(np.arange(batch.num_rows), many), n)
                    score = np.bincount(row * len(ids) + query, minlength=batch.num_rows * len(ids)).reshape(-1, len(ids))
                    order = np.array(pa.compute.rank(batch.column(0), "ascending", null_placement="at_start"))
                    best = [r[np.lexsort((order[r], -score[r, q]))[:limit]] for q, r in ((q, np.flatnonzero(score[:, q])) for q in np.flatnonzero(score.any(axis=0)).tolist())]
                    asked_by = np.flatnonzero(score.any(axis=0))
                    rows_ = np.concatenate([*best, np.zeros(0, np.int64)])
                    of = np.repeat(asked_by, [len(b) for b in best])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_kind).take(pa.array(of)), batch.column(0).take(pa.array(rows_)), pa.array(score[rows_, of], pa.int64())], names=["query_id", key, "score"])

        return run

    def flush():
        nonlocal found, block, words
        by_term: dict[bytes, list[int]] = {}
        for q, (_, terms) in enumerate(block):
            for t in terms:
                if t is not None:
                    by_term.setdefault(t.encode(), []).append(q)
        members = np.array([q for x in by_term.values() for q in x], np.int64)
        starts = np.append(0, np.cumsum([len(x) for x in by_term.values()])).astype(np.int64)
        sent = spark.sparkContext.broadcast(([q for q, _ in block], dict(zip(by_term, range(len(by_term)), strict=True)), starts, members))
        part = rows.select(key, "text").mapInArrow(counting(sent), f"query_id {kind}, {key} {key_kind}, score long")
        found = part if found is None else found.union(part)
        block, words = [], 0

    for row in asked.toLocalIterator():
        block.append((row[0], row[1] or []))
        words += len(block[-1][1])
        if len(block) == QUERY_BLOCK or words > TERM_BLOCK:
            flush()
    if block:
        flush()
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, {key} {key_kind}, score long, rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
