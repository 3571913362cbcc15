"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its subwords, and a document the weighted mean of its distinct
words. A few words make a document toxic, and an even mean would drown them, so a word weighs exp(FOCUS * z),
where z is its own log-odds by the same softmax: what the model takes for toxic counts most. The
document's score is the softmax of that mean, its bias moved so that 0.5 lies where the classes part best on
sampled documents that took no part in training.

Embeddings and softmax are trained jointly, on all words of the sampled documents, in two rounds: the first takes
the words of toxic documents for toxic, the second only the telling ones among them. Unseen
misspellings share the n-gram vectors of the words that they distort.

Learns from about `per_class` labelled documents of either class, none of more than `LONGEST` bytes. Texts
without words, null or empty ones among them, score 0. Null labels teach nothing; of repeated
label rows the greatest label counts. If fewer than two classes are labelled, every
score is 0. A text of any length is read whole, in one task. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import only, tidy
from folio.llm.language import LONGEST, draw, held_out
from folio.llm.subwords import Model, WordRows, features, kept_rows, sums, word_scores

#: Documents of each class that the model may learn from.
PER_CLASS = 2_000
#: How much more a word weighs the more toxic it is.
FOCUS = 0.4
#: Passes over the words in each round, and words of a step.
EPOCHS, BATCH = 2, 512
#: Weight of the telling words against all words of clean documents, and the quantile of the latter that a telling word exceeds.
TELLING, USUAL = 0.08, 0.98
#: Characters that are scored together.
CHARS = 2_000_000
#: What is stripped from the ends of a word.
EDGE = "%*&$#!?.,;:|\"'()[]{}<>-_=+~`/\\"


#: Characters beyond which a word is also read in pieces, characters of a piece, and from one piece to the next.
LONG, PIECE, STEP = 38, 18, 6


def words_of(text: str | None) -> list[str]:
    """The distinct words, lower-cased and without marks at their ends.

    Joined text is a word like any other, but its mean would drown what a part of it says: long words are followed by their overlapping pieces.
    """
    words = list(dict.fromkeys([w.strip(EDGE) or w for w in dict.fromkeys((text or "").lower().split())]))
    if max(map(len, words), default=0) <= LONG:
        return words
    out = []
    for w in words:
        out.append(w)
        if len(w) > LONG:
            out += [w[i : i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP)]
    return list(dict.fromkeys(out))


class Detector:
    """The model, folded to the log-odds of each bucket, and the log-odds that count as 0.5."""

    def __init__(self, model: Model, middle: float = 0.0):
        self.model, self.middle = model, middle
        folded = model.folded()
        self.folded, self.bias = (folded[:, 1] - folded[:, 0])[:, None], float(model.b[1] - model.b[0])
        self.name = uuid.uuid4().hex

    def __getstate__(self) -> dict:
        """The executors need the folded form only."""
        return self.__dict__ | {"model": None}

    def rows(self) -> WordRows:
        return kept_rows(self.name, lambda: WordRows(2, word_scores(self.folded), np.float64))

    def log_odds(self, table: np.ndarray) -> np.ndarray:
        """Log-odds of words, from their rows."""
        return table[:, 0] / table[:, 1] + self.bias

    def evidence(self, lists: list[list[str]]) -> np.ndarray:
        """Log-odds of documents, from their words: those of the weighted mean; the least there is without words."""
        table, counts = self.rows().look_up(lists)
        z = self.log_odds(table)
        weight = np.exp(np.clip(FOCUS * z, -50, 50))
        total = sums(weight, counts)
        return np.where(counts > 0, sums(weight * z, counts) / np.where(total > 0, total, 1), -np.inf)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """The softmax with the moved bias."""
        return 1 / (1 + np.exp(-np.clip(evidence - self.middle, -700, 700)))


def train(texts: list[str], labels: list[int]) -> Detector:
    """Learns from texts labelled 0 or 1."""
    lists = [words_of(t) for t in texts]
    y = np.array(labels, np.int64)
    aside = np.arange(len(texts)) % 5 == 0 if len(texts) >= 100 else np.zeros(len(texts), bool)
    taught = [i for i, w in enumerate(lists) if w and not aside[i]]
    number: dict[str, int] = {}
    words = {i: np.array([number.setdefault(w, len(number)) for w in lists[i]], np.int32) for i in taught}
    bags = [np.array(features(w), np.int32) for w in number]

    def fitted(clean: list[np.ndarray], toxic: list[np.ndarray], weights: list[np.ndarray], even: float) -> Detector:
        """From words of clean and of toxic documents, these with weights that together come to `even` times the others."""
        none, no_weight = np.zeros(0, np.int32), np.zeros(0)
        one, two, weight = np.concatenate([none, *clean]), np.concatenate([none, *toxic]), np.concatenate([no_weight, *weights])
        weight = np.concatenate((np.ones(len(one)), weight * even * max(1, len(one)) / max(1e-9, weight.sum())))
        target = np.zeros((len(weight), 2), np.float32)
        target[: len(one), 0] = target[len(one) :, 1] = 1
        return Detector(Model(2).fit([bags[k] for k in np.concatenate((one, two)).tolist()], target, weight / weight.mean(), epochs=EPOCHS, batch=BATCH))

    clean, toxic = [words[i] for i in taught if not y[i]], [words[i] for i in taught if y[i]]
    d = fitted(clean, toxic, [np.ones(len(w)) for w in toxic], 1.0)
    z = d.log_odds(d.rows().look_up([list(number)])[0])
    usual = np.quantile(z[np.concatenate(clean)], USUAL) if clean else -np.inf
    telling = [w[z[w] >= max(usual, (z[w].max() + np.median(z[w])) / 2)] for w in toxic]
    if any(map(len, telling)):
        d = fitted(clean, telling, [np.full(len(w), 1 / max(1, len(w))) for w in telling], TELLING)
    judged = np.flatnonzero(aside) if aside.any() and len(set(y[aside].tolist())) > 1 else np.arange(len(texts))
    found = d.evidence([lists[i] for i in judged.tolist()])
    d.middle = limit_between(np.where(np.isfinite(found), found, -700.0), y[judged])
    return d


def limit_between(z: np.ndarray, y: np.ndarray) -> float:
    """The value that splits the classes best by F1, midway between its neighbours."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 5, remainder: int = 0, text: str = "text") -> list[tuple[str, int]]:
    """A bounded sample of (text, label) of the documents that are not held out, in order of their ids."""
    clean = only(labels, "doc_id", label).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, remainder))
    chosen = draw(clean.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id", "y", per_class, 2 * per_class)
    # at most 4 * per_class rows of two numbers
    short = only(docs, "doc_id", text).where(F.coalesce(F.octet_length(text), F.lit(0)) <= LONGEST)
    got = short.join(F.broadcast(chosen), "doc_id").select("doc_id", text, "y").orderBy(F.xxhash64(F.lit("sample"), "doc_id")).limit(4 * per_class).collect()
    return [(r[1] or "", int(r[2])) for r in sorted(got, key=lambda r: (r[0], r[1] or ""))]


def score(docs: DataFrame, model: Detector | None, limit: float = 0.5, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with score and predicted."""
    from pyspark.sql import types as T

    wanted = only(docs, *dict.fromkeys([*keep, text]))
    schema = T.StructType([*[wanted.schema[k] for k in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            column = batch.column(text)
            scores = np.zeros(len(column))
            lo = 0
            while m and lo < len(column):
                hi, chars, lists = lo, 0, []
                while hi < len(column) and (hi == lo or chars < CHARS):
                    t = column[hi].as_py()
                    chars += len(t or "")
                    lists.append(words_of(t))
                    hi += 1
                scores[lo:hi] = m.probability(m.evidence(lists))
                lo = hi
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(scores), pa.array((scores >= limit).astype(np.int32))], names=[*keep, "score", "predicted"])

    return wanted.mapInArrow(tidy(run, "word rows"), schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Detector | None:
    rows = labelled(docs, labels, "toxic", per_class)
    return train([t for t, _ in rows], [y for _, y in rows]) if len({y for _, y in rows}) == 2 else None


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
