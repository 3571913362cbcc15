"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A document's terms are its words, the shapes of its words (runs of letters,
digits and each other character), how often a word repeats its predecessor, and for each power of two
above its number of words one that says so.
Terms are hashed; their inverse document frequencies and the singular vectors
of the weighted term matrix come from a bounded labelled sample. Each
document is projected, and exact blocked cosines to all labelled vectors choose
the neighbours, whose labels vote with the power of their similarity, and with how many labelled documents each
sampled one of its class stands for.

Learns from about `per_class` labelled documents of either class, none of more than `LONGEST` bytes. Null and empty
texts are documents of no words, of which their length is all that is known: they lie near the shortest ones.
A document without any similar one scores the labelled share of 1, whatever the sample's. Of neighbours that
are equally near the first by doc_id count. Null labels teach nothing;
of repeated label rows the greatest counts. Without labels every score is
0. A text of any length is read whole, in one task. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import only, tidy
from folio.llm.language import held_out
from folio.llm.subwords import WordRows, kept_rows
from folio.llm.toxicity import labelled

#: Labelled documents of each class, dimensions of the space, hashed terms.
PER_CLASS, DIM, TERMS = 1_500, 32, 4_096
#: Neighbours that vote, and the power of their similarity.
NEIGHBOURS, POWER = 15, 4
#: A score that counts as good.
LIMIT = 0.3
#: Characters that are scored together, and documents of a block of cosines.
CHARS, BLOCK = 2_000_000, 256
#: Weight of a shape against that of a word.
SHAPE = 3.0
#: Characters of a word that are one term.
PIECE = 64
#: The term of a word that repeats its predecessor, and those of documents of fewer words than a power of two.
AGAIN, SHORTER = 0, range(1, 33)

UPPER, LOWER, DIGIT, RUN = re.compile(r"[^\W\d_a-zß-öø-ÿ]"), re.compile(r"[a-zß-öø-ÿ]"), re.compile(r"\d"), re.compile(r"(.)\1+", re.S)


def term(text: str) -> int:
    return SHORTER.stop + zlib.crc32(text.encode("utf-8", "replace")) % (TERMS - SHORTER.stop)


def terms_of(word: str) -> list[tuple[int, float]]:
    """The terms of a word with their weights."""
    shape = RUN.sub(r"\1", DIGIT.sub("0", LOWER.sub("a", UPPER.sub("A", word))))
    return [(term("w" + word.lower()), 1.0), (term("s" + shape), SHAPE)]


def words_of(text: str) -> list[str]:
    """The words of a text; longer ones than PIECE characters as consecutive pieces, which all count."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def level(words: list[str]) -> int:
    """The least power of two that is above the number of words."""
    return min(len(words).bit_length(), len(SHORTER) - 1)


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, islice(words, 1, None)))


class Space:
    """Labelled vectors and what projects a document beside them; stand: labelled documents for each of them."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, stand: np.ndarray):
        self.weights, self.axes, self.vectors, self.labels, self.stand = weights, axes, vectors, labels, stand
        self.name = uuid.uuid4().hex

    def rows(self) -> WordRows:
        def compute(words: list[str]) -> np.ndarray:
            found = [terms_of(w) for w in words]
            out = np.zeros((len(words), self.axes.shape[1]), np.float32)
            for k in range(2):
                t = np.array([f[k][0] for f in found])
                x = np.array([f[k][1] for f in found], np.float32)
                out += self.axes[t] * (x * self.weights[t])[:, None]
            return out

        return kept_rows(self.name, lambda: WordRows(self.axes.shape[1], compute))

    def project(self, rows: WordRows, lists: list[list[str]]) -> np.ndarray:
        """Unit vectors of documents."""
        values, counts = rows.look_up(lists)
        above = self.axes[list(SHORTER)] * self.weights[list(SHORTER), None]
        out = np.cumsum(above[::-1], axis=0)[::-1][[level(w) for w in lists]].astype(np.float32).reshape(len(lists), -1)
        full = np.flatnonzero(counts)
        if len(full):
            out[full] += np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
        again = np.array([repeats(w) for w in lists], np.float32)
        out += again[:, None] * (SHAPE * self.weights[AGAIN] * self.axes[AGAIN])[None, :]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def votes(self, v: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled documents."""
        out = np.empty(len(v))
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(v), BLOCK):
            cosine = v[lo : lo + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(cosine, near, 1).min(1)
            tied = np.flatnonzero((cosine >= least[:, None]).sum(1) > k)
            near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER * self.stand[near]
            total = weight.sum(1)
            share = (weight * self.labels[near]).sum(1)
            out[lo : lo + BLOCK] = np.where(total > 0, share / np.where(total > 0, total, 1), np.average(self.labels, weights=self.stand))
        return np.clip(out, 0, 1)


def train(texts: list[str], labels: list[int], stand: dict[int, float] | None = None, dim: int = DIM, seed: int = 4) -> Space:
    """The space of labelled texts, by randomized subspace iteration (Halko et al., 2011); stand: labelled documents for each sampled one of a class."""
    m = np.zeros((len(texts), TERMS), np.float32)
    cache: dict[str, list[tuple[int, float]]] = {}
    for i, words in enumerate(map(words_of, texts)):
        for w in words:
            found = cache.get(w)
            if found is None:
                found = cache[w] = terms_of(w)
            for t, x in found:
                m[i, t] += x
        m[i, AGAIN] = SHAPE * repeats(words)
        m[i, SHORTER[level(words)] : SHORTER.stop] = 1
    cache.clear()
    idf = np.log((1 + len(texts)) / (1 + (m > 0).sum(0))).astype(np.float32) + 1
    m *= idf
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    dim = min(dim, *m.shape)
    q = np.linalg.qr(m.T @ rng.normal(size=(len(m), min(dim + 10, len(m)))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(m.T @ (m @ q))[0]
    axes = q @ np.linalg.svd(m @ q, full_matrices=False)[2][:dim].T
    space = Space(idf, np.ascontiguousarray(axes, np.float32), np.zeros((0, dim), np.float32), np.array(labels, np.float64), np.array([(stand or {}).get(y, 1.0) for y in labels]))
    space.vectors = np.concatenate([space.project(space.rows(), [words_of(t) for t in texts[lo : lo + BLOCK]]) for lo in range(0, len(texts), BLOCK)])
    return space


def score(docs: DataFrame, space: Space | None, limit: float = LIMIT, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with score and predicted."""
    from pyspark.sql import types as T

    wanted = only(docs, *dict.fromkeys([*keep, text]))
    schema = T.StructType([*[wanted.schema[k] for k in keep], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    # 2 * per_class vectors and the axes: some hundred kilobytes by the parameters
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        s = sent.value
        rows = s.rows() if s else None
        for batch in batches:
            column = batch.column(text)
            scores = np.zeros(len(column))
            lo = 0
            while s and lo < len(column):
                hi, chars, lists = lo, 0, []
                while hi < len(column) and (hi == lo or chars < CHARS):
                    t = column[hi].as_py() or ""
                    chars += len(t)
                    lists.append(words_of(t))
                    hi += 1
                scores[lo:hi] = s.votes(s.project(rows, lists))
                lo = hi
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(scores), pa.array((scores >= limit).astype(np.int32))], names=[*keep, "score", "predicted"])

    return wanted.mapInArrow(tidy(run, "word rows"), schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Space | None:
    rows = labelled(docs, labels, "quality", per_class)
    if not rows:
        return None
    # how many labelled documents the sampled ones of a class stand for
    known = only(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0))
    every = {r[0]: r[1] for r in known.groupBy("doc_id").agg(F.max("quality").alias("y")).groupBy("y").count().collect()}
    drawn = Counter(y for _, y in rows)
    return train([t for t, _ in rows], [y for _, y in rows], {y: every.get(y, n) / n for y, n in drawn.items()})


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
