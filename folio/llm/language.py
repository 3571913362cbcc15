"""Language identification by averaged hashed subword embeddings.

The model learns every language from a bounded sample of documents that have one (about
`per_language` of each, fewer if there are very many languages, drawn by a hash of the id; none of more than
`LONGEST` bytes). Their whole texts are cut into spans of words, so that
short texts are at home in it. Scores are calibrated by a temperature fitted
on sampled documents that took no part in training; the rejection limit is the score
that all but `tail` of those exceed.

A word is a letter (Unicode category L) and the letters and marks that follow it: digits, numerals and
fractions are none. Texts that are null or hold no letter are `und` with score 0 and are rejected.
Of equally likely languages the first by name counts. Null languages teach nothing. Without any labelled document
every text is `und`. A text of any length is read whole, in one task. Repeated rows and extra columns do not
matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import only, tidy
from folio.llm.subwords import Model, WordRows, bag, kept_rows, sums, word_scores

#: Documents of each language that the model may learn from, of all languages together, and bytes of such a document.
PER_LANGUAGE, ALL_LANGUAGES, LONGEST = 500, 20_000, 1 << 20
#: Groups whose shares are sent to all tasks.
GROUPS = 10_000
#: Words of a training span.
SPAN = 24
#: Share of calibration documents that may fall below the rejection limit.
TAIL = 0.001
#: Characters that are scored together.
CHARS = 2_000_000

#: The words of lower-cased texts of Latin-1 characters.
LATIN = re.compile("[a-zªµºß-öø-ÿ]+")


@functools.cache
def any_script() -> re.Pattern[str]:
    """A letter and the letters and marks that follow it, in any script."""

    def others(kinds: str) -> str:
        """The ranges of characters of other categories."""
        out, at = "", 0
        for inside, run in groupby(range(sys.maxunicode + 1), key=lambda c: unicodedata.category(chr(c))[0] in kinds):
            end = at + sum(1 for _ in run)
            out += "" if inside else f"\\U{at:08x}-\\U{end - 1:08x}"
            at = end
        return out

    return re.compile(f"[^{others('L')}][^{others('LM')}]*")


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text."""
    text = (text or "").lower()
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return any_script().findall(text)
    return LATIN.findall(text)


def held_out(key: Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == remainder, F.lit(False))


def draw(rows: DataFrame, key: str, group: str, wanted: int, most: int) -> DataFrame:
    """About `wanted` rows of each group, fewer where that would make over `most`, by a hash of the key."""
    counts = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"))
    groups = counts.count()
    wanted = max(1, min(wanted, most // max(1, groups)))
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))
    chosen = rows.join(F.broadcast(counts) if groups <= GROUPS else counts, F.col(group) == F.col("_group"))
    chosen = chosen.where(place < F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(wanted) / F.col("_rows"))).drop("_group", "_rows")
    return chosen.orderBy(F.xxhash64(F.lit("sample"), key)).limit(2 * wanted * max(1, groups))


class Classifier:
    """What the executors need: languages, folded scores, bias, temperature and limit."""

    def __init__(self, languages: list[str], folded: np.ndarray, bias: np.ndarray, temperature: float, limit: float):
        self.languages, self.folded, self.bias, self.temperature, self.limit = languages, folded, bias, temperature, limit
        self.name = uuid.uuid4().hex

    def rows(self) -> WordRows:
        return kept_rows(self.name, lambda: WordRows(len(self.languages) + 1, word_scores(self.folded)))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """From the words' summed scores and, in the last column, feature counts."""
        z = (scores[:, :-1] / np.maximum(scores[:, -1:], 1) + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(texts: list[str], languages: list[str]) -> Classifier:
    """Learns from texts with languages."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], np.int64)
    words = [words_of(t) for t in texts]
    used = [i for i, w in enumerate(words) if w]
    cache: dict[str, np.ndarray] = {}
    bags, y, weights, calibration = [], [], [], []
    for nth, i in enumerate(used):
        if nth % 5 == 0 and len(used) >= 20:
            calibration.append(i)
            continue
        w = words[i]
        for k in range(0, len(w), SPAN):
            bags.append(bag(w[k : k + SPAN], cache))
            y.append(label[i])
            # a document counts alike however long it is
            weights.append(SPAN / len(w))
    cache.clear()
    weight = np.minimum(weights, 1.0)
    model = Model(len(names)).fit(bags, np.eye(len(names), dtype=np.float32)[y], weight / max(1e-9, weight.mean()) if bags else weight, epochs=3)
    out = Classifier(names, model.folded(), model.b, 1.0, 0.0)
    if calibration:
        rows = WordRows(len(names) + 1, word_scores(out.folded))
        values, counts = rows.look_up([words[i] for i in calibration])
        scores = sums(values, counts)
        loss = []
        options = np.geomspace(0.3, 4, 40)
        for t in options:
            out.temperature = float(t)
            p = out.probabilities(scores)
            loss.append(-np.log(np.maximum(p[np.arange(len(p)), label[calibration]], 1e-12)).mean())
        out.temperature = float(options[int(np.argmin(loss))])
        out.limit = float(min(0.5, np.quantile(out.probabilities(scores).max(1), TAIL)))
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, parts: int = 4, remainder: int = 2, text: str = "text", lang: str = "lang") -> Classifier | None:
    """The classifier learned from the documents that are not held out; None if none has a language."""
    rows = only(docs, "doc_id", text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, remainder))
    got = draw(rows.where(F.octet_length(text) <= LONGEST), "doc_id", lang, per_language, ALL_LANGUAGES).collect()
    got = sorted(got, key=lambda r: (r[0], r[1]))
    return train([r[1] for r in got], [r[2] for r in got]) if got else None


def identify(docs: DataFrame, model: Classifier | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected."""
    from pyspark.sql import types as T

    wanted = only(docs, *dict.fromkeys([*keep, text]))
    schema = T.StructType([*[wanted.schema[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        rows = m.rows() if m else None
        for batch in batches:
            column = batch.column(text)
            names, scores = [], []
            lo = 0
            while lo < len(column):
                hi, chars, lists = lo, 0, []
                while hi < len(column) and (hi == lo or chars < CHARS):
                    t = column[hi].as_py() or ""
                    chars += len(t)
                    lists.append(words_of(t))
                    hi += 1
                if m:
                    values, counts = rows.look_up(lists)
                    p = m.probabilities(sums(values, counts))
                    best = p.argmax(1)
                    names += [m.languages[b] if n else "und" for b, n in zip(best.tolist(), counts.tolist(), strict=True)]
                    scores += np.where(counts > 0, p[np.arange(len(p)), best], 0.0).tolist()
                else:
                    names += ["und"] * len(lists)
                    scores += [0.0] * len(lists)
                lo = hi
            limit = m.limit if m else 0.0
            rejected = [n == "und" or s < limit for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return wanted.mapInArrow(tidy(run, "word rows"), schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
