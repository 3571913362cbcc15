import random
import zlib

import numpy as np
import pytest

from folio.llm import language, quality, toxicity
from folio.llm.subwords import WordRows, features, sums

SYLLABLES = {"en": ["the", "ing", "wh", "ou"], "fr": ["éau", "que", "oi", "ê"], "de": ["sch", "ü", "ung", "zu"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        t = text(rng, lang, rng.randint(5, 60))
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        if toxic:
            words = t.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["garbage", "garbages", "garbagee", "moronic", "moronical"]))
            t = " ".join(words)
        if not good:
            t = " ".join(f"{w}%%%" for w in t.split())
        docs.append((i, t, lang))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    odd = [(1000, None, None), (1001, "", "en"), (1002, "123 !!", None), (1003, "x" * 300_000, None), (1004, docs[0][1], None), (1004, docs[0][1], None)]
    d = spark.createDataFrame([(*r, 5) for r in docs + odd], "doc_id long, text string, lang string, score int")
    lab = spark.createDataFrame([(*r, "y") for r in [*labels, (2000, 1, 1), (None, 1, 0), (3, None, None)]], "doc_id long, quality int, toxic int, y string")
    return d, lab, docs, labels


def test_language(spark, tables):
    d, _, docs, _ = tables
    got = {r.doc_id: r for r in language.predictions(d).collect()}
    assert len(got) == len(docs) + 5
    out = [r for r in docs if crc(r[0], 4) == 2]
    assert all(got[i].held_out == (crc(i, 4) == 2) for i, _, _ in docs)
    assert sum(got[i].lang_pred == lang for i, _, lang in out) >= 0.97 * len(out)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].rejected
    assert got[1003].lang_pred in SYLLABLES and all(0 <= r.score <= 1 for r in got.values())


def test_numerals_are_no_letters_and_marks_part_no_words(spark):
    rows = [(1, "\u00b2 \u00bd \u2460 \u2167 \u0663 _ 7"), (2, "\u0939\u093f\u0928\u094d\u0926\u0940 \u0301x \u2167"), (3, "ab\u00b2cd")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), language.train(["ab cd", "\u0939\u093f"], ["en", "hi"])).collect()}
    assert (got[1].lang_pred, got[1].score, got[1].rejected) == ("und", 0.0, True) and got[2].lang_pred != "und"
    assert language.words_of(rows[1][1]) == ["\u0939\u093f\u0928\u094d\u0926\u0940", "x"] and language.words_of(rows[2][1]) == ["ab", "cd"]
    assert language.words_of("\u00aa\u00ba\u00b5 \u00d7 \u00c4\u00df") == ["\u00aa\u00ba\u00b5", "\u00e4\u00df"]


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 5, f"l{i % 260}") for i in range(1040)]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m.languages) == len({lang for i, _, lang in rows if crc(i, 4) != 2}) > 200


def test_equally_likely_languages_fall_to_the_first_name(spark):
    rows = [(i, "same words in both", lang) for i, lang in enumerate(["zz", "aa"] * 8)]
    m = language.train([r[1] for r in rows], [r[2] for r in rows])
    m.folded[:], m.bias[:] = 0, 0
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), m).collect()} == {"aa"}


def test_held_out_rows_teach_nothing(spark, tables):
    d, _, docs, _ = tables
    from pyspark.sql import functions as F

    changed = d.withColumn("lang", F.when(language.held_out(F.col("doc_id"), 4, 2), "zz").otherwise(F.col("lang")))
    assert "zz" not in language.fit(changed).languages


def test_toxicity(spark, tables):
    d, lab, docs, labels = tables
    rows = toxicity.predictions(d, lab).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) + 6
    held = [(i, y) for i, _, y in labels if crc(i, 5) == 0]
    assert all(got[i].held_out == (crc(i, 5) == 0) for i, _, _ in labels)
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert got[1000].predicted == 0 and got[1001].score == got[1000].score


def test_misspelling(tables):
    _, _, docs, labels = tables
    m = toxicity.train([t for _, t, _ in docs], [y for _, _, y in labels])
    base = "the ing whou the ouing " * 4
    said = [base, base + "garbagge moronicc garbagez", base + "garbagge moronicc garbagez " * 3]
    low, high, again = m.evidence([toxicity.words_of(t) for t in said])
    assert high > low and abs(again - high) < 1e-9  # a word counts once
    assert m.probability(high) >= 0.5 > m.probability(low)


def test_toxicity_is_the_softmax_of_the_mean_embedding():
    docs, labels = corpus()
    m = toxicity.train([t for _, t, _ in docs], [y for _, _, y in labels])
    e, w, b = m.model.e.astype(float), m.model.w.astype(float), m.model.b.astype(float)
    for _, t, _ in docs[:40]:
        word = np.array([e[features(x)].mean(0) for x in dict.fromkeys(x.strip(toxicity.EDGE) or x for x in t.lower().split())])
        z = word @ (w[:, 1] - w[:, 0]) + b[1] - b[0]
        weight = np.exp(toxicity.FOCUS * z)
        logits = (weight[:, None] * word).sum(0) / weight.sum() @ w + b - [0, m.middle]
        p = np.exp(logits - logits.max())
        assert abs(p[1] / p.sum() - m.probability(m.evidence([toxicity.words_of(t)]))[0]) < 1e-4


def test_quality(spark, tables):
    d, lab, docs, labels = tables
    got = {r.doc_id: r for r in quality.predictions(d, lab).collect()}
    held = [(i, y) for i, y, _ in labels if crc(i, 5) == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score


def test_texts_without_words_are_near_the_shortest():
    rng = random.Random(2)
    short = ["!!", "a", "ab cd", "x y", "b"] * 8
    long = [text(rng, "en", 60) for _ in range(60)]
    s = quality.train(short + long, [0] * len(short) + [1] * len(long), {0: 1.0, 1: 9.0})
    got = s.votes(s.project(s.rows(), [[], quality.words_of("c d"), quality.words_of(text(rng, "en", 70))]))
    assert got[0] < quality.LIMIT and got[1] < quality.LIMIT and got[2] > 0.9


def test_votes_restore_what_the_sample_balanced():
    v = np.eye(2, dtype=np.float32)[[0, 0, 0, 0]]
    s = quality.Space(np.ones(quality.TERMS), np.ones((quality.TERMS, 2)), v, np.array([0.0, 0, 1, 1]), np.array([1.0, 1, 9, 9]))
    assert abs(s.votes(v[:1])[0] - 0.9) < 1e-9 and abs(s.votes(-v[:1])[0] - 0.9) < 1e-9


def test_equally_near_neighbours_are_the_first(monkeypatch):
    monkeypatch.setattr(quality, "NEIGHBOURS", 3)
    v = np.ones((40, 1), np.float32)
    s = quality.Space(np.ones(quality.TERMS), np.ones((quality.TERMS, 1)), v, np.array([1.0] * 3 + [0.0] * 37), np.ones(40))
    assert s.votes(v[:2]).tolist() == [1, 1]


def test_votes_are_those_of_all_neighbours():
    docs, labels = corpus(120, 3)
    s = quality.train([t for _, t, _ in docs], [y for _, y, _ in labels])
    v = s.project(s.rows(), [t.split() for _, t, _ in docs])
    cosine = v.astype(float) @ s.vectors.T.astype(float)
    for i in range(20):
        near = np.argsort(-cosine[i])[: quality.NEIGHBOURS]
        w = np.maximum(cosine[i, near], 0) ** quality.POWER
        assert abs(s.votes(v[i : i + 1])[0] - (w * s.labels[near]).sum() / w.sum()) < 0.02


@pytest.mark.parametrize("labelled", [True, False])
def test_empty(spark, labelled):
    d = spark.createDataFrame([] if labelled else [(1, "a", None)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (language.predictions(d), toxicity.predictions(d, lab), quality.predictions(d, lab)):
        assert out.count() == (0 if labelled else 1)


def test_word_rows():
    rows = WordRows(1, lambda words: np.array([[len(w)] for w in words]))
    for _ in range(2):
        values, counts = rows.look_up([["a", "bb"], [], ["ccc", "a"]])
        assert sums(values, counts).ravel().tolist() == [3, 0, 4]
    assert len(features("word")) == 1 + 4 + 3 + 2 + 1
