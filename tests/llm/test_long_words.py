import random

import numpy as np

from folio.llm import language, subwords, toxicity
from tests.llm.test_classifiers import SYLLABLES, corpus, text


def joined(rng, lang, n=40):
    return "".join(text(rng, lang, n).split())


def test_all_grams_of_a_long_word():
    for n in (37, 38, 39, 100, 5000):
        assert len(subwords.features("ab" * n)) == 1 + sum(2 * n + 2 - k + 1 for k in (3, 4, 5, 6))
        assert subwords.features("ab" * n) == list(subwords.grams("ab" * n))
    assert subwords.features("a" * 60 + "bcd") != subwords.features("a" * 60 + "bce")


def test_scores_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    folded = rng.normal(size=(subwords.BUCKETS, 3)).astype(np.float32)
    words = ["a", "b" * 900, "cde", "xyz" * 30, "é" * 50, "last"]
    want = subwords.word_scores(folded)(words)
    monkeypatch.setattr(subwords, "BLOCK", 300)
    got = subwords.word_scores(folded)(words)
    assert got.shape == want.shape and np.allclose(got, want, rtol=1e-4, atol=1e-3)
    assert list(subwords.step_ends(np.array([100, 250, 10, 400, 1, 1, 1]), 4)) == [(0, 1), (1, 3), (3, 4), (4, 7)]


def test_language_behind_the_beginning():
    rng = random.Random(3)
    docs, _ = corpus()
    m = language.train([t for _, t, _ in docs], [lang for _, _, lang in docs])
    rows = m.rows()
    head = joined(rng, "de", 30)[:40]
    for lang in SYLLABLES:
        lists = [[head + joined(rng, lang, 60)] for _ in range(10)]
        p = m.probabilities(subwords.sums(*rows.look_up(lists)))
        assert [m.languages[k] for k in p.argmax(1)] == [lang] * 10


def test_toxic_word_in_joined_text():
    docs, labels = corpus()
    m = toxicity.train([t for _, t, _ in docs], [y for _, _, y in labels])
    rng = random.Random(4)
    clean = [joined(rng, "en", 60) for _ in range(10)]
    toxic = [t[:60] + "garbage" + t[60:90] + "moronic" + t[90:] for t in clean]
    low, high = m.evidence([toxicity.words_of(t) for t in clean]), m.evidence([toxicity.words_of(t) for t in toxic])
    assert (high > low).all() and high.min() > low.max()


def test_pieces_hold_every_character():
    for n in range(30, 120):
        w = "".join(chr(0x4E00 + k) for k in range(n))
        got = toxicity.words_of(w)
        assert got[0] == w and set("".join(got[1:] or got)) == set(w) and (n > toxicity.LONG) == (len(got) > 1)
