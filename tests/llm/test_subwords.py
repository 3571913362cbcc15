"""Features of many words at once against those of each."""

import random
import time

import numpy as np

from folio.llm import subwords


def test_features_of_many_words():
    rng = random.Random(3)
    letters = "abcxyz%\x00\x7f\x80\u00e9\u07ff\u0800\u4e2d\uffff\U00010000\U0001f600\ud800\udfff"
    words = ["", "a", "ab", "\ud83d", "\U0010ffff", "caf\u00e9s", "plain", *("".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(2000))]
    flat, counts = subwords.features_of(words)
    assert counts.tolist() == [len(subwords.features(w)) for w in words]
    assert flat.tolist() == [k for w in words for k in subwords.features(w)]
    assert [len(x) for x in subwords.features_of([])] == [0, 0]


def test_scoring_costs_less_than_gathering_features():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    compute = subwords.word_scores(np.ones((subwords.BUCKETS, 1), np.float32))
    began = time.process_time()
    rows = compute(words)
    took, began = time.process_time() - began, time.process_time()
    assert rows[:, 0].tolist() == [len(subwords.features(w)) for w in words]
    assert took < 0.6 * (time.process_time() - began)
