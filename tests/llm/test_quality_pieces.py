import random

import numpy as np

from folio.llm import quality
from tests.llm.test_classifiers import text
from tests.llm.test_long_words import joined


def test_quality_behind_the_beginning():
    rng = random.Random(5)
    head = "".join(text(rng, "en", 60).split())[:64]
    texts = [head + ("".join(f"{w}%%%" for w in text(rng, "en").split()) if k % 2 else joined(rng, "en")) for k in range(200)]
    s = quality.train(texts[:150], [1 - k % 2 for k in range(150)])
    votes = s.votes(s.project(s.rows(), [quality.words_of(t) for t in texts[150:]]))
    assert ((votes >= 0.5) == (np.arange(150, 200) % 2 == 0)).all()
    assert quality.words_of("a b " + "c" * 130) == ["a", "b", "c" * 64, "c" * 64, "cc"]
