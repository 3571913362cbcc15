"""Language identification against mean embeddings and a softmax, computed a text at a time."""

import numpy as np

from folio.llm import language
from folio.llm.subwords import Model, features
from tests.llm.test_classifiers import corpus


def test_against_unfolded_embeddings(spark, monkeypatch):
    made = []

    class Kept(Model):
        def fit(self, *args, **rest):
            made.append(self)
            return super().fit(*args, **rest)

    monkeypatch.setattr(language, "Model", Kept)
    docs, _ = corpus(160, 5)
    classifier = language.train([t for _, t, _ in docs[:120]], [lang for _, _, lang in docs[:120]])
    (model,) = made
    texts = [(i, t) for i, t, _ in docs[120:]] + [(900, None), (901, "..."), (902, "é"), (903, "wort " * 500), (904, "中文 the")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), classifier).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        ids = [k for w in language.words_of(t) for k in features(w)]
        if not ids:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        z = (model.e[np.array(ids)].astype(np.float64).mean(axis=0) @ model.w + model.b) / classifier.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert abs(p.max() - got[i].score) < 1e-4 and got[i].rejected == (got[i].score < classifier.limit)
        assert got[i].lang_pred == classifier.languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4
