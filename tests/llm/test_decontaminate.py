import random

import numpy as np

from folio.llm import decontaminate as d


def rows(seed=5):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "c3", "été", "d"]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 9, 10, 14])))) for i in range(30)] + [("x", None), ("7", "a b c3")]
    texts = []
    for i in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            t[4:4] = (rng.choice(items)[1] or "").split()
        texts.append(rng.choice([" ", "\n", ", "]).join(t).upper() if i % 5 == 0 else " ".join(t))
    return [*texts, None, "", texts[0]], items


def test_against_plain_search(spark, monkeypatch):
    texts, items = rows()
    docs = spark.createDataFrame([(i, t, "spans") for i, t in enumerate(texts)], "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = d.contaminated_brute(texts, items)
    for block, shard, sent in ((d.BLOCK_WORDS, d.SHARD_BYTES, d.SENT_BYTES), (40, 300, 0)):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        monkeypatch.setattr(d, "SHARD_BYTES", shard)
        monkeypatch.setattr(d, "SENT_BYTES", sent)
        monkeypatch.setattr(d, "SENT_HITS", sent)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in d.contamination(docs, bench).collect()}
        assert [got[i] for i in range(len(texts))] == want


def nearby(spark, texts, items, width, slack):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = d.find_occurrences(docs, bench, width, slack).collect()
    return [bool(r.spans) for r in sorted(found, key=lambda r: r.kept.doc_id)]


def test_nearby_words(spark):
    items = [("i", "one two three four")]
    assert nearby(spark, ["one two x three four", "one two three four", "four three x x x two one"], items, 4, 1) == [True, True, False]
    assert nearby(spark, ["one two x three four", "one two three four"], items, 4, 0) == [False, True]
    # no match reaches from one document into the next
    assert nearby(spark, ["one two", "three four"], items, 4, 1) == [False, False]


def test_an_index_answers_several_test_sets(spark):
    texts, items = rows(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = d.build_index(docs)
    for some in (items[:10], items[10:]):
        bench = spark.createDataFrame(some, "item_id string, text string")
        got = {r.kept.doc_id: list(r["items"]) for r in d.with_hits(index, d.search(index, bench)).collect()}
        brute = d.contaminated_brute(texts, some)
        assert [len(got[i]) for i in range(len(texts))] == [b[2] for b in brute]


def test_lists_of_a_shard():
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "bb", "été", "x" * 9, "y" * 300, "z" * 17, "q" * 8, "q" * 16])
    texts = [None, b"", *[" ".join(word() for _ in range(rng.randint(0, 400))).encode() for _ in range(20)], b""]
    counts, terms, n, places = d.lists_of(texts)
    words = [(t or b"").split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len(terms) == len(set(flat)) + 1 and n.tolist()[0] == len(texts)
    for t, k, p in zip(terms.to_pylist(), n.tolist(), places.to_pylist(), strict=True):
        at = np.cumsum(d.unpacked(p)).tolist()
        assert len(at) == k
        assert at == ([i for i, x in enumerate(flat) if x == t] if t else (np.cumsum(counts) - counts).tolist())
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**35 + 5])
    assert d.unpacked(d.packed(values)[0].tobytes()).tolist() == values.tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id string, text string")
    assert d.contamination(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.contamination(one, bench).first().n_hit == 0
    some = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert d.contamination(docs, some).count() == 0
    assert d.contamination(one, some).first().n_hit == 2
