"""The kept-up index against one that is built anew, and its searches against scoring every document."""

import random

import pytest
from pyspark.sql import functions as F

from folio.indexes import texts
from folio.operators.lexical import STOP_WORDS, WORD, Stemmer


def said(seed, n, vocabulary=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("run", "walk", "price", "the", "bank", "rat") for b in ("", "s", "ing", "ed", "er")] + [f"w{k}" for k in range(vocabulary)]
    return [(i, None if i % 41 == 40 else " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.choice([0, 1, 8, 60])))) for i in range(n)]


def every_entry(rows, stemmed=True):
    stem = Stemmer() if stemmed else texts.plain
    out = {}
    for i, t in rows:
        for p, w in enumerate(WORD.findall((t or "").lower()), 1):
            if w not in STOP_WORDS:
                out.setdefault((i, stem(w)), []).append(p)
    return out


def ranked(rows, questions, limit, stemmed=True):
    entries = {}
    for (i, t), p in every_entry(rows, stemmed).items():
        entries.setdefault(i, {})[t] = p
    out = set()
    for q, text in questions:
        p = texts.needs(text or "", stemmed)
        hits = sorted((-round(s, 9), i) for i, at in entries.items() if p and (s := texts.score(p, at)) > 0)
        out |= {(q, i, r) for r, (_, i) in enumerate(hits[:limit], 1)}
    return out


QUESTIONS = [(1, "running"), (2, "run bank"), (3, '"w1 w2" or price'), (4, "w0 w1 -walks"), (5, "the of"), (6, None), (7, "prices walk rats"), (8, "nowhere"), (9, "run or walk bank or price"), (10, '"run w0"'), (11, "w0"), (12, "w0 w0 w1")]


def found(index, questions, limit, spark):
    got = index.search(spark.createDataFrame(questions, "query_id int, query_text string"), limit)
    return {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()}


def kept_entries(index):
    return {(r.key, r.lexeme): r.positions for r in index.entries().collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)


@pytest.mark.parametrize(("docs", "first"), [(1024, 4), (16, 1)])
def test_changes_equal_a_new_index(spark, tmp_path, monkeypatch, docs, first):
    monkeypatch.setattr(texts, "DOCS", docs)
    monkeypatch.setattr(texts, "FIRST", first)
    rows = dict(said(1, 260))
    index = texts.created(frame(spark, list(rows.items())), f"{tmp_path}/index")
    assert found(index, QUESTIONS, 5, spark) == ranked(rows.items(), QUESTIONS, 5)
    change = {i: t for i, t in said(2, 300) if i % 7 == 0}
    rows |= change
    index.put(frame(spark, list(change.items())))
    out = [i for i in rows if i % 11 == 3]
    index.remove(spark.createDataFrame([(i,) for i in out] + [(9999,)], "chunk_id long"))
    rows = {i: t for i, t in rows.items() if i not in out}
    back = {3: "running banks", 14: "w0 w1"}
    rows |= back
    index.put(frame(spark, list(back.items())))
    again = texts.opened(spark, f"{tmp_path}/index")
    assert len(again.segments()) == 4 and kept_entries(again) == every_entry(rows.items())
    assert found(again, QUESTIONS, 5, spark) == ranked(rows.items(), QUESTIONS, 5)
    again.merge()
    again.vacuum()
    assert len(again.segments()) == 1 and kept_entries(again) == every_entry(rows.items())
    assert sorted(r.key for r in again.documents().collect()) == sorted(rows)
    assert found(again, QUESTIONS, 300, spark) == ranked(rows.items(), QUESTIONS, 300)


def test_a_failed_change_is_not_seen(spark, tmp_path):
    rows = said(3, 40)
    index = texts.created(frame(spark, rows), f"{tmp_path}/index", stemmed=False)
    with pytest.raises(Exception, match="lost"):
        index.put(frame(spark, [(1, "a"), (99, "b")]).withColumn("text", F.raise_error(F.lit("lost"))))
    index = texts.opened(spark, f"{tmp_path}/index")
    assert kept_entries(index) == every_entry(rows, False) and index.segments() == [0]
    index.put(frame(spark, [(1, "kept")]))
    assert index.segments() == [0, 2] and kept_entries(index)[1, "kept"] == [1]


def test_hot_words_are_cut_and_searches_skip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "DOCS", 10)
    monkeypatch.setattr(texts, "FIRST", 2)
    rows = [(i, "hot " * (1 + (i % 100 == 0) * 8) + "rare " * (i % 50 == 0)) for i in range(600)]
    index = texts.created(frame(spark, rows), f"{tmp_path}/index")
    assert index.postings.where("lexeme = 'hot'").count() > 40
    asked = index.asked(spark.createDataFrame([(1, "hot rare")], "query_id int, query_text string"))
    assert index.bounds(asked).count() <= 12
    plan = index.of_lexemes(asked).where(F.col("lexeme") == "hot")._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(lexeme,hot)" in plan
    assert found(index, [(1, "hot rare"), (2, "hot")], 3, spark) == ranked(rows, [(1, "hot rare"), (2, "hot")], 3)
    empty = texts.created(frame(spark, rows).limit(0), f"{tmp_path}/none")
    assert found(empty, QUESTIONS, 3, spark) == set()


def test_ranges_are_unpacked_at_once(monkeypatch):
    """What a range holds is read by whole columns, not lexeme by lexeme, and is what its texts say."""
    import numpy as np
    import pyarrow as pa

    def said(k):
        return [] if k == 7 else [f"w{(k * j) % 13}" for j in range(k % 9)]

    monkeypatch.setattr(texts, "unpacked", lambda *a: pytest.fail("one lexeme at a time"))
    batches = [texts.gathered(pa.array(range(a, a + 20)), [" ".join(said(k)) for k in range(a, a + 20)], n, texts.plain) for n, a in ((5, 0), (3, 100))]
    gone = pa.table({"range": pa.array([5, 3, 5], pa.int64()), "ord": pa.array([2, 19, 8], pa.int32())})
    keys, words, lexemes, code, ords, places = texts.alive(pa.Table.from_batches(batches), gone)
    living = [k for k in [*range(100, 120), *range(20)] if k not in (2, 119, 8)]
    assert keys.to_pylist() == living and words.tolist() == [len(said(k)) for k in living]
    got = sorted((o, p, lexemes[c]) for c, o, p in zip(code.tolist(), ords.tolist(), places.tolist(), strict=True))
    assert got == [(i, p + 1, w) for i, k in enumerate(living) for p, w in enumerate(said(k))]
    assert np.array_equal(np.lexsort((places, ords, code)), np.arange(len(code)))
