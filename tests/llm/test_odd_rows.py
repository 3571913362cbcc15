"""Nulls in every column, repeated rows, long texts and clashing names, through every operator."""

import pytest

from folio.llm import decontaminate, html_extract, language, packing, quality, simhash, suffix_dedup, toxicity, vectors, warc

CLASHES = ["score", "predicted", "rejected", "lang_pred", "n_words", "spans", "items", "fp", "node", "root", "bin", "fill", "d1", "d2", "runs", "kept", "component_id", "label2", "body", "usable", "block"]


def wide(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"'x' as {c}" for c in CLASHES])


@pytest.fixture(scope="module")
def docs(spark):
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (None, "a b c d e f", None), (2, None, None), (None, None, None), (3, "", ""), (4, long, "en"), (5, long + "x", None)]
    return wide(spark, rows, "doc_id long, text string, lang string")


def by_id(df, *columns):
    return sorted((str(r.doc_id), *[r[c] for c in columns]) for r in df.collect())


def test_simhash(docs):
    got = by_id(simhash.near_duplicates(docs), "component_id")
    assert got == [("1", 1), ("1", 1), ("2", 2), ("3", 2), ("4", 4), ("5", 4), ("None", 1), ("None", 2)]


def test_packing(docs):
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {str(r.doc_id) for r in out} == {"1", "2", "3", "4", "5", "None"}
    assert sum(r.piece == 0 for r in out) == 8 and max(r.piece for r in out) > 20


def test_decontaminate(spark, docs):
    bench = wide(spark, [(None, "b c d"), (7, None), (8, "c d"), (8, "c d")], "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench), "n_hit", "n_items", "contaminated")
    assert got == [("1", 3, 1, True), ("1", 3, 1, True), ("2", 0, 0, False), ("3", 0, 0, False), ("4", 0, 0, False), ("5", 0, 0, False), ("None", 0, 0, False), ("None", 3, 1, True)]


def test_suffix_dedup(docs):
    got = by_id(suffix_dedup.removals(docs), "n_bytes", "n_removed", "n_spans")
    assert got == [("1", 11, 0, 0), ("1", 11, 0, 0), ("2", 0, 0, 0), ("3", 0, 0, 0), ("4", 360000, 360000, 1), ("5", 360001, 360000, 1), ("None", 0, 0, 0), ("None", 11, 0, 0)]


def test_classifiers(spark, docs):
    labels = wide(spark, [(1, 1, 0), (None, 0, 1), (4, 0, 1), (4, None, None), (5, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for got in (language.predictions(docs), toxicity.predictions(docs, labels), quality.predictions(docs, labels)):
        rows = got.collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


def test_pages(spark):
    pages = wide(spark, [(None, None, None), (None, "http://h/x", "<article>a"), (1, None, "<p>b"), (1, None, "<p>b")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text) for r in html_extract.main_texts(pages).collect()) == [("1", "b"), ("1", "b"), ("None", ""), ("None", "a")]
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type) for r in warc.round_trip(pages).collect()) == [("1", 4, "response"), ("1", 4, "response"), ("None", 0, "response"), ("None", 10, "response")]


def test_vectors(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], None)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(wide(spark, rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 0, 2, True), ("3", 2, 1, False), ("4", 0, 4, True), ("None", 0, None, True)]
