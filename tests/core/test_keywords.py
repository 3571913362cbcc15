"""Keywords against texts in any case."""

from pyspark.sql import functions as F

from folio.functions.text import keyword_match
from folio.plans import dialogues


def test_keyword_match(spark):
    rows = [(["A", "\u00c9t\u00e9", "zz"], "a \u00c9T\u00c9"), ([], "x"), (None, "x"), (["a", None], "A"), (["a"], None)]
    got = spark.createDataFrame(rows, "k array<string>, t string").select(F.round(keyword_match(F.col("k"), F.col("t")), 4)).collect()
    assert [r[0] for r in got] == [0.6667, 1.0, 1.0, 0.5, 0.0]


def test_texts_are_lowered_before_they_meet_keywords(spark, tmp_path):
    spark.createDataFrame([(1, "Some Words"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, "WORDS some more")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dialogues.QUERIES["keyword_match_documents"](spark, str(tmp_path))
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "lower(" not in above
    assert sorted(map(tuple, got.collect())) == [(20, 1, 0.666667), (20, 2, 0.0)]
