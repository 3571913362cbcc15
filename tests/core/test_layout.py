"""Stored layouts: joins without an exchange, scans of one state, replacement that is whole or not at all."""

import uuid

import pytest
from pyspark.sql import functions as F

from folio.functions import tables
from folio.indexes import layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    tag = uuid.uuid4().hex
    docs = spark.range(500).select(F.col("id").alias("document_id"), F.when(F.col("id") % 5 == 0, "NEW").otherwise("DONE").alias("status"))
    chunks = spark.range(3000).select((F.col("id") % 500).alias("document_id"), F.col("id").alias("chunk_id"))
    a = layout.bucketed(docs, f"docs_{tag}", f"{tmp_path}/docs", "document_id", 8, "status")
    b = layout.bucketed(chunks, f"chunks_{tag}", f"{tmp_path}/chunks", "document_id", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.where("status = 'NEW'").join(b, "document_id").groupBy("document_id").count()
        shown = plan(joined)
        assert "Exchange" not in shown and "PartitionFilters: [isnotnull(status" in shown and "(status#" in shown
        assert joined.count() == 100 and joined.agg(F.sum("count")).first()[0] == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"drop table docs_{tag}")
        spark.sql(f"drop table chunks_{tag}")


def test_replacement_touches_its_parts_only_and_is_whole_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(300).select(F.col("id").alias("document_id"), F.lit("old").alias("text"))
    layout.stored_by_key(rows, path, "document_id", 16)
    files = {f for f in spark.read.parquet(path).inputFiles()}
    new = spark.createDataFrame([(7, "a"), (7, "b"), (999, "c")], "document_id long, text string")
    layout.replace_keys(spark, path, new, "document_id", 16)
    got = sorted((r.document_id, r.text) for r in layout.read_by_key(spark, path).collect())
    assert got == sorted([(k, "old") for k in range(300) if k != 7] + [(7, "a"), (7, "b"), (999, "c")])
    after = {f for f in spark.read.parquet(path).inputFiles()}
    assert len(files - after) <= 2 and len(files & after) >= 14
    with pytest.raises(Exception, match="broken"):
        layout.replace_keys(spark, path, new.withColumn("text", F.when(F.col("text") == "b", F.raise_error(F.lit("broken"))).otherwise("x")), "document_id", 16)
    assert sorted((r.document_id, r.text) for r in layout.read_by_key(spark, path).collect()) == got
    layout.replace_keys(spark, path, new.limit(0), "document_id", 16, layout.read_by_key(spark, path).where("document_id > 3").select("document_id"))
    assert sorted(r.document_id for r in layout.read_by_key(spark, path).collect()) == [0, 1, 2, 3]


def test_variants(spark):
    texts = [(1, '{"a": 1, "b": {"c": [5, "x"]}}'), (2, '{"a": "7"}'), (3, "no json"), (4, None), (5, '{"a": null, "d": 2}'), (6, "[1]")]
    rows = tables.as_variant(spark.createDataFrame(texts, "id int, t string"), "t", "v")
    got = rows.select("id", *tables.variant_columns("v", {"a": ("$.a", "int"), "c": ("$.b.c[0]", "int")}), tables.variant_map("v").alias("m")).orderBy("id").collect()
    assert [(r.a, r.c) for r in got] == [(1, 5), (7, None), (None, None), (None, None), (None, None), (None, None)]
    assert set(got[4].m) == {"a", "d"} and got[2].m is None
