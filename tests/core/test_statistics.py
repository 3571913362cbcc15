"""Statistics change the order of joins."""

import re
import uuid

from folio.indexes import statistics


def order(df):
    """The tables of a plan in the order in which they are joined."""
    return re.findall(r"Relation spark_catalog\.default\.(\w+?)_[0-9a-f]{8}", df._jdf.queryExecution().optimizedPlan().toString())


def test_joins_are_ordered_by_what_was_counted(spark, tmp_path):
    tag = uuid.uuid4().hex[:8]
    big = spark.range(20_000).selectExpr("id as k", "id % 200 as a", "id % 5000 as b")
    wide = spark.range(5000).selectExpr("id as b", "repeat('x', 5) as said")
    few = spark.range(3).selectExpr("id as a", "'y' as name")
    names = {n: f"{n}_{tag}" for n in ("big", "wide", "few")}
    for n, df in (("big", big), ("wide", wide), ("few", few)):
        statistics.stored_table(df, names[n], f"{tmp_path}/{n}")
    text = "select * from {big} join {wide} on {big}.b = {wide}.b join {few} on {big}.a = {few}.a".format(**names)
    try:
        with statistics.cost_based(spark):
            before = order(spark.sql(text))
            want = sorted(map(str, spark.sql(text).collect()))
            statistics.analyze(spark, *names.values())
            after = order(spark.sql(text))
            assert sorted(map(str, spark.sql(text).collect())) == want and len(want) == 300
        # the small table cuts the big one down before the wide one is joined
        assert before == ["big", "wide", "few"] and set(after[:2]) == {"big", "few"} and after[2] == "wide"
        assert statistics.row_count(spark, names["big"]) == 20_000
        got = {r.column_name: (r.least, r.greatest, r.nulls) for r in statistics.column_statistics(spark, names["big"], ["k", "b"]).collect()}
        assert got == {"k": ("0", "19999", "0"), "b": ("0", "4999", "0")}
    finally:
        for n in names.values():
            spark.sql(f"drop table {n}")
