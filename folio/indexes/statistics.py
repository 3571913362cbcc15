"""Statistics of stored tables, by which the cost-based optimizer orders joins."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the optimizer uses statistics for, once they are there.
COST_BASED = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.statistics.histogram.enabled": "true", "spark.sql.cbo.planStats.enabled": "true"}


@contextmanager
def cost_based(spark: SparkSession):
    """Within it, plans are made by cost; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in COST_BASED}
    try:
        for k, v in COST_BASED.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_table(rows: DataFrame, name: str, path: str) -> DataFrame:
    """Rows as a table of the catalog, which statistics can be kept of."""
    rows.write.format("parquet").option("path", path).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def analyze(spark: SparkSession, *names: str) -> None:
    """Counts rows, sizes and, of every column, extremes, nulls, distinct values and a histogram; a scan of each table."""
    with cost_based(spark):
        for name in names:
            spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def column_statistics(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """(table_name, column_name, least, greatest, nulls, distinct_values) as the catalog has them, as text."""
    rows = []
    for c in columns:
        known = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} {c}").collect()}
        rows.append((name, c, *[known.get(k) for k in ("min", "max", "num_nulls", "distinct_count")]))
    return spark.createDataFrame(rows, "table_name string, column_name string, least string, greatest string, nulls string, distinct_values string")


def row_count(spark: SparkSession, name: str) -> int | None:
    """The number of rows that the catalog has noted."""
    found = spark.sql(f"DESCRIBE EXTENDED {name}").where(F.col("col_name") == "Statistics").select("data_type").first()
    return int(found[0].split(", ")[1].split(" ")[0]) if found and "rows" in found[0] else None
