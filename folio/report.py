"""Looks at extracted tables: python -m folio.report TABLES {stats | doc ID | export ID FILE}."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folio.functions.tables import preview
from folio.operators.status import accuracy_bands
from folio.sources.objects import write_table_json


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("stats", "doc", "export"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    tables = spark.read.parquet(args[0])
    if args[1] == "stats":
        for name, value in accuracy_bands(tables).first().asDict().items():
            print(f"{name}: {value}")
    elif args[1] == "doc":
        shown = tables.where(F.col("document_id") == args[2]).orderBy("page_number", "id")
        for r in shown.select("id", "page_number", "caption", "accuracy", F.size("rows").alias("n"), preview(F.col("headers"), F.col("rows")).alias("text")).collect():
            print(f"Table {r.id}, page {r.page_number}, accuracy {r.accuracy}, {r.n} rows: {r.caption or 'no caption'}\n{r.text}\n")
    else:
        write_table_json(tables, int(args[2]), args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
