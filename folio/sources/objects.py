"""Stored files and line-delimited JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.providers import PageReader


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, content and content_hash of the files of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", "content", F.sha2("content", 256).alias("content_hash"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def page_texts(stored: DataFrame, reader: PageReader) -> DataFrame:
    """(path, page_number, raw_text, error) of stored files, pages numbered from 1; a file that fails gives its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, n, text, None) for n, text in enumerate(reader.pages(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "raw_text", "error"]).astype({"page_number": "Int32"})

    return stored.select("path", "content").mapInPandas(run, "path string, page_number int, raw_text string, error string")


def preference_pairs(spark: SparkSession, path: str) -> DataFrame:
    """prompt, chosen and rejected of a JSON-lines file; an empty set is an error."""
    pairs = spark.read.schema("prompt string, chosen string, rejected string").json(path)
    if pairs.isEmpty():
        raise ValueError(f"{path} holds no pairs")
    return pairs


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("prompt", "chosen", "rejected").write.mode("overwrite").json(path)


def write_table_json(tables: DataFrame, table_id: int, path: str) -> None:
    """One extracted table as a JSON document."""
    tables.where(F.col("id") == table_id).select("id", "document_id", "page_number", "caption", "accuracy", "headers", "rows").coalesce(1).write.mode("overwrite").json(path)
