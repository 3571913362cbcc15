"""Removal of byte strings that are repeated in a corpus, found through suffix arrays.

Each byte that a string of `length` bytes covers which also starts anywhere else
(the same document included) is removed; strings are judged on the input. Null
text is empty. Repeated rows are copies of each other, so what is long enough in them goes
from all. Null doc_ids are documents like any other. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import tidy
from folio.llm.exact_repeats import covered, repeated_runs, without

LENGTH = 200


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """d1, d2, scope and body of each document, next to its other columns."""
    return (
        docs.withColumn("body", F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
        .withColumn("d1", F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"))
        .withColumn("d2", F.shiftright(F.xxhash64(F.col("doc_id").isNull(), "body"), 33).cast("int"))
        .withColumn("scope", F.lit(0).cast("long"))
    )


def with_runs(docs: DataFrame, length: int, text: str, keep: list[str]) -> DataFrame:
    """A struct of the columns `keep`, body and the repeated runs of each document."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    rows = identified(docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text"), kept), "text")
    runs = repeated_runs(rows, length)
    return rows.join(runs.hint("shuffle_hash"), ["d1", "d2"], "left").select("kept", "body", "runs")


def removals(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = covered([(r["first"], r["last"]) for r in runs or ()])
                out.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(data, gone)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).field(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_runs(docs, length, text, ["doc_id"]).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """The documents with all their columns and what is left of their texts.

    A cut can fall within a character of several bytes: what is left of that character goes, too.
    """
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(0)
            left = [without(data, covered([(r["first"], r["last"]) for r in runs or ()])).decode("utf-8", "ignore") for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[kept.field(k) for k in range(len(names))], pa.array(left, pa.string())], names=[*names, text])

    return with_runs(docs, length, text, names).mapInArrow(tidy(run), schema).select(*docs.columns)
