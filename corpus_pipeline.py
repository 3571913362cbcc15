"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the next documents; the last
returns the packed pieces. `run` writes every stage as Parquet to the shared
folder and reads it again as the input of the next; what a stage read or stored on the
way is deleted when its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, language, near_copies, packing, suffix_dedup
from folio.llm.common import passing, shuffles_dropped, staged, unstage
from folio.ship import ship


def shipped(stage):
    """The stage, with the package on the executors before it begins."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the language classifier rejects: no letters, or a score below its calibrated limit."""
    names = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("others")
    found = language.identify(docs.select(others, "text"), language.fit(docs), keep=("others", "text"))
    return found.where(~F.col("rejected")).select("others.*", "text").select(*[F.col(f"`{c}`") for c in names])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of texts linked by 5-word Jaccard similarity of 0.8; of repeated rows one stays.

    Rows without an id stay if there is a group without any id.
    """
    found = near_copies.near_copies(docs)
    leaders = found.where("doc_id is not null and doc_id = component_id").select("doc_id").distinct()
    # the join and the removal of repeated rows share one exchange by id
    named = docs.join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    unnamed = found.where("component_id is null").select(F.lit(True).alias("_some")).limit(1)
    return named.unionByName(docs.where("doc_id is null").join(F.broadcast(unnamed), F.lit(True), "left_semi"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that occur elsewhere; n_chars counts what is left."""
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a benchmark window occurs."""
    found = decontaminate.find_occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.where(F.size("spans") == 0).select("kept.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", shipped(known_language)),
    ("near_copies", shipped(one_of_near_copies)),
    ("repeated_strings", shipped(without_repeats)),
    ("benchmark", shipped(without_benchmark)),
    ("packing", shipped(packed)),
]

#: No stage has a form in SQL; the tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for k, (name, stage) in enumerate(stages):
        before, left = docs, []
        with passing(left), shuffles_dropped(spark):
            docs = staged(stage(spark, before, sf_dir), f"stage-{name}")
            left.append(docs)
        if k:
            unstage(before)
    return last(spark, docs, sf_dir)
