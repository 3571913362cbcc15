"""Documents to chunks with vectors, set by set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.tables import has_numbers, semantic_text, with_headers
from folio.operators import chunker, pages
from folio.plans.answer import embedded
from folio.providers import Embedder
from folio.sources.shared import kept


def accepted_tables(found: DataFrame, accuracy: int = 70) -> DataFrame:
    """Raw grids (document_id, page_number, grid, accuracy, caption, bbox) that are accurate and hold numbers, with headers and rows."""
    good = found.where(F.col("accuracy") >= accuracy)
    # a generator makes headers and rows once; as columns they would be made anew for the filter and for each that is read
    shaped = good.select("*", F.inline(F.array(with_headers(F.col("grid"))))).drop("grid")
    return shaped.where(has_numbers(F.col("rows"))).withColumn("accuracy", F.col("accuracy").cast("int"))


#: Ways to find tables in a page, the first preferred: by ruled lines, by white space.
FLAVOURS = ("lattice", "stream")


def scanned_tables(pages_: DataFrame, find: Callable[[DataFrame, str], DataFrame], flavours: tuple[str, ...] = FLAVOURS, accuracy: int = 70) -> DataFrame:
    """The accepted tables of pages (document_id, page_number, ...), with their flavour.

    find: gives the raw grids of pages for a flavour. A page on which one flavour yields an accepted table is not searched by the next, so
    the dear ones see what is left. A page that can't be searched simply yields nothing.
    """
    rest, out = pages_, None
    page = ["document_id", "page_number"]
    for k, flavour in enumerate(flavours):
        good = kept(accepted_tables(find(rest, flavour), accuracy).withColumn("flavour", F.lit(flavour)), "tables")
        out = good if out is None else out.unionByName(good)
        if k + 1 < len(flavours):
            rest = rest.join(good.select(*page).distinct(), page, "left_anti")
    return out


def chunks_of(raw_pages: DataFrame, tables: DataFrame | None = None, shape: chunker.Shape = chunker.Shape()) -> DataFrame:
    """Text chunks of documents (document_id, page_number, raw_text), then their tables as chunks; numbers go on."""
    cleaned = pages.clean_pages(raw_pages)
    whole = cleaned.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "clean_text"))), lambda x: x["clean_text"]).alias("pages"))
    text = chunker.chunk_documents(whole, shape=shape).drop("quality").withColumn("table_id", F.lit(None).cast("bigint"))
    if tables is None:
        return text
    from pyspark.sql import Window

    counts = text.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "id")) - 1
    page = F.col("page_number").cast("int")
    extra = tables.withColumn("place", place).join(counts, "document_id", "left").select(
        "document_id",
        (F.coalesce("n", F.lit(0)) + F.col("place")).cast("int").alias("chunk_index"),
        page.alias("page_start"),
        page.alias("page_end"),
        semantic_text(F.col("headers"), F.col("rows"), F.col("caption"), page).alias("text"),
        F.concat(F.lit("Table (page "), page.cast("string"), F.lit(")")).alias("section_hint"),
        F.col("id").cast("bigint").alias("table_id"),
    )
    return text.unionByName(extra.where("text <> ''"))


def with_missing_vectors(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks with a vector for each that has none yet."""
    have = chunks.where("embedding is not null")
    lack = embedded(chunks.where("embedding is null").drop("embedding"), embedder, "text", "embedding")
    return have.unionByName(lack)
