"""Pages of documents: repeated lines, cleaning, places of chunks, page facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import clean_page


def pages_of_lines(docs: DataFrame, lines: int, key: str = "document_id", text: str = "text") -> DataFrame:
    """Texts cut into pages of so many lines: (key, page_number from 1, raw_text)."""
    every = F.split(F.col(text), "\n")
    grouped = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / lines).cast("int")), lambda k: F.array_join(F.slice(every, k * lines + 1, F.lit(lines)), "\n"))
    return docs.select(key, F.posexplode(grouped).alias("_at", "raw_text")).select(key, (F.col("_at") + 1).alias("page_number"), "raw_text")


def repeating_lines(pages: DataFrame, key: str = "document_id", share: float = 0.8, edge: int = 3, least: int = 3) -> DataFrame:
    """(key, place, line, n): lines among the first or last few of so large a share of a document's pages.

    Occurrences count, not pages; blank pages count as pages. Documents of fewer pages than `least` have none.
    """
    lines = F.filter(F.transform(F.split("raw_text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    some = pages.select(key, lines.alias("lines"))
    edges = some.select(
        key,
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("page").alias("place"), F.lit("").alias("line"))),  # counts the pages on the way
                F.transform(F.slice("lines", 1, edge), lambda x: F.struct(F.lit("header").alias("place"), x.alias("line"))),
                F.transform(F.slice(F.reverse("lines"), 1, edge), lambda x: F.struct(F.lit("footer").alias("place"), x.alias("line"))),
            )
        ).alias("e"),
    ).select(key, "e.*")
    counts = edges.groupBy(key, "place", "line").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.when(F.col("place") == "page", F.col("n"))).over(Window.partitionBy(key))
    often = counts.withColumn("pages", total).where((F.col("place") != "page") & (F.col("pages") >= least) & (F.col("n") >= F.col("pages") * share))
    return often.select(key, "place", "line", "n")


def clean_pages(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds clean_text: each page without headers, footers and the lines that its document repeats."""
    drop = repeating_lines(pages, key).groupBy(key).agg(F.collect_set("line").alias("repeated"))
    return pages.join(drop, key, "left").withColumn("clean_text", clean_page(F.col("raw_text"), F.col("repeated"))).drop("repeated")


def page_range(begin: Column, end: Column, lengths: Column) -> Column:
    """struct(page_start, page_end) from 1 of the text between two offsets of pages joined by a space."""
    starts = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i), i.cast("long"), lambda s, x: s + x))
    ends = F.zip_with(starts, lengths, lambda s, n: s + n)
    first = F.size(F.filter(starts, lambda s: s <= begin))
    last = F.size(F.filter(ends, lambda e: e < end)) + 1
    return F.struct(F.greatest(F.lit(1), first).alias("page_start"), F.least(F.size(lengths), last).alias("page_end"))


def page_facts(pages: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Per page: how many tables and charts (images larger than an icon), and whether any."""
    keys = ["document_id", "page_number"]
    t = tables.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_tables"))
    c = images.groupBy(*keys).agg(F.count_if((F.col("width") > 200) & (F.col("height") > 150)).alias("num_charts"))
    out = pages.select(*keys).join(t, keys, "left").join(c, keys, "left").fillna(0, ["num_tables", "num_charts"])
    return out.withColumn("has_tables", F.col("num_tables") > 0).withColumn("has_charts", F.col("num_charts") > 0)
