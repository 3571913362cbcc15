"""From hits to a prompt: context, budget, evidence, analysis; and re-scoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.tables import markdown
from folio.providers import Scorer, TokenCounter

SYSTEM_PROMPT = "You are a financial analyst. Answer only from the excerpts given, cite document and pages, and say plainly when the excerpts do not hold the answer."


def pages_label(first: Column, last: Column) -> Column:
    return F.concat(F.lit("pages "), F.coalesce(first.cast("string"), F.lit("None")), F.lit("-"), F.coalesce(last.cast("string"), F.lit("None")))


def excerpt(table: Column | None = None) -> Column:
    """[type] title (pages a-b), and below it the table in Markdown or the text."""
    head = F.concat(F.lit("["), F.col("doc_type"), F.lit("] "), F.col("title"), F.lit(" ("), pages_label(F.col("page_start"), F.col("page_end")), F.lit(")\n"))
    body = F.col("text") if table is None else F.coalesce(markdown(table["headers"], table["rows"], table["caption"]), F.col("text"))
    return F.concat(head, body)


def ordered(value: Column, order: str = "rank") -> Column:
    """The values of a group in the order of their rank."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def contexts(hits: DataFrame, table: Column | None = None) -> DataFrame:
    """One context per query."""
    return hits.groupBy("query_id").agg(F.array_join(ordered(excerpt(table)), "\n\n").alias("context"))


def analyses(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """What each answer is grounded in."""
    where = F.when(F.col("page_start").isNull(), F.lit("unspecified pages")).otherwise(pages_label(F.col("page_start"), F.col("page_end")))
    one = F.concat(F.col("title"), F.lit(" ("), F.col("doc_type"), F.lit(", "), where, F.lit(")"))
    said = hits.groupBy("query_id").agg(F.concat(F.lit("Answer grounded in "), F.array_join(ordered(one), "; ")).alias("analysis"))
    return queries.select("query_id").join(said, "query_id", "left").withColumn("analysis", F.coalesce("analysis", F.lit("No supporting excerpts retrieved; unable to ground an answer.")))


def evidence(hits: DataFrame) -> DataFrame:
    """The hits of each query as a list of structs in order."""
    names = ["chunk_id", "document_id", "doc_type", "title"]
    item = F.struct(*names, F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), F.array("page_start", "page_end").alias("pages"), "score", F.substring("text", 1, 500).alias("snippet"), "section_hint", "table_id")
    return hits.groupBy("query_id").agg(ordered(item).alias("evidence"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nExcerpts:\n"), context, F.lit("\n\nAnswer from these excerpts and name their pages."))


def within_budget_estimate(hits: DataFrame, budget: int, least: int = 3, tokens: str = "tokens") -> DataFrame:
    """Hits whose running sum of tokens fits the budget, and the first few in any case; a window form for reports."""
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("tokens_so_far", F.sum(tokens).over(so_far)).where((F.col("tokens_so_far") <= budget) | (F.col("rank") <= least))


def within_budget(hits: DataFrame, counter: TokenCounter, budget: int, overhead: int = 0, least: int = 3) -> DataFrame:
    """The hits (query_id, rank, excerpt) that remain when the last go until the whole context fits; a few stay in any case.

    The joined context is counted anew for each length tried, as tokens may join across excerpts.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        n = len(pdf)
        while n > min(least, len(pdf)) and counter.count("\n\n".join(pdf["excerpt"][:n])) + overhead > budget:
            n -= 1
        return pdf[:n][["query_id", "rank"]]

    kind = hits.schema["query_id"].dataType.simpleString()
    wanted = hits.select("query_id", F.col("rank").cast("int").alias("rank"), "excerpt")
    return wanted.groupBy("query_id").applyInPandas(fit, f"query_id {kind}, rank int")


def rescored(hits: DataFrame, scorer: Scorer, k: int, batch: int = 32, keep_order_on_error: bool = True) -> DataFrame:
    """The best k hits (query_id, query_text, chunk_id, rank, text) of each query by a model's score.

    Adds rescore, position and error. If the model fails, the hits keep their order and carry the error.
    """
    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            scores: list[float | None] = [None] * len(pdf)
            errors: list[str | None] = [None] * len(pdf)
            places = pdf.reset_index(drop=True).groupby("query_id", sort=False).indices
            for at in places.values():
                for lo in range(0, len(at), batch):
                    part = at[lo : lo + batch]
                    try:
                        got = scorer.score(pdf["query_text"].iloc[part[0]], pdf["text"].iloc[part].tolist())
                        for i, s in zip(part, got, strict=True):
                            scores[i] = float(s)
                    except Exception as e:  # noqa: BLE001
                        if not keep_order_on_error:
                            raise
                        for i in part:
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "original_rank": pdf["rank"], "rescore": scores, "error": errors}).astype({"rescore": "float64", "error": "object"})

    scored = hits.select("query_id", "query_text", "chunk_id", F.col("rank").cast("int").alias("rank"), "text").mapInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, original_rank int, rescore double, error string")
    failed = F.max(F.col("error").isNotNull()).over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.when(~F.col("failed"), F.col("rescore")).desc_nulls_last(), "original_rank")
    return scored.withColumn("failed", failed).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).drop("failed")


def captions(tables: DataFrame, blocks: DataFrame, reach: float = 100.0) -> DataFrame:
    """(document_id, page_number, table_id, caption): the nearest block above a table, within reach, that reads like one."""
    from folio.functions.tables import caption_line

    # heights in steps of the reach: what is near a table lies in its own step or in the one above
    step = lambda y: F.floor(F.col(y) / F.lit(reach))
    asked = tables.select("document_id", "page_number", "table_id", "top", F.explode(F.array(step("top"), step("top") - 1)).alias("step"))
    held = blocks.select("document_id", "page_number", "bottom", "text", step("bottom").alias("step"))
    near = asked.join(held, ["document_id", "page_number", "step"])
    above = near.where((F.col("bottom") < F.col("top")) & (F.col("top") - F.col("bottom") < reach)).withColumn("caption", caption_line(F.col("text"))).where("caption is not null")
    best = above.groupBy("document_id", "page_number", "table_id").agg(F.max_by("caption", F.struct("bottom", F.col("text"))).alias("caption"))
    return tables.select("document_id", "page_number", "table_id").join(best, ["document_id", "page_number", "table_id"], "left")
