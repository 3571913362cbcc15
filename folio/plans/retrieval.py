"""Search, fusion, diversity, re-scoring and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.query import is_data_query, query_class, recency, target_year
from folio.indexes import cells
from folio.operators import context, fusion, lexical, mmr, vectors
from folio.plans.registry import ASKED, CHUNKS, DOCS, registry
from folio.providers import OverlapScorer, WordCounter
from folio.sources.schemas import chunks, documents, table
from folio.sources.shared import new_path

QUERIES, ORACLE_SQL, query = registry()

#: Questions with the label whose first vector stands for their embedding, and the year they are asked in.
ASKED_TEXTS = [(0, "What is the forecast for 2019"), (1, "of the and"), (2, "the that rate with 2021 after 2020"), (3, "why are and of in this inoron"), (4, "an outlook to 2045")]
AS_OF_YEAR = 2024
#: Hits of either search that are merged.
FETCHED = 40


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"), F.min("vec_id").alias("vec_id"))


def asked_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED_TEXTS, "query_id int, query_text string").withColumn("as_of_year", F.lit(AS_OF_YEAR))


def both_searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vector hits and the term hits of the asked texts, as (query_id, chunk_id, score)."""
    rows, texts = chunks(spark, sf_dir), asked_texts(spark)
    vector = asked_vectors(spark, sf_dir).join(texts.select("query_id"), "query_id")
    near = vectors.top_k_of_many(rows, vector, FETCHED).withColumn("score", F.round(vectors.similarity(F.col("distance")), 6))
    terms = texts.select("query_id", lexical.plain_terms(F.col("query_text")).alias("terms"))
    return near, lexical.matched_terms(rows, terms, FETCHED)


def features_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fusion.with_maxima(fusion.merged_hits(*both_searches(spark, sf_dir)))
    known = hits.join(chunks(spark, sf_dir).select("chunk_id", "publication_date", "table_id", "title"), "chunk_id").join(F.broadcast(fusion.query_features(asked_texts(spark))), "query_id")
    return fusion.in_target_years(known, F.col("target_year"), F.col("publication_date"))


HITS = f"""
c as (select * from {CHUNKS}),
t(query_id, query_text) as (values {", ".join(f"({k}, '{x}')" for k, x in ASKED_TEXTS)}),
sem as (select q.query_id, c.chunk_id, round(greatest(0.0, 1 - (round(1 - list_cosine_similarity(c.embedding, q.query_vector), 6) + 0.0)), 6) as score
        from c, {ASKED} q where q.query_id in (select query_id from t)
        qualify row_number() over (partition by q.query_id order by round(1 - list_cosine_similarity(c.embedding, q.query_vector), 6), c.chunk_id) <= {FETCHED}),
terms as (select query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query_text), '\\s+'), lambda w: w <> ''))) as term from t),
words as (select chunk_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) as term from c),
lex as (select query_id, chunk_id, count(*) as score from words join terms using (term) group by query_id, chunk_id
        qualify row_number() over (partition by query_id order by count(*) desc, chunk_id) <= {FETCHED}),
merged as (select query_id, chunk_id, coalesce(sem.score, 0.0) as semantic, coalesce(lex.score, 0)::double as lexical
           from sem full join lex using (query_id, chunk_id)),
maxed as (select *, max(semantic) over (partition by query_id) as semantic_max, max(lexical) over (partition by query_id) as lexical_max from merged)"""
# The keywords and the year pattern of functions/query.py, spelled out here so that the SQL does not depend on them.
FEATURES = f"""{HITS},
low as (select query_id, query_text, lower(query_text) as l, list_max(list_transform(regexp_extract_all(query_text, '((?:19|20)\\d{{2}})', 1), lambda y: y::int)) as target_year,
        len(list_filter(string_split_regex(query_text, '\\s+'), lambda w: w <> '')) as n from t),
f as (select query_id, target_year, coalesce(target_year, {AS_OF_YEAR}) as reference_year,
      len(list_filter(['forecast','projection','outlook','trend','rate','percent','%','growth','decline','increase','decrease','target','data','numbers','quarterly','annual','year','month','when','how much','what is the'], lambda k: contains(l, k))) > 0 as data_query,
      n <= 5 and len(list_filter(['what','when','where','why','how','which'], lambda k: contains(l, k))) = 0 as keyword from low),
known as (select m.*, f.* exclude query_id, c.publication_date, c.table_id, coalesce(year(c.publication_date) in (f.target_year, f.target_year - 1), false) as fits from maxed m join f using (query_id) join c using (chunk_id)),
kept as (select * from known qualify fits or not bool_or(fits) over (partition by query_id))"""
RECENCY = "case when publication_date is null then 0.0 else exp(-greatest(0, reference_year - year(publication_date)) / 1.5) end"


@query(f"""select chunk_id, document_id, title, doc_type, publication_date, distance, round(greatest(0.0, 1 - distance), 6) as semantic from
(select c.*, round(1 - list_cosine_similarity(c.embedding, q.embedding::double[]), 6) + 0.0 as distance from {CHUNKS} c, (select embedding from embeddings where vec_id = 0) q)
order by distance, chunk_id limit 20""")
def vector_topk(spark, sf_dir):
    """The 20 chunks nearest to the first vector, with fields of their documents."""
    rows = chunks(spark, sf_dir).select("chunk_id", "document_id", "title", "doc_type", "publication_date", "embedding")
    asked = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    return vectors.top_k_of_one(rows, asked, 20).drop("embedding").withColumn("semantic", F.round(vectors.similarity(F.col("distance")), 6))


@query(f"""select q.query_id, e.vec_id as chunk_id, round(1 - list_cosine_similarity(e.embedding::double[], q.query_vector), 6) + 0.0 as distance,
row_number() over (partition by q.query_id order by round(1 - list_cosine_similarity(e.embedding::double[], q.query_vector), 6), e.vec_id)::int as rank
from embeddings e, (select vec_id as query_id, embedding::double[] as query_vector from embeddings where vec_id % 20 = 0) q qualify rank <= 10""")
def vector_topk_batch(spark, sf_dir):
    """The ten vectors nearest to every one whose id is divisible by 20."""
    every = table(spark, sf_dir, "embeddings")
    asked = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.top_k_of_many(every.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, 10)


NEAREST_TO_TWENTIETHS = """select q.query_id, e.vec_id as chunk_id, round(1 - list_cosine_similarity(e.embedding::double[], q.query_vector), 6) + 0.0 as distance,
row_number() over (partition by q.query_id order by round(1 - list_cosine_similarity(e.embedding::double[], q.query_vector), 6), e.vec_id)::int as rank
from embeddings e, (select vec_id as query_id, embedding::double[] as query_vector from embeddings where vec_id % 20 = 0) q qualify rank <= 10"""


def searched_by_cells(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    index = cells.build(every, new_path(spark, "cells"), "vec_id")
    asked = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = cells.search(index, asked, 10, probes=4 if exact else cells.probes_for(index, 10), exact=exact)
    return found.select("query_id", F.col("vec_id").alias("chunk_id"), "distance", "rank")


@query(NEAREST_TO_TWENTIETHS)
def vector_index_exact(spark, sf_dir):
    """The ten vectors nearest to every one whose id is divisible by 20, by way of the cell index; those of a full scan."""
    return searched_by_cells(spark, sf_dir, True)


@query()
def vector_index_probes(spark, sf_dir):
    """The same from as many of the nearest cells as a sample needs to find 97 of 100; recall against the full scan is in the README."""
    return searched_by_cells(spark, sf_dir, False)


@query("""with t as (select item_id as query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))) as term from benchmark),
w as (select doc_id as chunk_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) as term from documents)
select query_id, chunk_id, count(*) as score, row_number() over (partition by query_id order by count(*) desc, chunk_id)::int as rank from w join t using (term) group by query_id, chunk_id qualify rank <= 10""")
def lexical_topk_terms(spark, sf_dir):
    """For the words of every benchmark item the ten documents that have most of them."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("terms"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return lexical.matched_terms(rows, asked, 10)


@query()
def lexical_cover_density(spark, sf_dir):
    """Stemmed search with phrases, alternatives and exclusions over a positional index of all documents."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return lexical.search(lexical.index(rows), [(0, "ention ering"), (1, '"thndia ing" or anhe -moron'), (2, "idiot or clown")], 20)


@query(f"with {HITS} select query_id, chunk_id, semantic, lexical, semantic_max, lexical_max from maxed")
def hybrid_full_outer_merge(spark, sf_dir):
    """The hits of both searches, merged, with their maxima."""
    return fusion.with_maxima(fusion.merged_hits(*both_searches(spark, sf_dir)))


@query(f"""with {FEATURES}, scored as (select *, round(0.7 * (case when keyword then 0.6 else 1.0 end) * (case when semantic_max > 0 then semantic / semantic_max else 0 end)
+ 0.3 * (case when keyword then 1.4 else 1.0 end) * (case when lexical_max > 0 then lexical / lexical_max else 0 end)
+ 0.25 * {RECENCY} + case when data_query and table_id is not null then 0.3 else 0.0 end, 6) as score from kept)
select query_id, chunk_id, semantic, lexical, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from scored qualify rank <= 10""")
def hybrid_weighted_fusion(spark, sf_dir):
    """Weighted fusion of both searches with recency and table boosts."""
    scored = fusion.weighted_scores(features_of_hits(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return fusion.final_order(scored, 10, 6).select("query_id", "chunk_id", "semantic", "lexical", "score", "rank")


@query(f"""with {FEATURES}, ranked as (select *, row_number() over (partition by query_id order by semantic desc, chunk_id) as rs, row_number() over (partition by query_id order by lexical desc, chunk_id) as rl from kept),
scored as (select *, round(1.0 / (60 + rs) + 1.0 / (60 + rl) + 0.25 * {RECENCY} + case when data_query and table_id is not null then 0.5 else 0.0 end, 9) as score from ranked)
select query_id, chunk_id, rs as semantic_rank, rl as lexical_rank, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from scored qualify rank <= 10""")
def hybrid_rrf(spark, sf_dir):
    """Reciprocal rank fusion of both searches with recency and table boosts."""
    scored = fusion.fused_scores(features_of_hits(spark, sf_dir)).withColumn("score", F.round("score", 9))
    out = fusion.final_order(scored, 10, 9)
    return out.select("query_id", "chunk_id", F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("lexical_rank").cast("long").alias("lexical_rank"), "score", "rank")


LISTS = "select {n} as list, e.vec_id as id, row_number() over (order by round(1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6), e.vec_id) as rank from embeddings e, embeddings q where q.vec_id = {n} qualify rank <= 50"


@query(f"select 0 as query_id, id, round(sum(1.0 / (60 + rank)), 9) as rrf from ({LISTS.format(n=0)} union all {LISTS.format(n=1)}) group by id")
def rrf_outer(spark, sf_dir):
    """Two ranked lists fused; what one lacks gets nothing from it."""
    e = table(spark, sf_dir, "embeddings")
    lists = []
    for n in (0, 1):
        near = vectors.top_k_of_one(e.select(F.col("vec_id").alias("id"), "embedding"), e.where(F.col("vec_id") == n).select(F.col("embedding").alias("query_vector")), 50, "id")
        lists.append(near.select(F.lit(0).alias("query_id"), "id", F.row_number().over(Window.orderBy("distance", "id")).alias("rank")))
    return fusion.fuse_lists(lists).withColumn("rrf", F.round("rrf", 9))


def mmr_sql(k: int, trade: float) -> str:
    """Maximal marginal relevance with one CTE for each step."""
    steps = [
        f"""cand as (select q.query_id, e.vec_id as chunk_id, e.embedding::double[] as v, round(1 - (round(1 - list_cosine_similarity(e.embedding::double[], q.query_vector), 6)), 6) as rel,
row_number() over (partition by q.query_id order by round(1 - list_cosine_similarity(e.embedding::double[], q.query_vector), 6), e.vec_id) as rank, list_cosine_similarity(e.embedding::double[], q.query_vector) as exact
from embeddings e, {ASKED} q where e.vec_id <> q.vec_id qualify rank <= 20)""",
        "s1 as (select query_id, 1 as position, chunk_id, v from cand qualify row_number() over (partition by query_id order by round(exact, 6) desc, rank) = 1)",
    ]
    for n in range(2, k + 1):
        taken = " union all ".join(f"select * from s{m}" for m in range(1, n))
        steps.append(
            f"""s{n} as (select query_id, {n} as position, chunk_id, v from (select c.query_id, c.chunk_id, c.v, c.rank, round({trade} * any_value(c.exact) - {1 - trade} * max(list_cosine_similarity(c.v, t.v)), 6) as value
from cand c join ({taken}) t using (query_id) where (c.query_id, c.chunk_id) not in (select (query_id, chunk_id) from ({taken})) group by all)
qualify row_number() over (partition by query_id order by value desc, rank) = 1)"""
        )
    return f"with {', '.join(steps)} select query_id, position, chunk_id from ({' union all '.join(f'select * from s{m}' for m in range(1, k + 1))})"


@query(mmr_sql(5, 0.5))
def mmr_diverse_k5(spark, sf_dir):
    """Five diverse ones of the 20 vectors nearest to each asking vector, itself left out."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = asked_vectors(spark, sf_dir)
    near = vectors.top_k_of_many(e, asked, 21).join(asked.select("query_id", "vec_id", "query_vector"), "query_id").where("chunk_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    hits = near.withColumn("rank", F.row_number().over(order)).where("rank <= 20").withColumn("score", 1 - F.col("distance")).join(e, "chunk_id")
    return mmr.diversify(hits, 5).drop("score")


@query(f"""with q as (select query_id, query_vector, row_number() over (order by query_id) - 1 as n from {ASKED}),
t as (select row_number() over (order by item_id) - 1 as n, text as query_text from benchmark),
hits as (select q.query_id, t.query_text, c.chunk_id, c.text, row_number() over (partition by q.query_id order by round(1 - list_cosine_similarity(c.embedding, q.query_vector), 6), c.chunk_id) as rank from {CHUNKS} c, q join t using (n) qualify rank <= 50),
scored as (select *, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(query_text), '\\s+'), lambda w: w <> '')), list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))))::double as rescore from hits)
select query_id, chunk_id, rank::int as original_rank, rescore, row_number() over (partition by query_id order by rescore desc, rank)::int as position from scored qualify position <= 10""")
def rerank_stub(spark, sf_dir):
    """The 50 nearest chunks of each label re-scored by shared words with a benchmark text."""
    asked = asked_vectors(spark, sf_dir)
    number = lambda c: F.row_number().over(Window.orderBy(c)) - 1
    texts = table(spark, sf_dir, "benchmark").select(number("item_id").alias("n"), F.col("text").alias("query_text"))
    names = asked.select("query_id", number("query_id").alias("n")).join(texts, "n").select("query_id", "query_text")
    rows = chunks(spark, sf_dir)
    hits = vectors.top_k_of_many(rows, asked, 50).join(F.broadcast(names), "query_id").join(rows.select("chunk_id", "text"), "chunk_id")
    return context.rescored(hits, OverlapScorer(), 10).select("query_id", "chunk_id", "original_rank", "rescore", "position")


YEARS = [(0, "in 2019"), (1, "no year"), (2, "1950 only"), (3, "2022 and 2020")]


@query(f"""with q(query_id, query_text) as (values {", ".join(f"({k}, '{x}')" for k, x in YEARS)}),
y as (select query_id, list_max(list_transform(regexp_extract_all(query_text, '((?:19|20)\\d{{2}})', 1), lambda y: y::int)) as target_year from q),
h as (select query_id, document_id, publication_date, coalesce(year(publication_date) in (target_year, target_year - 1), false) as fits from y, {DOCS}),
k as (select * from h qualify fits or not bool_or(fits) over (partition by query_id))
select query_id, count(*) as n, min(publication_date) as first_date, max(publication_date) as last_date from k group by query_id""")
def year_filter_fallback(spark, sf_dir):
    """How many documents each question keeps by the year that it names."""
    asked = spark.createDataFrame(YEARS, "query_id int, query_text string").select("query_id", target_year(F.col("query_text")).alias("target_year"))
    # the filter depends on the date alone, so it is applied to days, of which there are few, not to documents
    days = documents(spark, sf_dir).groupBy("publication_date").agg(F.count(F.lit(1)).alias("n"))
    kept = fusion.in_target_years(days.crossJoin(F.broadcast(asked)), F.col("target_year"), F.col("publication_date"))
    return kept.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("publication_date").alias("first_date"), F.max("publication_date").alias("last_date"))


@query("select o_orderkey, round(exp(-greatest(0, 1998 - year(o_orderdate)) / 1.5), 6) as recency from orders")
def recency_decay(spark, sf_dir):
    """Recency of orders, seen from 1998."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(recency(F.col("o_orderdate"), F.lit(1998)), 6).alias("recency"))


TEXTS = "(select 'c' || conv_id || '/' || turn as id, text from conversations union all select 'b' || item_id, text from benchmark union all select * from (values ('x1', 'What is the rate in 2023?'), ('x2', 'Inflation outlook'), ('x3', ''), ('x4', 'corporate statement of the board for members'), ('x5', 'between 1999 and 20211 or 2005 they all went home')))"


def question_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    x = [("x1", "What is the rate in 2023?"), ("x2", "Inflation outlook"), ("x3", ""), ("x4", "corporate statement of the board for members"), ("x5", "between 1999 and 20211 or 2005 they all went home")]
    return c.union(b).union(spark.createDataFrame(x, "id string, text string"))


# The same keywords.
DATA = "len(list_filter(['forecast','projection','outlook','trend','rate','percent','%','growth','decline','increase','decrease','target','data','numbers','quarterly','annual','year','month','when','how much','what is the'], lambda k: contains(lower(text), k))) > 0"


@query(f"""select id, case when text = '' then 'semantic' when len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 5 and len(list_filter(['what','when','where','why','how','which'], lambda k: contains(lower(text), k))) = 0 then 'keyword'
when regexp_matches(text, '\\d') or {DATA} then 'numerical' else 'semantic' end as query_class from {TEXTS}""")
def classify_query(spark, sf_dir):
    return question_texts(spark, sf_dir).select("id", query_class(F.col("text")).alias("query_class"))


@query(f"select id, {DATA} as data_query from {TEXTS}")
def is_data_query_texts(spark, sf_dir):
    return question_texts(spark, sf_dir).select("id", is_data_query(F.col("text")).alias("data_query"))


@query(f"select id, list_max(list_transform(regexp_extract_all(text, '((?:19|20)\\d{{2}})', 1), lambda y: y::int)) as target_year from {TEXTS}")
def target_year_texts(spark, sf_dir):
    return question_texts(spark, sf_dir).select("id", target_year(F.col("text")).alias("target_year"))


TOP = f"(select q.query_id, c.*, c.chunk_id % 5 + 1 as page_start, c.chunk_id % 5 + 2 as page_end, row_number() over (partition by q.query_id order by round(1 - list_cosine_similarity(c.embedding, q.query_vector), 6), c.chunk_id)::int as rank, round(greatest(0.0, 1 - (round(1 - list_cosine_similarity(c.embedding, q.query_vector), 6) + 0.0)), 6) as score from {CHUNKS} c, {ASKED} q qualify rank <= 8)"


def top_hits(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    near = vectors.top_k_of_many(rows, asked_vectors(spark, sf_dir), 8)
    pages = near.join(rows, "chunk_id").withColumn("page_start", F.col("chunk_id") % 5 + 1).withColumn("page_end", F.col("chunk_id") % 5 + 2)
    return pages.withColumn("score", F.round(vectors.similarity(F.col("distance")), 6)).withColumn("section_hint", F.lit(None).cast("string"))


@query(f"select query_id, sha256(string_agg('[' || doc_type || '] ' || title || ' (pages ' || page_start || '-' || page_end || ')' || chr(10) || text, chr(10) || chr(10) order by rank)) as context_hash from {TOP} group by query_id")
def context_block(spark, sf_dir):
    """The context of the nearest chunks of every label, by its hash."""
    return context.contexts(top_hits(spark, sf_dir)).select("query_id", F.sha2("context", 256).alias("context_hash"))


@query(f"""select query_id, chunk_id, rank, sum(tokens) over (partition by query_id order by rank)::bigint as tokens_so_far from (select *, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as tokens from {TOP})
qualify tokens_so_far <= 1500 or rank <= 3""")
def token_budget(spark, sf_dir):
    """The nearest chunks of every label that fit a budget of words."""
    hits = top_hits(spark, sf_dir).withColumn("tokens", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    return context.within_budget_estimate(hits, 1500).select("query_id", "chunk_id", "rank", "tokens_so_far")


@query(f"""with w as (select *, len(list_filter(string_split_regex('[' || doc_type || '] ' || title || ' (pages ' || page_start || '-' || page_end || ')' || chr(10) || text, '\\s+'), lambda w: w <> '')) as n from {TOP})
select query_id, rank from w qualify rank <= 3 or sum(n) over (partition by query_id order by rank) <= 1500""")
def token_budget_exact(spark, sf_dir):
    """The same by counting the joined context anew for every length."""
    hits = top_hits(spark, sf_dir).withColumn("excerpt", context.excerpt())
    return context.within_budget(hits, WordCounter(), 1500)


@query(f"select query_id, rank, chunk_id, document_id, doc_type, title, strftime(publication_date, '%Y-%m-%d') as publication_date, page_start, page_end, score, substring(text, 1, 500) as snippet, table_id from {TOP}")
def evidence_payload(spark, sf_dir):
    """The evidence of every label's nearest chunks, a row for each item."""
    items = context.evidence(top_hits(spark, sf_dir)).select("query_id", F.posexplode("evidence").alias("at", "e"))
    return items.select("query_id", (F.col("at") + 1).alias("rank"), "e.chunk_id", "e.document_id", "e.doc_type", "e.title", "e.publication_date", F.col("e.pages")[0].alias("page_start"), F.col("e.pages")[1].alias("page_end"), "e.score", "e.snippet", "e.table_id")


@query(f"""select a.query_id, coalesce('Answer grounded in ' || b.s, 'No supporting excerpts retrieved; unable to ground an answer.') as analysis from (select query_id from {ASKED} union all select -1) a
left join (select query_id, string_agg(title || ' (' || doc_type || ', pages ' || page_start || '-' || page_end || ')', '; ' order by rank) as s from {TOP} group by query_id) b using (query_id)""")
def analysis_text(spark, sf_dir):
    """What the answer to every label is grounded in, and to one without hits."""
    asked = asked_vectors(spark, sf_dir).select("query_id").union(spark.createDataFrame([(-1,)], "query_id int"))
    return context.analyses(asked, top_hits(spark, sf_dir))


@query(f"""with h as (select t.*, n.caption, n.rows from {TOP} t left join (select r.r_regionkey as id, r.r_name as caption, list([k.n_nationkey::varchar, k.n_name] order by k.n_nationkey) as rows from region r join nation k on k.n_regionkey = r.r_regionkey group by all) n on n.id = t.table_id)
select query_id, sha256(string_agg('[' || doc_type || '] ' || title || ' (pages ' || page_start || '-' || page_end || ')' || chr(10) || case when rows is null then text else
'Table: ' || caption || chr(10) || chr(10) || '| n_nationkey | n_name |' || chr(10) || '| ' || repeat('-', 11) || ' | ' || repeat('-', 6) || ' |' || chr(10) || array_to_string(list_transform(rows, lambda r: '| ' || r[1] || ' | ' || r[2] || ' |'), chr(10)) end, chr(10) || chr(10) order by rank)) as context_hash from h group by query_id""")
def context_with_tables(spark, sf_dir):
    """The context in which table chunks show their table, where it is known."""
    from folio.plans.tables import nation_tables

    known = nation_tables(spark, sf_dir).select(F.col("id").cast("long").alias("table_id"), F.struct("headers", "rows", "caption").alias("t"))
    hits = top_hits(spark, sf_dir).join(F.broadcast(known), "table_id", "left")
    table_or_text = context.excerpt(F.col("t"))
    whole = F.when(F.col("t").isNull(), context.excerpt()).otherwise(table_or_text)
    return hits.withColumn("e", whole).groupBy("query_id").agg(F.sha2(F.array_join(context.ordered(F.col("e")), "\n\n"), 256).alias("context_hash"))
