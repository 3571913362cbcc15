"""Crawling, ingestion, states, identity of content, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import status
from folio.plans.registry import DOCS, registry
from folio.sources import crawl
from folio.sources.schemas import STATUSES, documents, table

QUERIES, ORACLE_SQL, query = registry()

STATES = "(select doc_id as document_id, ['" + "','".join(STATUSES) + "'][(doc_id % 6 + 1)::int] as status from documents)"


def states(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.get(F.array(*[F.lit(s) for s in STATUSES]), (F.col("doc_id") % 6).cast("int")).alias("status"))


@query(f"""with a as (select document_id, case when status = 'PROCESSING' then 'NEW' else status end as s1 from {STATES}), b as (select document_id, case when s1 in ('FAILED', 'CHUNKS_BUILT') then 'NEW' else s1 end as status, s1 from a)
select b.document_id, b.status, count(e.vec_id) as parts from b left join embeddings e on e.vec_id = b.document_id and b.s1 not in ('FAILED', 'CHUNKS_BUILT') group by all""")
def status_transitions(spark, sf_dir):
    """Orphans put back, failed and built documents reset with what belongs to them."""
    docs = status.changed(states(spark, sf_dir), ["PROCESSING"], "NEW")
    parts = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    after, (left,) = status.reset(docs, [parts], ["FAILED", "CHUNKS_BUILT"])
    return after.join(left.groupBy("document_id").agg(F.count(F.lit(1)).alias("parts")), "document_id", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))


@query("select d.source as document_id, count(*) as chunks, count(*) filter (e.vec_id is null) as remaining, case when count(*) filter (e.vec_id is null) = 0 then 'EMBEDDED' else 'CHUNKS_BUILT' end as status from documents d left join embeddings e on e.vec_id = d.doc_id group by 1")
def null_embedding_progress(spark, sf_dir):
    """Sources as documents: chunks that still lack a vector, and the state that follows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return status.embedding_progress(d.join(e, "doc_id", "left"))


@query(f"""with n as (select chunk_id, document_id, status from (select e.vec_id as chunk_id, s.* from embeddings e join {STATES} s on s.document_id = e.vec_id))
select document_id, document_id < 100 as emptied, case when document_id < 100 then 'CHUNKS_BUILT' else status end as status from n""")
def embeddings_reset(spark, sf_dir):
    """Vectors of the first hundred documents taken away, their states set back."""
    docs = states(spark, sf_dir)
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    emptied, after = status.without_embeddings(c, docs, list(range(100)))
    return emptied.join(after, "document_id").select("document_id", F.col("embedding").isNull().alias("emptied"), "status")


@query(f"select content_hash, min(document_id) as document_id, any_value(content_length) as content_length from {DOCS} where content_hash not in (select content_hash from {DOCS} where source_system = 'src0') group by 1")
def content_dedup(spark, sf_dir):
    """Content that one source does not have yet, once each."""
    d = documents(spark, sf_dir).select("document_id", "source_system", "content_hash", "content_length")
    return crawl.new_content(d, d.where("source_system = 'src0'")).select("content_hash", "document_id", "content_length")


@query("select item_id, text, length(text) > 300 as old from benchmark")
def seed_if_absent(spark, sf_dir):
    """All items, the short ones seeded beside the long ones."""
    b = table(spark, sf_dir, "benchmark")
    old = b.where(F.length("text") > 300).withColumn("old", F.lit(True))
    return status.seeded(old, b.withColumn("old", F.lit(False)), "item_id")


@query("select doc_id as document_id, case when n_chars < 500 then upper(lang) else lang end as doc_type, n_chars < 500 as replaced from documents")
def replace_by_key(spark, sf_dir):
    """The rows of short documents replaced."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("doc_type"), "n_chars", F.lit(False).alias("replaced"))
    new = d.where("n_chars < 500").withColumn("doc_type", F.upper("doc_type")).withColumn("replaced", F.lit(True))
    return status.replaced(d.drop("n_chars"), new.drop("n_chars"))


@query("select document_id from " + STATES + " where status = 'NEW' order by document_id limit 50")
def pending_documents(spark, sf_dir):
    """The next fifty documents to work on."""
    return status.pending(states(spark, sf_dir), 50).select("document_id")


HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"'']([^\"'']*)[\"'']"
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|''([^'']*)'')[^>]*>(.*?)</a>"


@query(f"select distinct 'https://www.rba.gov.au' || h as link from (select unnest(regexp_extract_all(html, '{HREF}', 1)) as h from pages) where regexp_matches(h, '^/[A-Z][a-z]+$')")
def crawl_links(spark, sf_dir):
    """Distinct addresses in all pages that match a pattern, made absolute."""
    return crawl.issue_links(table(spark, sf_dir, "pages"), r"^/[A-Z][a-z]+$")


@query(f"""with a as (select page_id, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) as href, unnest(regexp_extract_all(html, '{ANCHOR}', 3)) as t, unnest(range(0, len(regexp_extract_all(html, '{ANCHOR}', 1)))) as position from pages)
select page_id, 'https://www.rba.gov.au' || href as file_url, max_by(nullif(trim(regexp_replace(t, '<[^>]*>', '', 'g')), ''), position) as link_text, min(position)::int as position from a where contains(lower(href), '/t') and starts_with(href, '/') group by 1, 2""")
def crawl_file_candidates(spark, sf_dir):
    """Linked files of every page: an address keeps its first place and its last text."""
    return crawl.file_candidates(table(spark, sf_dir, "pages"), "/", kind="/t")


@query("select page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), url) as title, null::date as publication_date from pages")
def issue_metadata(spark, sf_dir):
    return crawl.issue_metadata(table(spark, sf_dir, "pages")).select("page_id", "title", "publication_date")


@query(r"select page_id, 'raw/smp/' || case when page_id % 2 = 0 then '2020' else 'undated' end || '/' || coalesce(nullif(list_last(string_split(regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', ''), '/')), ''), 'document.pdf') as object_key from pages")
def object_key(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", crawl.object_key(F.lit("SMP"), F.when(F.col("page_id") % 2 == 0, F.lit("2020-05-01").cast("date")), F.col("url")).alias("object_key"))


@query("select event_type, count(*) as n, count(distinct user_id) as users, min(ts) as first_ts, max(ts) as last_ts from events group by 1")
def event_log_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("select page_id from pages where contains(url, '/en/') or contains(url, '/de/')")
def pages_of_parts(spark, sf_dir):
    """Pages whose address has one of some parts, as years would be."""
    return crawl.of_years(table(spark, sf_dir, "pages"), {"en", "de"}).select("page_id")


@query(f"""with a as (select page_id, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) as href, unnest(regexp_extract_all(html, '{ANCHOR}', 3)) as t, unnest(range(0, len(regexp_extract_all(html, '{ANCHOR}', 1)))) as position from pages),
l as (select page_id, href, max_by(nullif(trim(regexp_replace(t, '<[^>]*>', '', 'g')), ''), position) as link_text from a where starts_with(href, '/') and contains(lower(href), '/') group by 1, 2)
select page_id, 'https://www.rba.gov.au' || href as file_url, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), url) || case when coalesce(lower(link_text) in ('download pdf', 'pdf'), true) then '' else ' – ' || link_text end as title from l join pages using (page_id)""")
def registered_titles(spark, sf_dir):
    """The titles under which linked files are registered."""
    p = table(spark, sf_dir, "pages")
    named = crawl.issue_metadata(p).select("page_id", "title")
    return crawl.file_candidates(p, "/", kind="/").join(named, "page_id").select("page_id", "file_url", crawl.registered_title(F.col("title"), F.col("link_text")).alias("title"))


@query("""with p as (select page_id, url, html, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), url) as title, case page_id % 3 when 0 then 'PDF' when 1 then 'Part ' || page_id end as link_text, sha256(html) as content_hash from pages),
known as (select url as source_url, title, 'SMP' as doc_type, 'raw/old' as s3_key, content_hash, 'EMBEDDED' as status from p where page_id % 5 = 0),
key as (select *, regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') as path from p where content_hash not in (select content_hash from known)),
new as (select url as source_url, title || case when coalesce(lower(link_text) in ('download pdf', 'pdf'), true) then '' else ' – ' || link_text end as title, 'FSR' as doc_type, 'raw/fsr/undated/' || coalesce(nullif(string_split(path, '/')[-1], ''), 'document.pdf') as s3_key, content_hash, 'NEW' as status
from key qualify row_number() over (partition by content_hash order by url) = 1)
select *, case when length(title) > 60 then title[1:60] || '...' else title end as shown from (select * from known union all select * from new)""")
def registered_documents(spark, sf_dir):
    """The documents after all pages are registered, one in five of which is known by its content; with titles for display."""
    p = table(spark, sf_dir, "pages").withColumn("content_hash", F.sha2("html", 256)).withColumn("source_url", F.col("url"))
    titles = crawl.issue_metadata(table(spark, sf_dir, "pages")).select("page_id", "title")
    link = F.when(F.col("page_id") % 3 == 0, "PDF").when(F.col("page_id") % 3 == 1, F.concat(F.lit("Part "), "page_id"))
    found = p.join(titles, "page_id").select("page_id", "source_url", "title", link.alias("link_text"), F.lit("FSR").alias("doc_type"), F.lit(None).cast("date").alias("publication_date"), "content_hash")
    known = found.where("page_id % 5 = 0").select("source_url", "title", F.lit("SMP").alias("doc_type"), F.lit("raw/old").alias("s3_key"), "content_hash", F.lit("EMBEDDED").alias("status"))
    return crawl.registered(found.drop("page_id"), known).withColumn("shown", crawl.shown_title(F.col("title")))


@query(f"""with m as (select message_id, session_id, role, content, created_at from (select row_number() over (order by conv_id, turn) - 1 as message_id, conv_id as session_id, role, text as content, turn as created_at from conversations)),
t as (select session_id, max(created_at) + 1 as moment from m group by 1 union all select -1, 0),
n as (select session_id, moment, 'user' as role, 'again ' || session_id as content, 0 as n from t union all select session_id, moment, 'assistant', 'answer', 1 from t where session_id % 4 <> 0)
select * from m union all select (select max(message_id) from m) + row_number() over (order by moment, session_id, n), session_id, role, content, moment from n""")
def chat_append(spark, sf_dir):
    """One more turn for every session and a new one; some generations fail."""
    from folio.plans import history
    from folio.sources.schemas import messages

    m = messages(spark, sf_dir)
    sessions = m.groupBy("session_id").agg(F.min("created_at").alias("created_at"))
    last = m.groupBy("session_id").agg((F.max("created_at") + 1).alias("at")).union(spark.createDataFrame([(-1, 0)], "session_id long, at long"))
    s = F.col("session_id")
    turn = last.select(s, F.concat(F.lit("again "), s.cast("string")).alias("query_text"), F.when(s % 4 != 0, "answer").alias("answer"), "at")
    return history.with_turn(m, sessions, turn)[0]
