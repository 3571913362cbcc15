"""Queries through stored access paths and layouts that are kept up."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folio.functions import tables
from folio.indexes import layout, statistics, texts
from folio.operators import leases
from folio.operators.lexical import STOP_WORDS
from folio.plans.registry import registry
from folio.sources.schemas import table
from folio.sources.shared import new_path

QUERIES, ORACLE_SQL, query = registry()

SAID = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
STOPPED = "[" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + "]"


def kept_up_index(spark: SparkSession, sf_dir: str) -> texts.TextIndex:
    """An index of the documents after four changes: most, the others, every fourth again, and without every seventeenth."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    index = texts.created(docs.where("chunk_id % 5 <> 0"), new_path(spark, "texts"), stemmed=False)
    index.put(docs.where("chunk_id % 5 = 0"))
    index.put(docs.where("chunk_id % 4 = 0"))
    index.remove(docs.where("chunk_id % 17 = 3"))
    return index


@query(f"""with tok as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from (select doc_id, {SAID} as w from documents where doc_id % 17 <> 3)),
asked as (select item_id as query_id, unnest(list_distinct({SAID})) as word from benchmark),
needed as (select query_id, word, count(*) over (partition by query_id) as n from asked where not list_contains({STOPPED}, word)),
hit as (select query_id, n, doc_id, word, p from tok join needed using (word)),
matching as (select query_id, doc_id from hit group by query_id, doc_id, n having count(distinct word) = n),
occ as (select * from hit semi join matching using (query_id, doc_id)),
latest as (select o.query_id, o.doc_id, o.p, o.n, t.word, max(t.p) as l from occ o join occ t on o.query_id = t.query_id and o.doc_id = t.doc_id and t.p <= o.p group by all),
cover as (select query_id, doc_id, p, min(l) as s from latest group by query_id, doc_id, p, n having count(*) = n),
shortest as (select query_id, doc_id, s, min(p) as p from cover group by query_id, doc_id, s),
scored as (select query_id, doc_id as chunk_id, round(sum(1.0 / (p - s + 1)), 9) as score from shortest group by query_id, doc_id)
select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from scored qualify rank <= 10""")
def text_index_search(spark, sf_dir):
    """Every benchmark item as a question that needs all its words: the ten documents of greatest cover density, from an index that has been changed."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (w != "or"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.array_distinct(words), " ").alias("query_text"))
    return kept_up_index(spark, sf_dir).search(asked, 10).withColumn("score", F.round("score", 9))


@query(f"""with doc as (select doc_id, {SAID} as w from documents where doc_id % 17 <> 3),
tok as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from doc)
select doc_id as chunk_id, len(w)::int as words, count(distinct word) as lexemes, count(p) as places, coalesce(sum(p), 0)::bigint as place_sum
from doc left join (select * from tok where not list_contains({STOPPED}, word)) using (doc_id) group by doc_id, w""")
def text_index_upkeep(spark, sf_dir):
    """What a changed and merged index holds of each document."""
    index = kept_up_index(spark, sf_dir)
    index.merge()
    index.vacuum()
    places = F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)
    none = F.lit(0).cast("long")
    per = index.held_words().groupBy("key").agg(F.first("words").alias("words"), F.count("lexeme").alias("lexemes"), *[F.coalesce(F.sum(x), none).alias(n) for n, x in (("places", F.when(F.col("lexeme").isNotNull(), F.size("positions"))), ("place_sum", places))])
    return per.withColumnRenamed("key", "chunk_id")


#: Leases of six hours; workers are what an id leaves when divided by three.
LEASE = 6 * 3600

@query(f"""with recursive event as (
  select user_id as item, event_id as seq, epoch_us(ts) as moment, (event_id % 3)::varchar as worker,
         case event_type when 'signup' then 'offer' when 'purchase' then 'commit' else 'claim' end as kind,
         row_number() over (partition by user_id order by ts, event_id) as k
  from events where user_id is not null
),
step as (
  select item, 0::bigint as k, null::bigint as seq, null::varchar as worker, null::varchar as outcome, 0::bigint as token, null::varchar as owner, 0::bigint as until, false as done from (select distinct item from event)
  union all
  select item, k, seq, worker, outcome, token + (outcome = 'granted')::bigint,
         case outcome when 'granted' then worker when 'committed' then null when 'offered' then null else owner end,
         case outcome when 'granted' then moment + {LEASE * 10**6} else until end,
         case outcome when 'committed' then true when 'offered' then false else done end
  from (
    select e.item, e.k, e.seq, e.worker, e.moment, s.token, s.owner, s.until, s.done,
           case when kind = 'offer' then case when done then 'offered' else 'known' end
                when kind = 'claim' and not done and not (owner is not null and e.moment < until) then 'granted'
                when kind = 'commit' and not done and owner is not null and e.moment < until and owner = e.worker then 'committed'
                else 'refused' end as outcome
    from step s join event e on e.item = s.item and e.k = s.k + 1
  )
)
select item, seq, worker, outcome, token from step where k > 0""")
def lease_log(spark, sf_dir):
    """Users as items that workers claim, commit and offer: what becomes of every event under leases with fencing."""
    kind = F.when(F.col("event_type") == "signup", leases.OFFER).when(F.col("event_type") == "purchase", leases.COMMIT).otherwise(leases.CLAIM)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("worker"))
    return leases.replayed(events, LEASE * 10**6)


@query("""with item as (select doc_id, row_number() over (order by doc_id) - 1 as place from documents where doc_id % 3 = 0),
ask as (select s_suppkey::varchar as worker, sum(s_suppkey % 9) over (order by s_suppkey) as stop, s_suppkey % 9 as n from supplier)
select doc_id as document_id, worker from item join ask on place >= stop - n and place < stop""")
def claimed_batches(spark, sf_dir):
    """Suppliers as workers that ask for some pending documents each: who gets which, none shared."""
    pending = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"))
    asks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("worker"), (F.col("s_suppkey") % 9).alias("n"))
    return leases.claimed(pending, asks)


STATED = "case doc_id % 4 when 0 then 'NEW' when 1 then 'EMBEDDED' when 2 then 'FAILED' else 'CHUNKS_BUILT' end"


@query(f"""select d.doc_id as document_id, d.source as source_system, count(c.vec_id) as chunks, min(c.label) as label
from documents d join embeddings c on c.vec_id % (select count(*) from documents) = d.doc_id where {STATED} = 'NEW' group by all""")
def layout_join(spark, sf_dir):
    """Chunks of the documents in one state, from tables that lie bucketed by document, the documents below folders of their state."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    stated = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_system"), F.expr(STATED).alias("status"))
    chunks = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % n).alias("document_id"), "vec_id", "label")
    tag = uuid.uuid4().hex
    stored = layout.bucketed(stated, f"documents_{tag}", new_path(spark, "bucketed"), "document_id", 16, "status")
    parts = layout.bucketed(chunks, f"chunks_{tag}", new_path(spark, "bucketed"), "document_id", 16)
    joined = stored.where("status = 'NEW'").join(parts, "document_id")
    return joined.groupBy("document_id", "source_system").agg(F.count("vec_id").alias("chunks"), F.min("label").alias("label"))


@query("""select doc_id as document_id, 0 as part, n_chars from documents where doc_id % 7 not in (0, 3)
union all select doc_id, part::int, n_chars // 2 from documents, unnest([1, 2]) as t(part) where doc_id % 7 = 0""")
def layout_replace(spark, sf_dir):
    """A table by key after every seventh document was replaced by two rows, and others were taken out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "n_chars")
    path = new_path(spark, "by-key")
    layout.stored_by_key(docs.withColumn("part", F.lit(0)), path, "document_id", 32)
    new = docs.where("document_id % 7 = 0").select("document_id", F.floor(F.col("n_chars") / 2).alias("n_chars"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))
    layout.replace_keys(spark, path, new, "document_id", 32, docs.where("document_id % 7 = 3"))
    return layout.read_by_key(spark, path).select("document_id", "part", "n_chars")


RAGGED = """'{"k": ' || coalesce(json_extract_string(props, '$.k'), 'null') || case event_type when 'click' then ', "at": {"page": ' || user_id || '}' when 'error' then ', "codes": [' || event_id || ', "x"]' when 'view' then ', "k2": "' || event_type || '"' else '' end || '}'"""


@query(f"""with r as (select event_id, ({RAGGED})::json as p from events)
select event_id, (json_extract_string(p, '$.k'))::bigint as k, (json_extract_string(p, '$.at.page'))::bigint as page, try_cast(json_extract_string(p, '$.codes[0]') as bigint) as code,
json_extract_string(p, '$.k2') as other, len(json_keys(p)) as n_keys, p::varchar like '%codes%' as has_codes from r""")
def ragged_rows(spark, sf_dir):
    """Row maps with missing, extra and nested keys, held as VARIANT and read by path."""
    events = table(spark, sf_dir, "events")
    extra = F.when(F.col("event_type") == "click", F.concat(F.lit(', "at": {"page": '), "user_id", F.lit("}")))
    extra = extra.when(F.col("event_type") == "error", F.concat(F.lit(', "codes": ['), "event_id", F.lit(', "x"]')))
    extra = extra.when(F.col("event_type") == "view", F.concat(F.lit(', "k2": "'), "event_type", F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"k": '), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), extra, F.lit("}"))
    path = new_path(spark, "ragged")
    tables.as_variant(events.select("event_id", text.alias("row_json")), "row_json", "row").write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.select(
        "event_id",
        *tables.variant_columns("row", {"k": ("$.k", "bigint"), "page": ("$.at.page", "bigint"), "code": ("$.codes[0]", "bigint"), "other": ("$.k2", "string")}),
        F.size(F.map_keys(tables.variant_map("row"))).cast("long").alias("n_keys"),
        F.try_variant_get("row", "$.codes", "string").isNotNull().alias("has_codes"),
    )


COUNTED = {"documents": ["doc_id", "n_chars"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "embeddings": ["vec_id", "label"]}


@query(" union all ".join(f"select '{t}' as table_name, '{c}' as column_name, min({c})::varchar as least, max({c})::varchar as greatest, count(*) filter ({c} is null)::varchar as nulls, (select count(*) from {t}) as n_rows from {t}" for t, columns in COUNTED.items() for c in columns))
def table_statistics(spark, sf_dir):
    """What the catalog knows of four stored tables after they were analyzed."""
    found = None
    for name, columns in COUNTED.items():
        stored = f"{name}_{uuid.uuid4().hex}"
        statistics.stored_table(table(spark, sf_dir, name).select(*columns), stored, new_path(spark, "analyzed"))
        statistics.analyze(spark, stored)
        known = statistics.column_statistics(spark, stored, columns).drop("distinct_values")
        known = known.withColumn("table_name", F.lit(name)).withColumn("n_rows", F.lit(statistics.row_count(spark, stored)).cast("long"))
        found = known if found is None else found.unionByName(known)
    return found
