"""Extracted tables: cells, headers, renderings, captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import tables as t
from folio.operators import context, status
from folio.plans import ingest
from folio.plans.registry import registry
from folio.sources.schemas import table
from folio.sources.shared import kept

QUERIES, ORACLE_SQL, query = registry()

#: Nations by region as tables of two columns.
NATIONS = """(select r.r_regionkey as id, r.r_name as caption, ['n_nationkey', 'n_name'] as headers, list([n.n_nationkey::varchar, n.n_name] order by n.n_nationkey) as rows from region r join nation n on n.n_regionkey = r.r_regionkey group by all)"""


def nation_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("row", F.struct(F.col("n_nationkey").alias("k"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("v")))
    rows = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["v"]).alias("rows"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("caption"))
    return rows.join(names, "id").withColumn("headers", F.array(F.lit("n_nationkey"), F.lit("n_name")))


@query(f"select id, 'Table: ' || caption || chr(10) || chr(10) || '| n_nationkey | n_name |' || chr(10) || '| ' || repeat('-', 11) || ' | ' || repeat('-', 6) || ' |' || chr(10) || array_to_string(list_transform(rows, lambda r: '| ' || r[1] || ' | ' || r[2] || ' |'), chr(10)) as markdown from {NATIONS}")
def markdown_table(spark, sf_dir):
    return nation_tables(spark, sf_dir).select("id", t.markdown(F.col("headers"), F.col("rows"), F.col("caption")).alias("markdown"))


@query(
    f"""with w as (select *, greatest(11, list_max(list_transform(rows[1:5], lambda r: length(r[1])))) as a, greatest(6, list_max(list_transform(rows[1:5], lambda r: length(r[2])))) as b from {NATIONS}),
h as (select *, rpad('n_nationkey', a::int, ' ') || ' | ' || rpad('n_name', b::int, ' ') as head from w)
select id, '  ' || head || chr(10) || '  ' || repeat('-', length(head)) || chr(10) || array_to_string(list_transform(rows[1:5], lambda r: '  ' || rpad(r[1], a::int, ' ') || ' | ' || rpad(r[2], b::int, ' ')), chr(10)) || case when len(rows) > 5 then chr(10) || '  ... (' || (len(rows) - 5) || ' more rows)' else '' end as preview from h"""
)
def table_preview(spark, sf_dir):
    return nation_tables(spark, sf_dir).select("id", t.preview(F.col("headers"), F.col("rows")).alias("preview"))


@query(
    f"""with k as (select *, len(list_filter(rows[1:3], lambda r: regexp_matches(r[2], '[0-9%$]'))) > 0 as numeric from {NATIONS})
select id, 'Financial/Economic Table (Page ' || id || ')' || chr(10) || caption || chr(10) || array_to_string(list_transform(rows, lambda r: case when numeric then '  ' || r[1] || ' — n_name: ' || r[2] else '  ' || r[2] || ' — n_nationkey: ' || r[1] end), chr(10)) as text from k"""
)
def table_to_text(spark, sf_dir):
    return nation_tables(spark, sf_dir).select("id", t.semantic_text(F.col("headers"), F.col("rows"), F.col("caption"), F.col("id")).alias("text"))


CELLS = "(select distinct unnest(string_split_regex(text, '[ \\n]')) as value from documents)"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n]")).alias("value")).distinct()


@query("select doc_id, replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), chr(65533), ''), '\\0', '') as cell from documents")
def cell_clean(spark, sf_dir):
    """Whole texts cleaned as cells."""
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_cell(F.col("text")).alias("cell"))


DIGITS = "trim(translate(value, '.-%,+', ''))"


@query(f"""select value, regexp_matches({DIGITS}, '^\\d+$') and (contains(value, '.') or length(regexp_replace({DIGITS}, '^0+', '')) <= 2) as data_number,
trim(value) <> '' and regexp_matches(translate(trim(value), '.-%,', ''), '^\\d+$') as number from {CELLS}""")
def numeric_cell(spark, sf_dir):
    """All distinct words of the documents, judged as cells."""
    v = F.col("value")
    return cells(spark, sf_dir).select("value", t.is_data_number(v).alias("data_number"), t.is_number(v).alias("number"))


@query(f"select id, len(list_filter(flatten(rows[1:10]), lambda v: trim(v) <> '' and regexp_matches(translate(trim(v), '.-%,', ''), '^\\d+$'))) / len(flatten(rows[1:10])) >= 0.3 as numeric from {NATIONS}")
def numeric_content(spark, sf_dir):
    return nation_tables(spark, sf_dir).select("id", t.has_numbers(F.col("rows")).alias("numeric"))


@query(
    f"""select id, ['n_nationkey', 'n_name', 'n_name_1', 'Col_3'] as headers, rows from (select id, list_transform(rows, lambda r: [r[1], r[2], r[2], '']) as rows from {NATIONS})"""
)
def header_detect(spark, sf_dir):
    """Grids with a row of units and a header row on top, and what they become; cells of the body are numbers first."""
    grid = F.concat(
        F.array(F.array(F.lit("Per cent"), F.lit(""), F.lit(""), F.lit("")), F.array(F.lit("n_nationkey"), F.lit("n_name"), F.lit("n_name"), F.lit(""))),
        F.transform("rows", lambda r: F.array(r[0], r[1], r[1], F.lit(""))),
    )
    # body rows of words only would read as headers: the first two rows decide here
    top = t.with_headers(F.slice(grid, 1, 2))
    return nation_tables(spark, sf_dir).select("id", top["headers"].alias("headers"), F.slice(grid, 3, 1000).alias("rows"))


BLOCKS = "(select doc_id as document_id, 1 as page_number, 20 * i as bottom, l[i] as text, 20 * len(l) + 10 as top from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents)))"
WS = "list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')"


@query(f"""with b as (select *, {WS} as w from {BLOCKS} where top - bottom < 100 and trim(text) <> ''),
c as (select document_id, bottom, trim(text) as text from b where starts_with(lower(trim(text)), 'table ') or (len(w) between 2 and 15 and len(list_filter(w, lambda x: regexp_matches(translate(x, '.,-%', ''), '^\\d+$'))) / len(w) < 0.3))
select d.doc_id as document_id, max_by(c.text, c.bottom) as caption from documents d left join c on c.document_id = d.doc_id group by 1""")
def caption_match(spark, sf_dir):
    """The nearest line above a table at the end of each document that reads like a caption."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.split("text", "\n").alias("lines"))
    blocks = d.select("document_id", "page_number", F.posexplode("lines").alias("at", "text")).withColumn("bottom", ((F.col("at") + 1) * 20).cast("double"))
    on_page = d.select("document_id", "page_number", F.col("document_id").alias("table_id"), (F.size("lines") * 20 + 10).cast("double").alias("top"))
    return context.captions(on_page, blocks).select("document_id", "caption")


@query("select o_orderkey as document_id, count(l.l_orderkey) as tables from orders left join lineitem l on l.l_orderkey = o_orderkey group by 1")
def doc_table_counts(spark, sf_dir):
    """Line items of every order, none included."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    return status.table_counts(docs, parts).select("document_id", "tables")


@query("""with t as (select l_returnflag, case when l_discount < 0.01 then null else round(l_discount * 1000)::int end as accuracy, case when l_linestatus = 'O' then '' else l_linestatus end as caption from lineitem)
select l_returnflag, count(*) as total, count(*) filter (accuracy >= 95) as high, count(*) filter (accuracy >= 80 and accuracy < 95) as medium, count(*) filter (accuracy < 80) as low,
round(count(*) filter (accuracy >= 95) * 100.0 / count(*), 4)::double as high_percent, round(count(*) filter (accuracy >= 80 and accuracy < 95) * 100.0 / count(*), 4)::double as medium_percent, round(count(*) filter (accuracy < 80) * 100.0 / count(*), 4)::double as low_percent,
count(*) filter (coalesce(length(caption), 0) > 0) as captioned from t group by 1""")
def accuracy_bands(spark, sf_dir):
    """Bands of accuracy in one pass; unknown accuracy is in none."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_discount") >= 0.01, F.round(F.col("l_discount") * 1000).cast("int")).alias("accuracy"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("caption"))
    return status.accuracy_bands(li, "l_returnflag")


@query("""with t as (select l_orderkey as document_id, count(*) as n_rows from lineitem group by 1),
found as (select document_id, n_rows, 'lattice' as flavour, 60 + document_id % 40 as accuracy from t where document_id % 3 <> 0
union all select document_id, n_rows, 'stream', 65 + document_id % 35 from t),
good as (select * from found where accuracy >= 70)
select document_id, flavour, accuracy::int as accuracy, n_rows from good qualify row_number() over (partition by document_id order by flavour) = 1""")
def table_flavours(spark, sf_dir):
    """Orders as pages whose lines are a table that two finders see, with an accuracy of their own: the first that is good enough counts."""
    lines = table(spark, sf_dir, "lineitem")
    body = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice")))
    row = lambda x: F.array(F.concat(F.lit("line "), x["l_linenumber"]), x["l_quantity"].cast("string"), x["l_extendedprice"].cast("string"))
    grids = lines.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.concat(F.array(F.array(F.lit("Part"), F.lit("Quantity"), F.lit("Price"))), F.transform(body, row)).alias("grid")).withColumn("page_number", F.lit(1))
    grids = kept(grids, "grids")  # what both finders look at

    def find(pages_, flavour):
        seen = pages_.join(grids, ["document_id", "page_number"])
        key = F.col("document_id")
        if flavour == "lattice":
            seen = seen.where(key % 3 != 0)
        accuracy = (60 + key % 40 if flavour == "lattice" else 65 + key % 35).cast("double")
        return seen.select("document_id", "page_number", "grid", accuracy.alias("accuracy"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("array<double>").alias("bbox"))

    every = grids.select("document_id", "page_number")
    return ingest.scanned_tables(every, find).select("document_id", "flavour", "accuracy", F.size("rows").cast("long").alias("n_rows"))
