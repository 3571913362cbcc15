r"""The chunker and the headings as SQL for DuckDB: a recursive query that walks each document from cut to cut."""

from __future__ import annotations

SPACE = "[\\s\\p{Z}\\x1c-\\x1f\\x85]"
# What marks a table, what one begins with, subjects of headings.
MARKS = ["|", "table", "row count:", "columns:", "caption:"]
STARTS = ["table", "|", "caption:"]
SUBJECTS = "['inflation','labour market','economic outlook','forecast','gdp','unemployment','wages','financial conditions','housing','consumption','investment','trade','monetary policy']"
NL = "chr(10)"
BLANK = "chr(10) || chr(10)"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> ''))"


def paragraph(at: str, w: int) -> str:
    """Behind the first blank line around a place, else behind the first line, else the place."""
    low = f"greatest(0, {at} - {w})"
    region = f"text[{low} + 1 : least(size, {at} + {w})]"
    return f"case when contains({region}, {BLANK}) then {low} + strpos({region}, {BLANK}) + 1 when contains({region}, {NL}) then {low} + strpos({region}, {NL}) else {at} end"


def cut(at: str, w: int) -> str:
    """Where to cut near a place, out of tables if one is near."""
    region = f"low[greatest(0, {at} - {w}) + 1 : least(size, {at} + {w})]"
    marked = " or ".join(f"contains({region}, '{m}')" for m in MARKS)
    behind = f"text[{at} + 1 : least(size, {at} + {2 * w})]"
    begin = f"greatest(0, {at} - {2 * w})"
    before = f"low[{begin} + 1 : {at}]"
    gaps = []
    for m in STARTS:
        start = f"(length({before}) - strpos(reverse({before}), reverse('{m}')) + 1 - {len(m)})"
        lead = f"text[{begin} + 1 : {begin} + {start}]"
        gaps.append(f"case when contains({before}, '{m}') and contains({lead}, {BLANK}) then {begin} + length({lead}) - strpos(reverse({lead}), {BLANK}) + 1 end")
    table = f"case when contains({behind}, {BLANK}) then {at} + strpos({behind}, {BLANK}) + 1 else coalesce({', '.join(gaps)}, {paragraph(at, w)}) end"
    return f"case when {marked} then {table} else {paragraph(at, w)} end"


def quality(x: str) -> str:
    n, w, ends = f"length({x})", words(x), f"(length({x}) - length(regexp_replace({x}, '[.!?]', '', 'g')))"
    odd = f"length(regexp_replace({x}, '[\\p{{L}}\\p{{N}}\\s\\p{{Z}}\\x1c-\\x1f\\x85]', '', 'g'))"
    rate = f"{w} / greatest(1, {ends})"
    return f"""case when {n} < 10 then 0.0::double else
 (case when {w} = 0 then 1.0 when {rate} > 100 then 0.7 when {rate} < 5 then 0.8 else 1.0 end)::double
 * (case when {w} < 50 then 0.6 when {w} > 2000 then 0.9 else 1.0 end)::double * (case when {odd} / {n} > 0.3 then 0.7 else 1.0 end)::double end"""


NUMBERED = "^(\\d+(?:\\.\\d+){0,2})[.:]?\\s+(.{3,80})"
LABELLED = "(?i)^(chapter|section|appendix|box)\\s+([a-z0-9]+)[.:]?\\s+(.{3,80})"
LED = "^([^\\n]{3,80}):\\s"


def titled(x: str) -> str:
    """Every run of letters with a capital first."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), lambda z: upper(z[1]) || lower(z[2:])), '')"


def as_heading(x: str) -> str:
    part = lambda pattern, k: f"regexp_extract({x}, '{pattern}', {k})"
    letters, capitals = f"length(regexp_replace({x}, '\\P{{L}}', '', 'g'))", f"length(regexp_replace({x}, '\\P{{Lu}}', '', 'g'))"
    return f"""case when regexp_matches({x}, '{NUMBERED}') then {part(NUMBERED, 1)} || ' ' || {stripped(part(NUMBERED, 2))}
 when regexp_matches({x}, '{LABELLED}') then {titled(part(LABELLED, 1))} || ' ' || {part(LABELLED, 2)} || ' ' || {stripped(part(LABELLED, 3))}
 when {letters} > 0 and {words(x)} <= 10 and {capitals} >= 0.7 * {letters} then {titled(x)} end"""


def heading(text: str) -> str:
    """The first of ten lines that is a heading, else what stands before a colon."""
    lines = f"list_transform(list_filter(string_split_regex({text}[1:800], '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85]'), lambda y: {stripped('y')} <> ''), lambda y: trim(y, ' -' || chr(9)))[1:10]"
    found = f"list_filter(list_transform({lines}, lambda x: {stripped(as_heading('x'))}), lambda h: h is not null and h <> '')[1]"
    lead = stripped(f"regexp_extract({text}[1:800], '{LED}', 1)")
    return f"coalesce({found}, case when regexp_matches({text}[1:800], '{LED}') then coalesce({as_heading(lead)}, {lead}) end)"


def subject_heading(text: str) -> str:
    subject = f"len(list_filter({SUBJECTS}, lambda s: contains(lower(x), s))) > 0"
    return f"""list_filter(list_transform(string_split({text}[1:500], {NL})[1:5], lambda x: {stripped('x')}),
 lambda x: x <> '' and ((({subject}) and {words('x')} <= 6) or regexp_matches(x, '^\\d+[.)]\\s+[A-Z]')))[1]"""


def forward(to: str) -> str:
    return f"case when {to} > start then {to} else least(start + 100, size) end"


def chunks(pages: str) -> str:
    """CTEs that end in `chunk`, over `pages`: a table (document_id, page_number, clean_text)."""
    sentences = f"list_filter(list_transform(string_split_regex(piece, '[.!?]\\s+'), lambda x: {stripped('x')}), lambda x: x <> '')"
    overlap = f"(case when len({sentences}) <= 2 then length(piece) else length({sentences}[-2]) + length({sentences}[-1]) + 3 end)"
    return f"""whole as (select document_id, list(clean_text order by page_number) as pages from {pages} group by document_id),
lines_of as (select document_id, pages, array_to_string(pages, ' ') as text from whole),
paged as (
  select document_id, text, case when length(lower(text)) = length(text) then lower(text) else text end as low, length(text) as size,
         list_transform(range(1, len(pages) + 1), lambda i: coalesce(list_sum(list_transform(pages[1:i - 1], lambda x: length(x) + 1)), 0)::bigint) as starts, pages
  from lines_of
),
walk as (
  select document_id, 0::bigint as start, 0::bigint as stop, null::varchar as piece, 0::bigint as next from paged
  union all
  select document_id, start, stop, piece, case when piece <> '' and stop - {overlap} > start then stop - {overlap} else stop end::bigint
  from (
    select document_id, start, case when {words('piece')} > 921.6 then stop2 else stop end::bigint as stop,
           case when {words('piece')} > 921.6 then {stripped('text[start + 1 : stop2]')} else piece end as piece
    from (
      select *, {stripped('text[start + 1 : stop]')} as piece
      from (select *, {forward('cut1')} as stop, {forward('cut2')} as stop2
            from (select *, {cut('target', 200)} as cut1, {cut('(start + 3072)', 100)} as cut2
                  from (select p.document_id, text, low, size, next as start, least(next + 3456, size) as target from walk join paged p on p.document_id = walk.document_id where next < size)))
    )
  )
),
judged as (select document_id, start, stop, piece as text, {quality('piece')} as quality from walk where piece <> ''),
chunk as (
  select j.document_id, (row_number() over (partition by j.document_id order by start) - 1)::int as chunk_index,
         greatest(1, len(list_filter(starts, lambda s: s <= start)))::int as page_start,
         least(len(pages), len(list_filter(range(1, len(pages) + 1), lambda i: starts[i] + length(pages[i]) < stop)) + 1)::int as page_end,
         j.text, coalesce({subject_heading('j.text')}, {heading('j.text')}) as section_hint, quality
  from judged j join paged p on p.document_id = j.document_id where quality >= 0.5
)"""
