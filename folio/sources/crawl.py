"""Links, metadata and files found in fetched HTML pages, as column expressions and joins."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: An anchor's address (1 or 2) and what it encloses (3).
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>(.*?)</a>"
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"
MAIN_PAGE = "https://www.rba.gov.au"


@dataclass(frozen=True)
class Source:
    """A publication: its index page, the addresses of its issues, and where its files lie."""

    name: str
    doc_type: str
    index_url: str
    issue_pattern: str
    file_prefix: str


# The publications that are followed.
SOURCES = [
    Source("Statement on Monetary Policy", "SMP", f"{MAIN_PAGE}/publications/smp/", r"^/publications/smp/\d{4}/[a-z]{3}/$", "/publications/smp/"),
    Source("Financial Stability Review", "FSR", f"{MAIN_PAGE}/publications/fsr/", r"^/publications/fsr/\d{4}/[a-z]{3}/$", "/publications/fsr/"),
    Source("RBA Annual Report", "ANNUAL_REPORT", f"{MAIN_PAGE}/publications/annual-reports/rba/", r"^/publications/annual-reports/rba/\d{4}/$", "/publications/annual-reports/rba/"),
]


def absolute(base: str, href: Column) -> Column:
    """An address seen from a base page on the same host."""
    root = "/".join(base.split("/")[:3])
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit(base.split(":")[0] + ":"), href)).when(F.startswith(href, F.lit("/")), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(urljoin(base, ".")), href))


def issue_links(pages: DataFrame, pattern: str, base: str = MAIN_PAGE + "/", html: str = "html") -> DataFrame:
    """The distinct absolute addresses (link) of the anchors that match a pattern."""
    hrefs = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1)))).alias("href"))
    return hrefs.where(F.col("href").rlike(pattern)).select(absolute(base, F.col("href")).alias("link")).distinct()


def meta_content(html: Column, name: str) -> Column:
    found = F.regexp_extract(html, rf"(?is)<meta\s[^>]*?name\s*=\s*[\"']{name}[\"'][^>]*?content\s*=\s*[\"']([^\"']*)[\"']", 1)
    turned = F.regexp_extract(html, rf"(?is)<meta\s[^>]*?content\s*=\s*[\"']([^\"']*)[\"'][^>]*?name\s*=\s*[\"']{name}[\"']", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(turned, F.lit("")))


def issue_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds title (of the metadata, else of the page, else its address) and publication_date (null unless ISO)."""
    title = F.coalesce(F.trim(meta_content(F.col(html), r"dcterms\.title")), F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.col(url))
    written = meta_content(F.col(html), r"dc\.date")
    date = F.when(written.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(written, "yyyy-M-d"))
    return pages.withColumn("title", title).withColumn("publication_date", date)


def file_candidates(pages: DataFrame, prefix: str, base: str = MAIN_PAGE + "/", key: str = "page_id", html: str = "html", kind: str = ".pdf") -> DataFrame:
    """Files that anchors of a page name: (key, file_url, link_text, position).

    An address keeps its first place and its last text.
    """
    anchors = pages.select(key, F.posexplode(F.arrays_zip(*[F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)])).alias("position", "a"))
    href = F.when(F.col("a.g1") != "", F.col("a.g1")).otherwise(F.col("a.g2"))
    text = F.nullif(F.trim(F.regexp_replace("a.g3", r"(?s)<[^>]*>", "")), F.lit(""))
    named = anchors.select(key, "position", href.alias("href"), text.alias("text")).where(F.contains(F.lower("href"), F.lit(kind)) & F.startswith(F.col("href"), F.lit(prefix)))
    return named.groupBy(key, absolute(base, F.col("href")).alias("file_url")).agg(F.max_by("text", "position").alias("link_text"), F.min("position").alias("position"))


def object_key(doc_type: Column, published: Column, url: Column) -> Column:
    """raw/<type>/<year or undated>/<file name>."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    name = F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.lit("document.pdf"))
    return F.concat_ws("/", F.lit("raw"), F.lower(doc_type), F.coalesce(F.year(published).cast("string"), F.lit("undated")), name)


def registered_title(title: Column, link_text: Column) -> Column:
    """The issue's title, with the link's text unless that only says what kind of file it is."""
    plain = F.coalesce(F.lower(link_text).isin("download pdf", "pdf"), F.lit(True))
    return F.when(plain, title).otherwise(F.concat(title, F.lit(" – "), link_text))


def shown_title(title: Column, most: int = 60) -> Column:
    """A title for display: longer ones are cut and end in three dots."""
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, most), F.lit("..."))).otherwise(title)


def registered(found: DataFrame, known: DataFrame) -> DataFrame:
    """The documents (source_url, title, doc_type, s3_key, content_hash, status) after what was fetched is registered.

    found: source_url, title, link_text, doc_type, publication_date, content_hash. Content that is known, or comes again, adds no row; of
    equal contents the least address is kept.
    """
    named = found.select("source_url", registered_title(F.col("title"), F.col("link_text")).alias("title"), "doc_type", object_key(F.col("doc_type"), F.col("publication_date"), F.col("source_url")).alias("s3_key"), "content_hash")
    new = new_content(named, known, order="source_url").withColumn("status", F.lit("NEW"))
    return known.unionByName(new.select(*known.columns))


def wanted_years(text: str, this_year: int) -> set[str]:
    """Years of a list such as "2019, 2021-2022, 2024+"; open ends reach this year, reversed ranges are turned. What is no year is skipped with a warning."""
    found: set[str] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, dash, last = part.removesuffix("+").partition("-")
        if not first.isdigit() or (part.endswith("+") and dash) or (last and not last.isdigit()):
            log.warning("no year or range of years: %r", part)
            continue
        if dash or part.endswith("+"):
            low, high = sorted((int(first), int(last) if last.isdigit() else this_year)) if dash else (int(first), this_year)
            found |= {str(y) for y in range(low, high + 1)}
        else:
            found.add(first)
    return found


def of_years(pages: DataFrame, years: set[str], url: str = "url") -> DataFrame:
    """The pages whose address has one of the years as a part; all of them if no year is given."""
    chosen = F.lit(not years)
    for y in sorted(years):
        chosen = chosen | F.contains(F.col(url), F.lit(f"/{y}/"))
    return pages.where(chosen)


def new_content(found: DataFrame, known: DataFrame, key: str = "content_hash", order: str = "document_id") -> DataFrame:
    """What is not yet known by its hash; of equal content found now, the first."""
    # an aggregation, not a window: copies of one content are reduced before the shuffle
    fresh = found.join(known.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(order, *[c for c in fresh.columns if c not in (key, order)])).alias("_first"))
    return first.select(key, "_first.*").select(*found.columns)
