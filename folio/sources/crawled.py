"""Publications as a data source: after `register(spark)`, `spark.read.format("folio_crawl")`, or `readStream` for what is new.

An index page lists a publication's issues; each issue's page is a row. The driver reads the index pages, a few; issues are fetched by
tasks, those of one host in partitions of `batch` (option) links. A filter on `year` or `source` that is
pushed down spares the pages of all others.

As a stream, the offset of a publication is how many of its issues have been read, the oldest first: an index
is expected to grow at one end. A stream that is started again goes on behind its last offset, and reads nothing twice.

Options: sources, JSON [[name, doc_type, index_url, issue_pattern], ...] (else the known publications); batch; fetcher, "module:function".
A page that can't be fetched is a row with an error.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from folio.sources.crawl import HREF, SOURCES

SCHEMA = "source string, doc_type string, year int, url string, html string, error string"
YEAR = re.compile(r"/((?:19|20)\d{2})/")


class Links(InputPartition):
    """Issues of a publication: (source, doc_type, links)."""

    def __init__(self, source: str, doc_type: str, links: list[str]):
        super().__init__((source, doc_type, links))
        self.source, self.doc_type, self.links = source, doc_type, links


def year_of(url: str) -> int | None:
    m = YEAR.search(url)
    return int(m[1]) if m else None


class Crawl:
    """What both readers share: the publications, and how pages are fetched."""

    def __init__(self, options: dict):
        given = json.loads(options["sources"]) if "sources" in options else [[s.name, s.doc_type, s.index_url, s.issue_pattern] for s in SOURCES]
        self.sources = [tuple(x) for x in given]
        self.batch = int(options.get("batch", "16"))
        self.fetcher = options.get("fetcher", "folio.sources.fetch:get")

    def fetch(self, url: str) -> str:
        module, name = self.fetcher.split(":")
        return getattr(importlib.import_module(module), name)(url).decode("utf-8", "replace")

    def issues(self, index_url: str, pattern: str) -> list[str]:
        """The distinct links of an index page that match, the oldest (the last listed) first."""
        hrefs = re.findall(HREF, self.fetch(index_url))
        found = dict.fromkeys(urljoin(index_url, h) for h in hrefs if re.search(pattern, h))
        return list(found)[::-1]

    def cut(self, source: str, doc_type: str, links: list[str]) -> list[Links]:
        return [Links(source, doc_type, links[k : k + self.batch]) for k in range(0, len(links), self.batch)]

    def rows(self, partition: Links) -> Iterator[tuple]:
        from folio.providers import with_retries

        for url in partition.links:
            html = error = None
            try:
                html = with_retries(lambda url=url: self.fetch(url), 2)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
            yield partition.source, partition.doc_type, year_of(url), url, html, error


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.crawl = Crawl(options)
        self.years: set[int] | None = None
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("year",):
                self.years = values if self.years is None else self.years & values
            elif values is not None and f.attribute == ("source",):
                self.names = values if self.names is None else self.names & values
            else:
                yield f

    def partitions(self) -> list[Links]:
        out = []
        for name, doc_type, index_url, pattern in self.crawl.sources:
            if self.names is None or name in self.names:
                links = self.crawl.issues(index_url, pattern)
                out += self.crawl.cut(name, doc_type, [u for u in links if self.years is None or year_of(u) in self.years])
        return out or [Links("", "", [])]

    def read(self, partition: Links) -> Iterator[tuple]:
        return self.crawl.rows(partition)


class PagesStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.crawl = Crawl(options)

    def initialOffset(self) -> dict:
        return {name: 0 for name, *_ in self.crawl.sources}

    def latestOffset(self) -> dict:
        return {name: len(self.crawl.issues(index_url, pattern)) for name, _, index_url, pattern in self.crawl.sources}

    def partitions(self, start: dict, end: dict) -> list[Links]:
        out = []
        for name, doc_type, index_url, pattern in self.crawl.sources:
            if end.get(name, 0) > start.get(name, 0):
                out += self.crawl.cut(name, doc_type, self.crawl.issues(index_url, pattern)[start.get(name, 0) : end[name]])
        return out

    def read(self, partition: Links) -> Iterator[tuple]:
        return self.crawl.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class CrawledPages(DataSource):
    """The source that `register` makes known to a session."""

    @classmethod
    def name(cls) -> str:
        return "folio_crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets filters be pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrawledPages)
