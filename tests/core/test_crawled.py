"""Publications as a data source: pushed filters spare pages, a stream goes on where it ended."""

import json

import pytest

from folio.sources.crawled import register


class Site:
    """Index pages and issues as files, so that they are fetched by file:// addresses."""

    def __init__(self, folder):
        self.folder = folder
        self.listed = {"smp": [], "fsr": []}

    def publish(self, name, year, month):
        page = self.folder / name / str(year) / month
        page.mkdir(parents=True)
        (page / "page.html").write_text(f"<h1>{name} {month} {year}</h1>")
        self.listed[name].insert(0, f"{name}/{year}/{month}/page.html")  # the newest first
        (self.folder / f"{name}.html").write_text("".join(f'<a href="{x}">issue</a><a href="/other">no</a><a href="{x}">again</a>' for x in self.listed[name]))

    @property
    def options(self):
        return {"sources": json.dumps([[n, n.upper(), f"file://{self.folder}/{n}.html", rf"^{n}/\d{{4}}/"] for n in self.listed]), "batch": "2"}


@pytest.fixture
def site(tmp_path, spark):
    made = Site(tmp_path)
    for year in (2022, 2023, 2024):
        for month in ("feb", "may"):
            made.publish("smp", year, month)
        made.publish("fsr", year, "apr")
    register(spark)
    return made


def read(spark, site):
    return spark.read.format("folio_crawl").options(**site.options).load()


def test_all_pages_once(spark, site):
    got = read(spark, site).collect()
    assert len(got) == 9 and {r.html for r in got} == {f"<h1>{n} {m} {y}</h1>" for n, m in (("smp", "feb"), ("smp", "may"), ("fsr", "apr")) for y in (2022, 2023, 2024)}
    assert all(r.error is None and str(r.year) in r.url and r.doc_type == r.source.upper() for r in got)


def test_a_pushed_filter_fetches_fewer_pages(spark, site):
    for gone in [*site.folder.glob("*/2022/*/page.html"), *site.folder.glob("fsr/*/*/page.html")]:
        gone.unlink(missing_ok=True)
    # a page that is fetched all the same would be an error
    got = read(spark, site).where("year in (2023, 2024) and source = 'smp'").collect()
    assert sorted((r.year, r.error) for r in got) == [(2023, None), (2023, None), (2024, None), (2024, None)]
    assert read(spark, site).where("year = 1999").collect() == []
    assert read(spark, site).where("year > 2022 and source = 'smp'").count() == 4


def test_a_restarted_stream_reads_nothing_twice(spark, site, tmp_path_factory):
    state = tmp_path_factory.mktemp("state")
    urls = []

    def run():
        rows = spark.readStream.format("folio_crawl").options(**site.options).load()
        q = rows.writeStream.foreachBatch(lambda df, k: urls.extend(r.url for r in df.select("url").collect())).option("checkpointLocation", f"{state}").trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert len(urls) == len(set(urls)) == 9
    run()
    assert len(urls) == 9
    site.publish("fsr", 2025, "apr")
    run()
    assert len(urls) == len(set(urls)) == 10 and "2025" in urls[-1]
