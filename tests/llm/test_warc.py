import hashlib

from folio.llm import warc

LONG = "<p>é</p>" * 200
ROWS = [(1, "http://a/1", LONG), (2, "http://a/2 \r\nX: y", LONG), (3, None, LONG), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 1000), (9, "u", "x" * 1000), (9, "u", "x" * 1000), (10, "u", "x" * 999), (11, "u", "x" * 999), (None, "n", "\r\n\r\nWARC/1.1\r\n\r\n"), (12, "u", "y" * 3_000_000)]


def expected():
    out = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        top = max(p for p, _, h in ROWS if p is not None and (h or "") == (html or "")) if len(raw) >= 1000 else None
        revisit = top is not None and top != page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, offset int").repartition(3)
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted(expected(), key=key)


def test_selected_payloads(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    index = warc.write_archives(pages)
    assert index.count() == len(ROWS) and index.where("url = 'http://a/2%20%0D%0AX:%20y' and record_type = 'revisit'").count() == 1
    got = warc.read_records(index.where("url = 'http://a/4'"), payloads=True).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(4, b"short")]


def test_ranges():
    assert [(a, b, len(c)) for a, b, c in warc.ranges([(0, 10), (10, 5), (15, 5), (15 + (1 << 20), 7)])] == [(0, 20, 3), (15 + (1 << 20), 22 + (1 << 20), 1)]


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
