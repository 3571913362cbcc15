"""A page is searched by the next finder only if the one before found nothing good."""

from folio.plans.ingest import accepted_tables, scanned_tables

GRID = [["Measure", "2024"], ["GDP", "2.1"], ["Wages", "3.2"]]
WORDS = [["a", "b"], ["c", "d"], ["e", "f"]]


def test_the_first_good_flavour_counts(spark):
    pages = spark.createDataFrame([(1, p) for p in range(5)], "document_id int, page_number int")
    found = {"lattice": {0: [(GRID, 99.0), (GRID, 80.0)], 1: [(GRID, 50.0)], 2: [(WORDS, 99.0)]}, "stream": {p: [(GRID, 75.0)] for p in range(4)}}
    asked = {}

    def find(rest, flavour):
        asked[flavour] = sorted(r.page_number for r in rest.collect())
        rows = [(1, p, g, a, None, None) for p in asked[flavour] for g, a in found[flavour].get(p, [])]
        return spark.createDataFrame(rows, "document_id int, page_number int, grid array<array<string>>, accuracy double, caption string, bbox array<double>")

    got = sorted((r.page_number, r.flavour, r.accuracy) for r in scanned_tables(pages, find).collect())
    assert got == [(0, "lattice", 80), (0, "lattice", 99), (1, "stream", 75), (2, "stream", 75), (3, "stream", 75)]
    assert asked == {"lattice": [0, 1, 2, 3, 4], "stream": [1, 2, 3, 4]}


def test_headers_are_looked_for_once(spark):
    found = spark.createDataFrame([(1, 1, GRID, 80.0), (1, 2, WORDS, 99.0), (1, 3, GRID, 50.0)], "document_id int, page_number int, grid array<array<string>>, accuracy double")
    good = accepted_tables(found)
    # the pattern of leading zeros stands in the rule for header rows alone
    assert good._jdf.queryExecution().optimizedPlan().toString().count("^0+") == 1
    assert [(r.page_number, r.headers, r.rows) for r in good.collect()] == [(1, GRID[0], GRID[1:])]
