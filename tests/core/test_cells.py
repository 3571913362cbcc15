"""The inverted-file index: equal to the full scan, with a high recall on few cells, and reading only those."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.indexes import cells
from folio.operators import vectors
from folio.sources import shared


def planted(n, size, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    v = centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, size))
    v[n // 2 : n // 2 + n // 3] = v[0]  # a third of all rows is one vector
    return [(int(i), [float(x) for x in v[i]]) for i in range(n)]


ODD = [(90_001, None), (90_002, [0.0] * 16), (90_003, [float("nan")] * 16), (90_004, [1.0, 2.0]), (90_005, [None] * 16), (90_006, [float("inf")] + [0.0] * 15)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(planted(1500, 16, 12, 3) + ODD, "chunk_id long, embedding array<double>").repartition(5)


def asked(rows, every=20):
    return rows.where(f"chunk_id % {every} = 0 or chunk_id > 90000").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def as_set(df):
    return {(r.query_id, r.rank, r.chunk_id, r.distance) for r in df.collect()}


@pytest.mark.parametrize(("block", "group", "n"), [(20_000, 2000, None), (60, 7, 20), (100, 5, 1)])
def test_exact_is_the_full_scan(spark, rows, tmp_path, monkeypatch, block, group, n):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "ASKED", group)
    index = cells.build(rows, f"{tmp_path}/index", cells=n)
    usable = rows.where(cells.finite(F.col("embedding"), 16))
    want = as_set(vectors.top_k_of_many(usable, asked(usable), 10))
    assert len(want) == 10 * asked(usable).count()
    assert as_set(cells.search(index, asked(rows), 10, probes=2, exact=True)) == want
    again = cells.opened(spark, f"{tmp_path}/index")
    assert as_set(cells.search(again, asked(rows), 10, probes=1, exact=True)) == want


def test_few_cells_find_nearly_all_and_only_they_are_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    v = centres[rng.integers(0, 30, 4000)] + 0.5 * rng.normal(size=(4000, 32))
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    index = cells.build(rows, f"{tmp_path}/index")
    probes = cells.probes_for(index, 10)
    assert probes < len(index.centres) / 4
    want, got = as_set(vectors.top_k_of_many(rows, asked(rows), 10)), as_set(cells.search(index, asked(rows), 10, probes=probes))
    assert len({(q, c) for q, _, c, _ in want} & {(q, c) for q, _, c, _ in got}) >= 0.95 * len(want)
    one = asked(rows).limit(1)
    plan = cells.search(index, one, 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if "PartitionFilters: [cell" in x]
    assert filters and all(" IN (" in x or "= " in x for x in filters)
    assert index.sizes.sum() == 4000 and (index.sizes > 0).sum() > 20


def test_more_than_there_is_and_nothing(spark, rows, tmp_path):
    few = rows.where("chunk_id < 5")
    index = cells.build(few, f"{tmp_path}/few")
    got = cells.search(index, asked(few, 1), 10, probes=1, exact=True).collect()
    assert len(got) == 25 and {r.rank for r in got} == {1, 2, 3, 4, 5}
    none = cells.build(rows.where("chunk_id > 90001"), f"{tmp_path}/none")
    assert cells.search(none, asked(few, 1), 3, exact=True).collect() == []


def test_a_query_goes_once_to_each_shelf_of_cells(spark, tmp_path, monkeypatch):
    """However many cells there are, the search deals as many rows as there are queries and shelves, and finds the rows of a full scan."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)] + [(900 + i, [1.0] * 16) for i in range(60)], "chunk_id long, embedding array<double>")
    index = cells.build(rows, f"{tmp_path}/index", cells=40)
    want = as_set(vectors.top_k_of_many(rows, asked(rows), 10))
    n, dealt = asked(rows).count(), []

    def kept(df, name):
        out = shared.kept(df, name)
        dealt.append(out.count() if name == "probes" else 0)
        return out

    monkeypatch.setattr(cells, "kept", kept)
    assert as_set(cells.search(index, asked(rows), 10, probes=4, exact=True)) == want
    assert 0 < sum(dealt) <= 2 * n
    # a large cell in blocks, shelves of a few cells, few queries and few distances at once
    monkeypatch.setattr(cells, "BLOCK", 30)
    index = cells.build(rows, f"{tmp_path}/blocks", cells=40)
    monkeypatch.setattr(cells, "ASKED", 7)
    monkeypatch.setattr(cells, "PAIRS", 50, raising=False)
    assert as_set(cells.search(index, asked(rows), 10, probes=4, exact=True)) == want
    assert as_set(cells.search(index, asked(rows), 10, probes=40)) == want
