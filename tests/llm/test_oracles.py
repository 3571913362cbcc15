"""The corpus queries with SQL against DuckDB."""

import os

import pytest

from folio.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_vector_sql_on_planted_links(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        v = rng.normal(size=64)
        rows += [(10 * k + i, (v + rng.normal(size=64) * rng.choice([0, 0.05, 0.12])).astype("f4").tolist(), k % 3 if k % 7 else None) for i in range(rng.integers(1, 8))]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in QUERIES["op10_vectors"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(con.execute(f"select vec_id, n_links, component_id, kept from ({ORACLE_SQL['op10_vectors']})").fetchall())
    assert len(want) == len(rows) and sum(w[1] for w in want) > 100 and len(got & want) >= 0.97 * len(want)
