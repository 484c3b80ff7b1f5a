"""Distances of every vector to the mean, against numpy and the query's SQL."""

import numpy as np
import pytest


def test_distances_cover_the_whole_table(spark):
    from terramosaic.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    want = dict(zip([r["vec_id"] for r in rows], np.linalg.norm(x - x.mean(axis=0), axis=1), strict=True))
    got = {r["vec_id"]: r for r in QUERIES["f16_distance_to_mean"](spark, sf).collect()}
    assert got.keys() == want.keys() and len(got) == len(rows) > 20
    for k, dist in want.items():
        assert got[k]["dist"] == pytest.approx(dist, abs=1e-5) and got[k]["squared"] == pytest.approx(dist**2, abs=1e-5)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.execute(ORACLE_SQL["f16_distance_to_mean"]).fetchall()) == [pytest.approx(tuple(got[k]), abs=2e-5) for k in sorted(got)]
