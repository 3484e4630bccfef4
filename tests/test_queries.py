"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from voxlake import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rel = db.sql(registry.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in rel.columns)) for r in df.collect()) == sorted(str(tuple(r)) for r in rel.fetchall())


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_greedy_dedup_against_loop(spark):
    rows = registry.points(spark, SF).orderBy("label", "point_id").collect()
    kept = []
    for r in rows:
        if all(k.label != r.label or (k.x - r.x) ** 2 + (k.y - r.y) ** 2 + (k.z - r.z) ** 2 >= 0.01 for k in kept):
            kept.append(r)
    assert {(r.label, r.line_idx) for r in registry.greedy_dedup(spark, SF).collect()} == {(r.label, r.point_id) for r in kept}
