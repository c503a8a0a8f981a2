"""Every query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from pagequarry.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(float(r[i]), 5) if isinstance(r[i], float) else r[i] for i in at]) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    # those without SQL are held against Python in test_headings.py
    assert name in ORACLES or name in ("gap_markers", "inline_breaks") and got
    if name in ORACLES:
        want = db.execute(ORACLES[name])
        assert sorted(df.columns) == sorted(d[0] for d in want.description)
        assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())
