"""The driver's contract, and every query against its DuckDB text on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandmill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted(repr(tuple(map(value, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = got.select(*cols).collect()
    if name in ORACLES:
        want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall()
        assert canon(rows) == canon(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
    here = os.path.dirname(entry.__file__)
    assert ("pipeline" in entry.queries()) == all(os.path.exists(os.path.join(here, f)) for f in ("corpus_pipeline.py", "strandmill/llm/queries.py"))
