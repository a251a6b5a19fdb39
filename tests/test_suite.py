"""Every query of the core library against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from granary.plans import suite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = suite.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(suite.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def test_name_hashes_against_a_loop(spark, sf):
    """One-at-a-time, byte by byte."""
    for r in suite.QUERIES["name_hashes"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        h = 0
        for b in r.url.lower().encode():
            h = (h + b) & 0xFFFFFFFF
            h = (h + (h << 10)) & 0xFFFFFFFF
            h ^= h >> 6
        h = (h + (h << 3)) & 0xFFFFFFFF
        h ^= h >> 11
        assert r["hash"] == (h + (h << 15)) & 0xFFFFFFFF


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
