"""Every query with SQL gives DuckDB's rows; the others run."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tessera import queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.SQL:
        assert rows
        return
    want = duck.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted(repr([plain(r[c]) for c in names]) for r in rows) == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
