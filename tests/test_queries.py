"""Every registered query against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

from rankweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str(tuple(plain(r[k]) for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    if name not in catalog.ORACLE_SQL:
        assert data
        return
    relation = con.execute(catalog.ORACLE_SQL[name])
    expected = rows([d[0] for d in relation.description], relation.fetchall())
    assert rows(got.columns, data) == expected
