"""Every query against its DuckDB counterpart on the smallest tables, and on the shape of those without one."""

import os

import duckdb
import pandas as pd
import pytest

from folioquery import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [plain(x) for x in value]
    if pd.isna(value):
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or type(value).__name__.startswith(("int", "float")):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame):
    return sorted([[plain(v) for v in r] for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)], key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    assert len(got.columns) == len(set(got.columns))
