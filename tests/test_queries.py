"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(d[0] for d in cur.description) == columns
    place = {d[0]: k for k, d in enumerate(cur.description)}
    want = sorted("|".join(shown(r[place[c]]) for c in columns) for r in cur.fetchall())
    got = sorted("|".join(shown(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
