"""Every query with a SQL twin gives the same rows in Spark and in DuckDB."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not re.match(r"op\d|pipeline", n)]


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in duck.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, duck.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
