"""Every registered query against its oracle, on the small tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value.is_integer() else f"{value:.9g}"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    found = [tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(found, key=lambda r: tuple("" if v is None else v for v in r))


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())
