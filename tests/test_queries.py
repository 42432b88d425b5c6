"""Every query against the same query as SQL in another engine, on whole tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from webloom.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, (bool, type(None), str)):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6) if math.isfinite(value) else str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def other():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return db


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, other, name):
    found = QUERIES[name](spark, SF_DIR)
    told = other.execute(ORACLE[name])
    columns = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, told.fetchall())
