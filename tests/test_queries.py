"""Every registered query against its DuckDB equivalent on the small tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_an_equivalent():
    assert set(QUERIES) == set(ORACLE) and ORACLE.items() <= oracle_sql().items()


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_is_sorted(spark):
    times = [r.timestamp_ns for r in entry(spark).select("timestamp_ns").collect()]
    assert times and times == sorted(times)


@pytest.mark.parametrize("name, costly", [("recycle_events", "unhex("), ("task_events", "regexp_extract_all(")])
def test_filters_hold_no_copies_of_costly_columns(spark, name, costly):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert costly in plan and not [line for line in plan.split("\n") if line.strip(" +-:").startswith("Filter") and costly in line]
