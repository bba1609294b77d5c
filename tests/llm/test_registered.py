"""Registered queries against their SQL, and what is registered."""

import duckdb
import pytest

from tests.llm.conftest import same
from tidemark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    same(df, want, df.columns)


def test_all_queries_run_on_the_small_tables(spark):
    for name, build in QUERIES.items():
        if name not in ("pipeline", *ORACLE):
            assert build(spark, SF).count() > 0
