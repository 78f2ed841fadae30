"""Registered operators against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from verdara.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLES[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    plain = lambda v: tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v
    rows = lambda frame: sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=str)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_operator_runs(spark, name):
    made = queries.QUERIES[name](spark, SF)
    assert made.count() > 0 or name == "op6_decontaminate"
