"""Every graph query against its SQL, and the entry module without the optional parts."""

from __future__ import annotations

import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as engine
from graphspark.oracle import oracle_sql
from graphspark.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def same(spark_rows, sql_rows):
    columns = sorted(sql_rows.columns)
    assert columns == sorted(spark_rows.columns)
    values = lambda x: sorted(map(repr, x[columns].astype(object).values.tolist()))
    assert values(spark_rows) == values(sql_rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, DIR).toPandas(), duck.execute(oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_other_queries_place_every_node(spark, name):
    found = QUERIES[name](spark, DIR).toPandas()
    assert sorted(found["node"]) == list(range(200)) and found["part"].between(0, 19).all()


def test_entry(spark):
    assert engine.entry(spark).columns == ["batch", "node", "pos", "value"]


def test_entry_module_without_the_optional_parts(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(engine)
        assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(engine)
