"""Every registered query with SQL gives the same rows in Spark and in DuckDB, with the same column names."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tablemill import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v)
    return str(v)


def normal(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert normal(df.select(*cols).collect()) == normal([tuple(r[i] for i in at) for r in want.fetchall()])


def test_a_customer_with_very_many_orders_keeps_them_all(spark, tmp_path):
    c = duckdb.connect()
    # customer 1 has 1500 orders of one year and type, customer 2 some of several
    c.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, CASE WHEN i < 1500 THEN 1 ELSE 2 END AS o_custkey, CASE WHEN i < 1500 THEN 'F' ELSE ['F', 'O', 'P'][1 + i % 3] END AS o_orderstatus, TIMESTAMP '1998-03-01' AS o_orderdate FROM range(1510) t(i)")
    c.execute("CREATE TABLE customer AS SELECT i AS c_custkey FROM range(1, 4) t(i)")
    for t in ("orders", "customer"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT PARQUET)")
    got = queries.QUERIES["priority_type_filter"](spark, str(tmp_path)).select("qid", "doc_id").collect()
    assert sum(r["qid"] == 1 for r in got) == 1500
    assert normal(map(tuple, got)) == normal(c.execute(queries.SQL["priority_type_filter"]).fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
