"""Every registered query with SQL gives the same rows as DuckDB over the small tables."""

import datetime
import os

import duckdb
import pytest

from quakeframe.plans import catalogue


def norm(x):
    if isinstance(x, float):
        return float(f"{x:.9g}") if x == x else "nan"
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_kernel_query_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_history_with_missing_customers_equals_sql(spark, tmp_path):
    rows = spark.range(90).selectExpr("id + 3000 * (id % 3) AS c_custkey").filter("c_custkey % 7 <> 4")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = catalogue.QUERIES["history_ancestors"](spark, str(tmp_path)).select("id", "n", "total", "n_origins")
    want = con.sql(catalogue.ORACLE_SQL["history_ancestors"]).select("id, n, total, n_origins").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(not w[3] for w in want)
