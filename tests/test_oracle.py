"""Every registered query against its DuckDB statement on sf0.001 (whole tables)."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from framescore.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events documents embeddings labels").split()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() == 500
    assert "label" in df.columns and "value" in df.columns


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    got = df.collect()
    cur = con.execute(oracle_sql()[name])
    exp_cols = [d[0] for d in cur.description]
    exp = cur.fetchall()
    assert sorted(df.columns) == sorted(exp_cols)
    # same column types on both sides (Spark simple names -> DuckDB names)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    rel = con.sql(oracle_sql()[name])
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for f in df.schema.fields:
        assert names.get(f.dataType.simpleString()) == duck_types[f.name], (f.name, f.dataType)
    assert len(got) == len(exp)
    assert _canon([tuple(r) for r in got], df.columns) == _canon(exp, exp_cols)


def test_every_query_has_an_oracle():
    assert not set(QUERIES) - set(oracle_sql())
