"""The operators' queries against their SQL on small tables."""

import glob
import os

import duckdb
import pytest

from strandline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(duck.sql(f"SELECT {quoted} FROM ({queries.oracle_sql()[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n[2:4] in ("1_", "2_", "3_")))
def test_native_plans(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD", "Cartesian"))
