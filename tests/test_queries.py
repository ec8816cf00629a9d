"""Every engine query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from strandline import queries
from strandline.operators import motif

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(duck.sql(f"SELECT {quoted} FROM ({queries.ORACLE[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert queries.entry(spark).count() > 0


def test_plans_push_down(spark):
    plan = queries.QUERIES["extract_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_extendedprice" not in plan and "Exchange" not in plan
    assert "PushedFilters: [In(l_returnflag, [R,r])]" in plan or "In(l_returnflag" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    seqs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("sequence"))
    plan = motif.find(seqs, "CACA")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    plan = queries.QUERIES["region_except"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
