"""Every registered query beside its SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare
from millrace.operators.backfill import key_overlap
from millrace.queries import ORACLE, QUERIES
from millrace.session import session_conf

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    names = sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*[f"`{n}`" for n in names]).collect()]
    answer = con.execute(f"SELECT * FROM ({ORACLE[name]}) q")
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in answer.fetchall()]
    assert compare(names, got, want) in ("", "inexact floats")


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_entry_names_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_without_the_optional_parts(tmp_path):
    """The library, without its one subpackage that may be absent and the pipeline, still imports and lists its queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))]


def test_key_overlap_of_tables_too_large_to_broadcast(spark):
    """Both sides are joined by sorting, and the target is a union of joins on the key."""
    orders = spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/orders.parquet")
    both = orders.select("o_orderkey", "o_custkey").join(orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    target = both.where("o_orderstatus <> 'O'")
    want = [tuple(orders.selectExpr("count_if(o_orderstatus = 'P')", "count_if(o_orderstatus = 'O')").first())]
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        got = key_overlap(both.where("o_orderstatus <> 'F'"), target.unionByName(target), ["o_orderkey"]).collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("name, joins", [("b5_promote_merge", 3), ("b6_promote_append", 3)])
def test_promotes_join_only_to_merge(spark, name, joins):
    """A left join, a semi join and an anti join; what they read is filtered, not joined."""
    assert QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins


def test_top_values_of_every_column(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    assert {r[0] for r in QUERIES["p2_top_values"](spark, SF_DIR).select("column_name").distinct().collect()} == set(lines.columns)
