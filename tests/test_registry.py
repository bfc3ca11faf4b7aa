"""Every registered query against its oracle on the smallest tables, and the shape of plans."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def in_order(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, tables, name):
    result = registry.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    found = in_order(result.select(columns).collect())
    if name not in ORACLES:
        assert found
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = tables.execute(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall()
    assert found == in_order(expected)


def test_entry(spark):
    assert registry.entry(spark).count() == 18


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_reference_is_not_shuffled_when_reads_are_broadcast(spark):
    plan = plan_of(registry.queries()["align_all"](spark, SF_DIR))
    tree = plan.split("\n\n")[0]
    assert "BroadcastHashJoin" in tree and "Python" not in tree and "SortMergeJoin" not in tree
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    # One exchange spreads the single-file scan of the test table, one combines equal reads.
    assert tree.count("+- Exchange") == 2


def test_ranking_is_a_hash_aggregate_with_one_exchange(spark):
    hits = spark.createDataFrame([(1, 2, 3, 39, 0, True)], "read_id bigint, ref_id bigint, ref_start bigint, ref_end bigint, differences int, is_rc boolean")
    from strandjoin.operators.select import unambiguous

    tree = plan_of(unambiguous(hits, 3)).split("\n\n")[0]
    assert tree.count("HashAggregate") == 2 and tree.count("Exchange") == 1
    assert "SortAggregate" not in tree
