"""Every registered query beside its SQL on the smallest tables, and what its plan must not hold."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare
from tests.conftest import SMALL, plan_of


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


#: Operators of optional subpackages have their own tests.
QUERIES_HERE = [n for n, f in queries().items() if f.__module__.startswith("workload.")]


@pytest.mark.parametrize("name", QUERIES_HERE)
def test_query_equals_sql(spark, connection, name):
    verdict, count, _ = compare(spark, connection, SMALL, name)
    assert verdict in ("ok", "rows only"), verdict
    assert count > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert {n for n in queries() if n in QUERIES_HERE} <= set(oracle_sql())


LAZY = [n for n in QUERIES_HERE if not n.startswith((
    "stream_", "batch_", "submission_fanout", "queue_router", "visit_intake", "log_index_search", "kpi_from_stored", "landed_"))]


@pytest.mark.parametrize("name", LAZY)
def test_plans_stay_in_the_engine(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEvalPython"):
        assert unwanted not in plan


def test_pages_are_ranked_by_ranges(spark):
    """No window holds a whole group: rows are numbered within (group, range)."""
    plan = plan_of(queries()["answers_nested"](spark, SMALL))
    ranked = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert ranked and all("[question#" in line and "_range#" in line.split("], [")[1] for line in ranked)


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(queries()["tech_trends"](spark, SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
    plan = plan_of(queries()["visit_total"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "ReadSchema: struct<event_type:string>" in plan
