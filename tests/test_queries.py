"""Every registered query beside its SQL twin, on the smallest tables, whole."""

import importlib.util

import pytest
from conftest import ROOT, SF
from pyspark.sql import functions as F

from pagegraph import session
from pagegraph.plans import all_queries, oracles
from pagegraph.plans.graph_queries import all_page_records
from pagegraph.plans.views import Views

spec = importlib.util.spec_from_file_location("compare", ROOT / "tools" / "compare.py")
tool = importlib.util.module_from_spec(spec)
spec.loader.exec_module(tool)

QUERIES, ORACLES = all_queries(), oracles()


@pytest.fixture(scope="module")
def duck():
    con = tool.connect(SF)
    yield con
    con.close()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    state, count, _, detail = tool.compare(spark, duck, SF, name, QUERIES[name], ORACLES[name])
    assert state == "ok", detail
    assert count > 0


def test_entry(spark):
    entry_spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(entry_spec)
    entry_spec.loader.exec_module(module)
    df = module.entry(spark)
    assert df.columns[0] == "item" and df.count() > 0


def test_no_task_gets_more_rows_than_stated(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    table = spark.read.parquet(SF + "/customer.parquet")
    sizes = session.spread(table).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 150 and max(r["count"] for r in sizes) <= 25
    plan = all_page_records(Views(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(10)" in plan


def test_equal_differences_are_dealt_over_tasks(spark):
    df = QUERIES["flagship_days_diff"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = next(line for line in plan.splitlines() if "rangepartitioning(" in line)
    assert "DESC NULLS LAST, item#" in dealt and "gil_link#" in dealt
