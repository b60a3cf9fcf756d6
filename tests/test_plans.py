"""Checks on the plans that the queries give, on the smallest tables."""

import datetime as dt
import os

import pytest

from catalog import ORACLES, QUERIES
from catalog.reports import order_report
from tallybook.plans.match import match_sources
from tallybook.streaming.streams import ChangeTable
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not on this machine")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql_and_stays_in_the_jvm(spark, con, name):
    fn = QUERIES[name]
    assert compare(spark, con, FOLDER, name, fn, ORACLES.get(name)) is None
    plan = plan_of(fn(spark, FOLDER))
    for node in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize(
    "name, scans", [("collection_processed", 2), ("upsert_orders", 4), ("archive_split", 2), ("dq_quarantine", 2), ("report_three_sources", 4), ("report_fallback_key", 3), ("report_refresh", 3), ("dq_violations", 1)]
)
def test_inputs_are_not_read_again_and_again(spark, name, scans):
    assert plan_of(QUERIES[name](spark, FOLDER)).count("FileScan") <= scans


def test_the_period_reaches_all_three_scans(spark):
    days = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_extendedprice", "l_shipdate")
    start, end = dt.date(1996, 1, 1), dt.date(1996, 3, 31)
    found = match_sources(
        days, lines, lines, {"trm": "o_orderkey", "mpr": "l_orderkey", "bank": "l_orderkey"},
        {"trm": "o_totalprice", "mpr": "l_extendedprice", "bank": "l_extendedprice"}, "o_orderdate", start, end,
        mpr_date="l_shipdate", bank_date="l_shipdate", margin_days=30, orphans=True,
    )
    for line in plan_of(found.matches).splitlines():
        if "FileScan" in line:
            assert "GreaterThanOrEqual(" in line and ("o_orderdate" in line or "l_shipdate" in line)


def test_report_shuffles_each_source_once_and_prunes(spark):
    plan = plan_of(order_report(spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    assert "IsNotNull(o_orderkey)" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_range"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_totalprice,50000.0)" in plan and "LessThan(o_totalprice,200000.0)" in plan
    window = plan_of(QUERIES["date_window_preset"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in window


def test_last_row_per_key_is_combined_before_the_shuffle(spark):
    plan = plan_of(QUERIES["latest_per_user"](spark, FOLDER))
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "partial_max" in below
    assert "Window" not in plan


def test_profile_reads_one_column_per_branch(spark):
    plan = plan_of(QUERIES["profile_lineitem"](spark, FOLDER))
    assert "Expand" not in plan
    assert plan.count("ReadSchema: struct<l_tax:double>") == 1


def test_change_table_plan_does_not_grow_with_batches(spark, tmp_path):
    table = ChangeTable(spark, f"{tmp_path}/t", "k", ["n"])
    sizes = []
    for batch in range(12):
        table.write_batch(spark.createDataFrame([(batch % 5, batch)], "k long, n long"), batch)
        if batch in (3, 11):
            plan = plan_of(table.current())
            sizes.append((plan.count("FileScan"), len(plan.splitlines())))
    assert sizes[0] == sizes[1] and sizes[0][0] == 1
    assert len(list((tmp_path / "t" / "log").iterdir())) <= 4
    table.compact()
    table.write_batch(spark.createDataFrame([(1, 99)], "k long, n long"), 12)
    changed = [line for line in plan_of(table.current()).splitlines() if "/changes" in line]
    assert changed and all("__place" in line and "GreaterThan" in line or "(__place" in line for line in changed)
    assert {r["k"]: r["n"] for r in table.current().collect()} == {0: 10, 1: 99, 2: 7, 3: 8, 4: 9}
    assert table.clean() == 12 and table.current().count() == 5


def test_fallback_and_refresh_shuffle_wide_rows_little(spark):
    assert plan_of(QUERIES["report_fallback_key"](spark, FOLDER)).count("Exchange hashpartitioning") <= 4
    assert plan_of(QUERIES["report_refresh"](spark, FOLDER)).count("Exchange hashpartitioning") <= 4
