"""Registered queries against their oracles on the smallest tables, and checks of their plans."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
# Long chains of small jobs; one of each kind runs here, all of them in oracle_check.py.
LONG = ("D1", "H", "S15", "J7", "J8", "J9", "E5", "A28")
SHOWN = ("D1_shared", "D12_city_percentiles", "H3_fill", "H7_city_values")
NAMES = [n for n in entry.oracle_sql() if not n.startswith(LONG) or n.startswith(SHOWN)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_it_needs(spark):
    text = plan(spark, "S1_table_scan")
    assert "GreaterThanOrEqual(l_quantity,49.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in text


@pytest.mark.parametrize("name", ["A4_level_rollup", "A5_country_share", "J5_nearest_reference", "J10_theta_rank",
                                  "D1_shared_draws", "D6_class_draws", "E4_sewer_chain", "I5_bootstrap_multiplicity"])
def test_no_pairwise_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_nearest_reference_needs_no_shuffle_beyond_the_role(spark):
    assert plan(spark, "J5_nearest_reference").count("Exchange hashpartitioning") == 0


@pytest.mark.parametrize("name,key", [("A14_iqr_audit", ""), ("I4_balanced_weights", ""),
                                      ("J10_theta_rank", "Country")])
def test_wide_tables_are_not_dealt_out_by_their_groups(spark, name, key):
    """Without static broadcasting, as at scale, only what was summed up before is exchanged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(spark, name).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("BroadcastHashJoin" in line for line in lines)
    for line, child in zip(lines, lines[1:]):
        if f"Exchange hashpartitioning({key}" in line:
            assert "HashAggregate" in child, child


def test_orders_as_a_pool_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "J11_drawn_pool_slot")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for part in text.split("BroadcastExchange")[1:]:
        assert "orders.parquet" not in part
