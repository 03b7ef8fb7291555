"""Physical plans: what reaches the scan, and what must not be in a plan."""

import re

import pytest

from leafmill.plans import registry
from tests.conftest import SF_DIR

#: Streams and written formats run while they are built; their plans are scans of the result.
PLANNED = [n for n in sorted(registry.QUERIES) if not n.startswith(("t_", "io_"))]


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_row_by_row_python(name, spark):
    text = plan(registry.QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in text, name


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["q_pricing_summary"](spark, SF_DIR))
    assert "LessThanOrEqual(l_shipdate" in text
    assert "l_orderkey" not in text.split("ReadSchema")[1].split("\n")[0]
    text = plan(registry.QUERIES["j_semi"](spark, SF_DIR))
    assert "GreaterThan(l_quantity,49.0)" in text


def test_groups_are_limited_before_the_shuffle(spark):
    text = plan(registry.QUERIES["w_top_k"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") >= 2


def test_partition_filters_prune_folders(spark):
    text = plan(registry.QUERIES["io_partitioned"](spark, SF_DIR))
    assert "PartitionFilters: [isnotnull(o_orderstatus" in text


def test_steps_cut_a_hot_key(spark):
    text = plan(registry.QUERIES["j_asof_steps"](spark, SF_DIR))
    assert re.search(r"hashpartitioning\(k#\d+L?, step#\d+L?,", text)
