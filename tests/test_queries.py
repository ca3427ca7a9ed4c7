"""Every registered query against its SQL in DuckDB, and properties of the plans."""

import os

import pytest

import __spark_entry__
from check import compare, connect
from eventlake.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, name)
    assert ok is not False, note


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLES) == set(QUERIES)


# Writes to a folder first; the plan shown is that of reading back.
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("sql_join_range",)])
def test_no_cartesian_product(spark, name):
    if name in ("stream_equals_batch", "store_roundtrip", "adhoc_views", "store_quarantine"):
        pytest.skip("covered by the parts it is made of")
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name.startswith(("detect", "corr", "asof", "coerce", "route")):
        assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["detect_multi_rule", "detect_rule_join", "detect_contains", "findings"])
def test_detection_is_one_pass_without_shuffle(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
