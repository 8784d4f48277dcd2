"""Every registered query: same rows as its SQL, and a plan that scales."""

import re

import compare
import pytest

import __spark_entry__ as contract
from crawlspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
STREAMS = {n for n in QUERIES if n.startswith("stream_")} | {"pattern_store"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, con, name):
    difference = compare.compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert difference is None, difference


def test_contract_lists_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_learned_patterns_hold_no_domain_and_count_hits(spark):
    rows = QUERIES["learned_patterns"](spark, SF).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.signature) for r in rows)
    assert sum(r.hit_count for r in rows) > len(rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan_has_no_pairwise_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["url_parts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
