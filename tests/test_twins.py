"""Every named query against its SQL twin on the smallest tables, and its plan."""

import pytest

import __spark_entry__ as entry
from tools import check_twins as K

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return K.open_tables(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    verdict, _, _, note = K.compare(spark, con, SF, name, entry.queries()[name], SQL.get(name))
    assert verdict != "DIFF" and not note, note


@pytest.mark.parametrize("name", ["cmi_bucket_metrics", "conversion_report", "rolling_window", "threshold_sweep", "youden", "term_alignment", "gate_arm_table"])
def test_plan_has_no_pairwise_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["hash_split"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
