"""The policy log is read once by each table that is made of it."""

import os

import pytest

from millrace.plans import log
from millrace.plans.policy import policy_log

SF_DIR = os.environ.get("MILLRACE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_timer_changes_read_the_log_once(spark):
    changes = policy_log(spark, SF_DIR).timer_changes
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert {r.active for r in changes.select("active").distinct().collect()} == {True, False}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_tasks_of_a_log_grow_with_its_rows(spark, monkeypatch):
    rows = sorted(map(tuple, log.event_log(spark, SF_DIR).collect()))
    monkeypatch.setattr(log, "ROWS_A_TASK", len(rows) // 20)
    dealt = log.event_log(spark, SF_DIR)
    assert dealt.rdd.getNumPartitions() >= 20 and sorted(map(tuple, dealt.collect())) == rows
    assert "Exchange" not in dealt._jdf.queryExecution().executedPlan().toString().split("Window")[0]
