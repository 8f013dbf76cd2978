"""Filters on fields and times of tables reach the scan, and only the columns used are read."""

import re
from pathlib import Path

import pytest

from tallylog import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name, pushed", [
    ("field_match", "EqualTo(event_type,error)"), ("promoted_columns", "EqualTo(event_type,error)"), ("ts_gt", "GreaterThan(ts,2024-01-15T10:00)"),
    ("ts_between", "LessThan(ts,2024-01-11T00:00)"), ("last_window", "GreaterThanOrEqual(ts,2024-01-19T00:00)"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    plan = catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert pushed in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert "props" not in re.search(r"ReadSchema: struct<(.*?)>", plan)[1]


def test_a_trace_needs_no_map_of_fields(spark):
    plan = catalogue.QUERIES["trace_follow_many"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "map_from_entries" not in plan
