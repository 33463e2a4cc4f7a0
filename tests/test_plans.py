"""What the physical plans of the main jobs must and must not contain."""

from __future__ import annotations

import os
import re

import pytest

from millrace.queries.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason=f"{SF_DIR} is not there")


def plan_of(df, final: bool = False) -> str:
    if final:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0] if final else text


@pytest.mark.parametrize(
    "name",
    ["route_rules", "allow_semi_join", "deny_anti_join", "batch_assignment", "ship_batches",
     "dispatch", "scan_plan", "resume_lines"],
)
def test_no_join_without_an_equal_key(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["match_on"](spark, SF_DIR))
    assert "props" not in plan.split("ReadSchema:")[1].splitlines()[0]
    assert "Exchange" not in plan and "Python" not in plan


def test_lines_are_scanned_once_to_count_and_once_to_ship(spark):
    plan = plan_of(QUERIES["ship_batches"](spark, SF_DIR), final=True)
    assert plan.count("FileScan") == 2
    assert "ReusedExchange" in plan


def test_framing_carries_only_the_key_along(spark):
    plan = plan_of(QUERIES["frame_lines"](spark, SF_DIR))
    assert re.search(r"-1\)\), \[doc_id#\d+L\], false, \[", plan), plan
