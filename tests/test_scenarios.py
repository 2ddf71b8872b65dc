"""A few scenario queries against their SQL; tools/check.py runs all of them."""

from __future__ import annotations

import os
import re

import pytest

from scenarios import all_oracles, all_queries
from scenarios.validation import sales_sheet
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ("v13_table_counts", "v05_conflict_pairs", "v09_self_reference", "p12_profile_imports", "m17_one_to_one", "c07_load_order", "g12_column_names",
         "o11_insert_text", "s01_csv_grid", "a03_merged_sources", "l04_counters", "t02_gap_free_numbers")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, name):
    state, n, _, note = compare(spark, connect(SF), name, all_queries()[name], all_oracles()[name], SF)
    assert state == "ok", note


def test_registry_is_consistent():
    assert set(all_oracles()) <= set(all_queries())
    assert all(re.match(r"^[acglmopstv]\d\d_[a-z0-9_]+$", n) for n in all_queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", ("v10_valid_lineitem", "v11_rejected_rows", "t02_gap_free_numbers", "g02_segments", "m17_one_to_one"))
def test_no_single_task_stage_over_rows(spark, name):
    plan = all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_order_text_is_made_once_an_order(spark):
    """The sheet's order text is made before the line items multiply it."""
    plan = sales_sheet(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan[:plan.index("Join")]
