"""Plans: filters and columns reach the scan, and no query joins without a key."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    from statuta.operators import retrieval, store
    from statuta.runtime import read

    results = read(spark, FOLDER, "search_results")
    shown = plan(store.lookup(results, "x").select("chunk_id", "cfr_citation"))
    assert "EqualTo(chunk_id,x)" in shown and re.search(r"ReadSchema: struct<chunk_id:string,cfr_citation:string>", shown)
    kept = read(spark, FOLDER, "points").where(retrieval.predicate({"part_number": "101"})).select("point_id")
    assert "EqualTo(part_number,101)" in plan(kept) and "cfr_dense" not in plan(kept).split("ReadSchema")[1]
    nested = plan(results.select("metadata.section_number"))
    assert "ReadSchema: struct<metadata:struct<section_number:string>>" in nested


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p6_found", "change_detection", "label_path", "severity_report", "xref_expand", "definition_lookup"])
def test_no_join_without_a_key(spark, name):
    shown = plan(driver.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
