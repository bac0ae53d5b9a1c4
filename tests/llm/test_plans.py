"""The native operators run no Python, and no operator pairs rows by nested loops."""

from __future__ import annotations

import pytest

from fathomer.llm.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_license_scan", "op6_quality_rules"])
def test_native_operators_run_no_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op")])
def test_no_operator_has_a_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
