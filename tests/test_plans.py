"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from fixture_queries.registry import QUERIES

from covermart.operators import monthly as mo
from covermart.operators import reviews as rv
from covermart.operators.scope import Scope, scope_filter
from fixture_queries.tables import policies


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairing_python_or_single_task_windows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "EvalPython"):
        assert forbidden not in plan
    lines = plan.split("\n")
    for place, line in enumerate(lines):
        if re.search(r"[+:]- Window ", line):
            assert "SinglePartition" not in "\n".join(lines[place : place + 5])


def test_year_filter_prunes_folders_and_columns(spark, sf_dir):
    scoped = scope_filter(policies(spark, sf_dir), Scope(1996, 1997, {"payers": ("X",)}))
    plan = plan_of(rv.payer_network_premium(scoped))
    assert re.search(r"PartitionFilters: \[[^\]]*uw_year#\d+ >= 1996", plan)
    assert "PushedFilters: [IsNotNull(payer_name), EqualTo(payer_name,X)]" in plan
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert set(schemas) == {"payer_name:string,network_type:string,gross_premium_usd:double"}


def test_monthly_series_never_explodes_policies(spark, sf_dir):
    """Months are spread only above the aggregated runs, not below an aggregate of policies."""
    plan = plan_of(mo.monthly_kpis(policies(spark, sf_dir)))
    spread = plan.index("explode(sequence(first_month")
    assert "Aggregate" in plan[spread:]
    assert plan.count("explode(sequence(first_month") == 1
