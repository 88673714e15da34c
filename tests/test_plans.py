"""Plan lint: no registered query may plan a cartesian product or a nested-loop join."""

import pytest

from tests.conftest import SF_SMALL
from tessera.plans import REGISTRY

MODEL = {"model_compare", "permutation_importance"}


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in MODEL])
def test_no_cartesian_or_nested_loop(spark, name):
    plan = REGISTRY[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan[:2000]


def test_scans_are_pruned(spark):
    plan = REGISTRY["conditional_share"].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in plan
