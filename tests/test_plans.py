"""Plan guards over every registered query: no cartesian / nested-loop joins,
no row-at-a-time Python UDFs, pruned scans."""

import re

import pytest

import __spark_entry__ as E
from conftest import sf_dir

MODEL_QUERIES = {"lr_scores", "rf_scores", "model_sweep", "kernel_svm_scores", "feature_importance", "overfit_gap"}
NAMES = sorted(set(E.queries()) - MODEL_QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    plan = E.queries()[name](spark, sf_dir("0.001"))._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"
    for schema in re.findall(r"ReadSchema: (struct<[^\n]*)", plan):
        assert schema.count(":") <= 12, f"{name}: wide scan {schema[:80]}"
