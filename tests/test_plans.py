"""Plan regressions: the physical plans keep the shapes the design relies on."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()      # final AQE plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["charges", "storage_charges", "bill_summary", "repack_status",
                                  "labor_needed", "invoice_lines", "combine_reports", "run_totals"])
def test_no_pairwise_or_python_nodes(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for node in FORBIDDEN:
        assert node not in plan, f"{name} plan contains {node}"


def test_charges_plan_shape(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")   # full ReadSchema text
    plan = _plan(E.queries()["charges"](spark, SF))
    assert "WindowGroupLimit" in plan                      # one-row-per-key limited before shuffle
    assert plan.count("BroadcastHashJoin") >= 2            # exact + GIRO rate lookups
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert schema.count(":") <= 6                      # no wide scans
