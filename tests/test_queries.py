"""Queries of the graph beside their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from tools import compare
from trailweave import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, db, name):
    assert compare.compare(plans.queries()[name](spark, SF), db, plans.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


def test_report_single_ranks_once(spark):
    """Ranks are written, so that no task sorts for ranks and for the report's lines at once."""
    plan = plans.queries()["report_single"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "DESC NULLS LAST" not in plan and "pivotfirst" not in plan.lower()
