"""Every query of the catalogue against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__
from rows import agree, duck
from weftline import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, small, name):
    agree(catalog.queries()[name](spark, small), duck(small), catalog.oracle_sql()[name])


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["word", "n"]


def test_every_core_query_is_registered():
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["map_scalar", "chain_three", "wordcount_global", "active_calls", "chunk_plan_size"])
def test_native_plans_hold_no_python(spark, small, name):
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_projection_prunes_columns(spark, small):
    plan = catalog.queries()["map_scalar"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
