"""Every registered query against its DuckDB statement, and the shape of the plans."""

import pytest
from check_oracle import compare, duck

import __spark_entry__ as entry_points
from oracle import ORACLE_SQL as ORACLE
from panelflow.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_duckdb(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]).startswith("ok")


PLAIN = ["revision_pair_counts", "asof_anchor_close", "leak_scan", "forward_returns", "sector_percent_rank", "trailing_beta"]


@pytest.mark.parametrize("name", PLAIN)
def test_plans_have_no_pair_explosion_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


def test_scans_read_only_what_they_use(spark):
    plan = QUERIES["trailing_beta"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "l_returnflag" not in plan


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_events_are_combined_before_they_are_shuffled(spark):
    """A key with a third of all rows must leave a task as one row per capture."""
    plan = plan_of(spark, "revision_entered")
    assert "partial_max_by" in plan and plan.index("max_by") < plan.index("partial_max_by")
    assert "partial_min_by" in plan_of(spark, "dedupe_keep_first")


@pytest.mark.parametrize("name", ["sector_leaders", "capped_top20"])
def test_top_k_is_limited_inside_tasks(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


@pytest.mark.parametrize("name", ["cohort_weights_all", "tiered_costs_all", "book_performance_all", "book_net_alpha_all"])
def test_books_of_all_five_schemes(spark, name):
    assert {r.scheme for r in QUERIES[name](spark, SF).select("scheme").distinct().collect()} == {"S1a", "S1b", "S1c", "S2", "S3"}


def test_all_horizons_and_quarter_ends(spark):
    assert {r.horizon for r in QUERIES["drift_adjusted_all"](spark, SF).select("horizon").distinct().collect()} == {"1w", "1m", "3m"}
    ends = {r.cutoff for r in QUERIES["quarterly_regrade_all"](spark, SF).select("cutoff").distinct().collect()}
    assert {d.month for d in ends} == {3, 6, 9, 12} and all(d.day >= 30 for d in ends)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "upgrades" in df.columns
