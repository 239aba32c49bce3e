"""Plan shape checks: joins, shuffles, pushdown, no Python in the hot path."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from parcelgrid.plans import QUERIES

PY_OPS = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonMapInArrow", "FlatMapGroupsInPandas")
PY_ALLOWED = {"q_score_texts"}  # the files that q_photo_tree and q_listing_files read were written before
MODEL = {"q_gbt", "q_early_stop", "q_model_report"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_unvisited_houses_has_no_nested_loop(spark):
    plan = _final_plan(entry.queries()["q_unvisited_houses"](spark, SF_SMALL))
    final = plan.split("== Initial Plan ==")[0]
    assert "NestedLoop" not in plan
    assert final.count("LeftAnti") >= 2  # the URL anti join may be pushed into both union branches


def test_stop_prefix_single_exchange_for_windows(spark):
    from parcelgrid.operators.paging import stop_prefix
    from parcelgrid.plans.events_standin import visits
    from parcelgrid.session import table

    v = visits(table(spark, SF_SMALL, "events"))
    plan = stop_prefix(v).filter("kept")._jdf.queryExecution().executedPlan().toString()
    # one exchange for the visit aggregate (tile, page) and one for the windows (tile);
    # the branch of pages over the cap is dropped, as none of them is kept
    assert plan.count("Exchange hashpartitioning") == 2


def test_range_filter_is_one_scan(spark):
    plan = _plan(entry.queries()["q_range_filter"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan


def test_bound_sets_are_pushed_to_the_scan(spark):
    from parcelgrid.operators.reshape import listing_filter, listing_filter_sets
    from parcelgrid.session import table

    part, cols = table(spark, SF_SMALL, "part"), {"size": "p_size", "price": "p_retailprice"}
    one = _plan(listing_filter(part, {"min_size": 10, "max_price": 950.0}, cols))
    assert "PushedFilters: [IsNotNull(p_size), IsNotNull(p_retailprice), GreaterThanOrEqual(p_size,10)" in one
    sets = [(1, {"min_size": 40}), (2, {"max_size": 3, "max_price": 950.0})]
    assert "PushedFilters: [Or(GreaterThanOrEqual(p_size,40)" in _plan(listing_filter_sets(part, sets, cols))


def test_folds_scan_once(spark):
    plan = _plan(QUERIES["q_folds"](spark, SF_SMALL))
    assert "FileScan" not in plan and "Subquery" not in plan  # the rows and their total come from the checkpointed ranges


def test_rejects_are_counted_by_the_pass_that_reads(spark):
    plan = _plan(QUERIES["q_first_wins"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1 and "CollectMetrics" in plan


def test_scans_prune_columns(spark):
    plan = _plan(entry.queries()["q_unvisited_tiles"](spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL))
def test_no_python_outside_dom_query(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    has_py = any(op in plan for op in PY_OPS)
    assert has_py == (name in PY_ALLOWED)


def test_tile_totals_multiply_no_rows(spark):
    assert "Expand" not in _plan(QUERIES["q_tile_counts"](spark, SF_SMALL))


def test_score_pages_are_filtered_before_python(spark):
    plan = _plan(QUERIES["q_score_texts"](spark, SF_SMALL))
    assert "Filter" in plan.split("MapInPandas")[1]
