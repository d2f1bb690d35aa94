"""Every registered query next to its SQL check, and the shape of its plan."""
import pytest

from check import compare
from crestline.plans.registry import ORACLES, QUERIES

# Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    result = compare(spark, duck, sf, name)
    assert result.startswith(("ok", "rows")) or (result == "EMPTY" and name in MAY_BE_EMPTY), result


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_pairwise_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_filter_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["optional_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,PROMO)" in plan and "p_name" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["diversity_topk", "numbered_topk", "kit_fill", "rank_capped"])
def test_top_k_is_cut_before_the_shuffle(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_window_features_need_two_shuffles(spark, sf):
    plan = QUERIES["window_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["rank_capped", "type_coverage"])
def test_tables_of_windows_are_not_broadcast(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("index#" in line or "bin#" in line)]
