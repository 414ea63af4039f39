"""Plans that have to hold at any size: pushed filters, pruned columns, no stray shuffles."""

import pytest

from relspark.plans.explain import facts
from relspark.queries import queries


def plan(spark, sf, name):
    return facts(queries()[name](spark, sf))


@pytest.mark.parametrize(
    ("name", "column", "columns"),
    [("scan_predicate", "o_totalprice", {"o_orderkey", "o_totalprice"}), ("index_point", "o_orderkey", {"o_orderkey", "o_custkey", "o_totalprice"}), ("filter_between", "l_quantity", {"l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"})],
)
def test_filters_and_columns_reach_the_scan(spark, sf, name, column, columns):
    p = plan(spark, sf, name)
    assert any(column in f for f in p.pushed_filters) and set(p.read_columns) == columns and p.exchanges == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_cartesian_product(spark, sf, name):
    if name.startswith(("txn", "dml")):
        pytest.skip("runs statements")
    p = plan(spark, sf, name)
    assert not p.python
    assert not p.cartesian or name == "join_cross"


def test_aggregates_combine_before_the_shuffle(spark, sf):
    from relspark.plans.explain import plan_text

    text = plan_text(queries()["agg_multi"](spark, sf))
    assert "partial_sum" in text and plan(spark, sf, "agg_multi").exchanges == 1


def test_top_k_is_not_a_global_sort(spark, sf):
    from relspark.plans.explain import plan_text

    assert "TakeOrderedAndProject" in plan_text(queries()["top_k"](spark, sf))
