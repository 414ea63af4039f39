"""What the plans of the corpus operators must and must not hold."""

import pytest

from relspark.llm import queries as corpus
from relspark.plans.explain import facts, plan_text


@pytest.mark.parametrize("name", ["op5_secret_scan", "op7_source_mix"])
def test_native_operators_run_no_python(spark, sf, name):
    p = facts(corpus.queries()[name](spark, sf))
    assert not p.python and not p.cartesian


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_quality"])
def test_map_only_operators_do_not_shuffle(spark, sf, name):
    assert facts(corpus.queries()[name](spark, sf)).exchanges == 0


@pytest.mark.parametrize(("name", "columns"), [("op4_decontaminate", {"doc_id", "text"}), ("op2_url_filter", {"page_id", "url"})])
def test_only_needed_columns_are_read(spark, sf, name, columns):
    assert set(facts(corpus.queries()[name](spark, sf)).read_columns) == columns


def test_hot_digests_can_be_split(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(corpus.queries()["op9_exact_dedup"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = text[text.index("SortMergeJoin") :]
    assert join.count("ENSURE_REQUIREMENTS") >= 2
