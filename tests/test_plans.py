"""What the physical plans must and must not contain."""

import os
import re

import pytest

from __spark_entry__ import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith("stream_")))
def test_no_cross_joins_and_no_row_at_a_time_python(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)


@pytest.mark.parametrize("name", ["deck_generate", "catalog_search_topk", "supporting_cards"])
def test_top_k_is_limited_before_the_exchange(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan_of(queries()[name](spark, FOLDER)))


def test_synergistic_cards_are_limited_without_an_exchange(spark):
    """Cards meet lists that lie by request already: the limit stands where they meet, and no card is exchanged."""
    plan = plan_of(queries()["synergistic_cards"](spark, FOLDER))
    above = plan[: plan.index("WindowGroupLimit")]
    assert "Exchange hashpartitioning" not in above and plan.count("WindowGroupLimit") >= 2


def test_scans_read_only_what_a_query_needs(spark):
    plan = plan_of(queries()["collection_totals"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "p_name" not in plan
