"""Physical plans: no pairwise joins, no Python where built-ins do, pruned scans, pruned top lists."""

import re

import pytest

from tallyspark.plans.queries import QUERIES

# NFKC has no built-in.
PYTHON = {"compatibility_keys"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join_and_no_python(spark, small, name):
    p = plan(QUERIES[name](spark, small))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", p)
    assert name in PYTHON or not re.search("Python|Pandas|Arrow", p)


def test_scans_read_only_what_is_needed(spark, small):
    p = plan(QUERIES["win_loss_by_year"](spark, small))
    assert {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", p) for c in s.split(",")} == {"o_custkey", "o_orderstatus", "o_orderdate"}


def test_filters_reach_the_scan(spark, small):
    p = plan(QUERIES["facet_filter"](spark, small))
    assert "In(o_orderstatus" in p and "EqualTo(o_orderpriority,1-URGENT)" in p


def test_top_lists_are_pruned_before_the_shuffle(spark, small):
    p = plan(QUERIES["top_n_sum"](spark, small))
    assert p.count("WindowGroupLimit") == 2
