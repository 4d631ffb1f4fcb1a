"""Queries against their check SQL on the smallest input; SITEFIT_ALL=1 runs every one of them."""

import os

import pytest
from conftest import SMALL
from oracle_check import compare, connect

from sitefit.catalog import load

QUERIES, ORACLES = load()
QUICK = ("checks", "binding", "resolve_setback", "point_in_polygon", "self_nearest", "classify_layer", "plan_diff", "edit_fold", "greedy_select",
         "chain_order", "split_clauses", "node_segments", "points_along", "density_cap", "combine_holes")
NAMES = sorted(ORACLES) if os.environ.get("SITEFIT_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    ok, message = compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])
    assert ok, message


def test_every_query_has_a_reason_or_a_check():
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name].__doc__, name
