"""No side of a join that grows with the data is broadcast by an estimate."""

import re

import pytest
from conftest import SMALL

from sitefit.catalog import load


@pytest.mark.parametrize("name", ["recipe_norms", "explain_rejection", "export_summary", "revalidate_scoped", "accent_layout", "score_features"])
def test_growing_join_sides_are_not_broadcast_by_estimates(spark, name):
    # the plan as made before anything is measured; joins with rulebook tables are not on sites or plans
    plan = load()[0][name](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"(\w+Join) \[(?:site_id|plan_id)#", plan)
    assert joins and "BroadcastHashJoin" not in joins
