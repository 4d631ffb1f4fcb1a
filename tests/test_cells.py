"""Cells written out from lines equal those found by joining every cell."""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from sitefit.catalog import load
from sitefit.operators import area as ar
from sitefit.operators import compliance as co


def test_written_out_cells_equal_joined_ones(tables):
    outline, edges = tables.outline.filter("site_id = 0"), tables.edges.filter("site_id = 0")
    cells = ar.site_grid(outline, 5.0).cache()
    for kind in ("tree", "lawn"):
        got = set(map(tuple, ar.grid_blockers(cells, edges, outline, kind, 5.0).collect()))
        assert got and got == set(map(tuple, ar.blocker_cells(cells, edges, outline, kind).collect()))
    got = sorted(map(tuple, ar.grid_clearance(cells, edges, outline, "tree", step=5.0).collect()))
    assert got == sorted(map(tuple, ar.clearance(cells, edges, "tree", "cell_id").collect()))


def test_cells_of_the_grid_are_not_joined_with_the_outline(spark):
    plan = load()[0]["site_grid"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(cell_id|cx)", plan)


def test_reasons_written_out_equal_measured_ones(tables):
    outline, edges = tables.outline.filter("site_id = 0"), tables.edges.filter("site_id = 0")
    cells = ar.site_grid(outline, 10.0)
    for kind in ("tree", "lawn"):
        spots = cells.select("site_id", "cell_id", "x", "y", F.lit(kind).alias("planting_type"), F.lit("").alias("species")).cache()
        got = sorted(map(repr, co.grid_reasons(cells, edges, outline, kind, 10.0).collect()))
        assert got and got == sorted(map(repr, co.spot_reasons(spots, edges, outline).collect()))


def test_spots_are_not_joined_with_edges(spark):
    plan = load()[0]["spot_reasons_by_site"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*cx", plan)
