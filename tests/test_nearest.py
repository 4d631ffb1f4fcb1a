"""Nearest edges far away, stored checks, and spots judged where their item is."""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from sitefit.catalog import load
from sitefit.operators.buckets import nearest
from sitefit.plans import fixes as fi


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_cell_that_only_the_box_of_an_edge_covers_bounds_nothing(spark):
    # the slanting edge is enumerated in the point's own cell, which it does not touch; the nearest edge is four cells off
    edges = spark.createDataFrame([(0, "road", 60.0, 315.0, 315.0, 60.0), (0, "road", 200.0, 1.0, 200.0, 1.0)], "site_id long, object_type string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(0, 7, 1.0, 1.0)], "site_id long, item_id long, x double, y double")
    assert [tuple(r) for r in nearest(points, edges, "item_id", "object_type").collect()] == [(0, 7, "road", 199.0)]


def test_nearest_of_every_kind_equals_all_pairs(spark, tables):
    from sitefit.functions.geom import segment_distance

    c = F.col
    points, edges = tables.items.filter("site_id = 0").select("site_id", "item_id", "x", "y"), tables.edges.filter("site_id = 0")
    got = {(r.item_id, r.object_type): r.dist for r in nearest(points, edges, "item_id", "object_type").collect()}
    pairs = points.join(edges, "site_id").withColumn("d", segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2")))
    assert got == {(r.item_id, r.object_type): r.d for r in pairs.groupBy("item_id", "object_type").agg(F.min("d").alias("d")).collect()}


def test_checks_are_worked_out_once(spark):
    for name in ("export_summary", "trace", "report_tables"):
        assert "Generate" not in plan(load()[0][name](spark, SMALL))


def test_spots_are_not_shuffled(spark, tables):
    movers = tables.items.filter("site_id = 0 and planting_type = 'tree'")
    found = fi.legal_spots(movers, tables.items, tables.edges, tables.outline)
    assert "spot" not in " ".join(re.findall(r"hashpartitioning\([^)]*\)", found._jdf.queryExecution().executedPlan().toString()))
    assert found.groupBy("item_id", "spot").count().filter("count > 1").isEmpty() and not found.isEmpty()
