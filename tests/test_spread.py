"""Which side of a distance join is written out to the cells in reach, and what the selection is made of."""

import random

from pyspark.sql import functions as F

from sitefit.operators import buckets
from sitefit.operators import proximity as px


def test_features_write_out_points_not_edges(tables, monkeypatch):
    reaches, plain = [], buckets.to_cells
    monkeypatch.setattr(buckets, "to_cells", lambda edges, size, reach: reaches.append(reach) or plain(edges, size, reach))
    edges = px.grouped_edges(tables.edges, tables.outline)
    px.distance_matrix(tables.reference_trees, edges, "ref_id")
    px.counts_within(tables.reference_trees, edges, "ref_id")
    assert reaches == [0.0, 0.0]


def test_selection_equals_sequential_pass(spark):
    from sitefit.operators import select

    rng = random.Random(3)
    points = [(0, "tree", k // 2, rng.randrange(6000) / 100.0, rng.randrange(6000) / 100.0, rng.randrange(50) / 10.0) for k in range(400)]
    # no two rows of one id and score, so that the order is fixed
    points = list({(p[2], p[5]): p for p in points}.values())
    df = spark.createDataFrame(points, "site_id long, planting_type string, cand_id long, x double, y double, score double")
    got = sorted(r.cand_id for r in select.greedy_select(df).collect())
    kept = []
    for p in sorted(points, key=lambda p: (-p[5], p[2])):
        if all(((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) ** 0.5 >= 5.0 - select.SPACING_EPS_M for q in kept):
            kept.append(p)
    assert got == sorted(p[2] for p in kept)


def test_selection_reads_its_candidates_once(spark):
    from sitefit.operators.select import greedy_select

    seen = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda v: seen.add(1) or v, "double")
    rows = spark.range(50).select(F.lit(0).cast("long").alias("site_id"), F.lit("tree").alias("planting_type"), F.col("id").alias("cand_id"),
                                  F.col("id").cast("double").alias("x"), touch(F.col("id").cast("double")).alias("y"), F.lit(0.5).alias("score"))
    greedy_select(rows).collect()
    assert seen.value == 50


def test_palette_of_a_repeated_plan_without_sorting_plans(spark):
    from sitefit.operators.rulebook import species_palette

    plans = spark.createDataFrame([(1, "tree,shrub"), (2, "tree"), (2, "tree")], "plan_id long, planting_types string")
    got = species_palette(plans)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {}
    for r in got.orderBy("plan_id", "planting_type", "rank").collect():
        rows.setdefault((r.plan_id, r.planting_type), []).append(r.species)
    assert set(rows) == {(1, "tree"), (1, "shrub"), (2, "tree")} and all(len(v) == 3 for v in rows.values())
    once = [r.species for r in species_palette(plans.limit(2).filter("plan_id = 2")).orderBy("rank").collect()]
    assert len(set(rows[1, "tree"])) == 3 and (not once or rows[2, "tree"] == [once[0], once[0], once[1]])


def test_edge_counts_without_making_edges(spark):
    from sitefit.sources import geojson as gj

    texts = [(1, '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}'),
             (2, '{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[1,1]]],[[[9,9],[8,9],[9,9]]]]}}'),
             (3, '{"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[],[[0,0],[1,1]]]}}')]
    found = gj.typed(gj.from_texts(spark.createDataFrame(texts, "k long, feature string")), "what", {})
    made = {r.k: r["count"] for r in gj.edges_of(found, "k").groupBy("k").count().collect()}
    assert {r.k: r.n for r in found.select("k", gj.edge_count(found.parts).alias("n")).collect()} == made == {1: 1, 2: 7, 3: 1}
