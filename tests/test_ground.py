"""Ground judged strip by strip equals cells and points joined one by one."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sitefit.catalog import load, q_area
from sitefit.operators import area as ar
from sitefit.operators import ground as gr

EDGE = "site_id long, gid long, object_type string, geom_kind string, seq long, x1 double, y1 double, x2 double, y2 double"


def ring(points):
    return list(zip(points, points[1:] + points[:1]))


@pytest.fixture(scope="module")
def drawn(spark):
    """A site of several strips with a hole, a bow tie, polygons drawn twice or without an end, lines of no length and a long one."""
    outer, hole = [(0, 0), (9000, 300), (9000, 20000), (0, 19000)], [(3000, 6000), (3000, 9000), (5000, 9000), (5000, 6000)]
    outline = [(7, r, i, *p, *q, *(v / 100 for v in (*p, *q))) for r, pts in enumerate((outer, hole)) for i, (p, q) in enumerate(ring(pts))]
    outline = spark.createDataFrame(outline, "site_id long, ring long, seq long, xc1 long, yc1 long, xc2 long, yc2 long, x1 double, y1 double, x2 double, y2 double")
    shapes = [(1, "building", [(10.0, 20.0), (30.0, 20.0), (30.0, 75.0), (10.0, 75.0)]), (3, "existing_greenery", [(60.0, 100.0), (80.0, 130.0), (80.0, 100.0), (60.0, 130.0)]),
              (5, "sidewalk", [(50.0, 10.0), (54.0, 10.0), (54.0, 14.0), (50.0, 14.0)]), (7, "zoning", [(0.0, 0.0), (90.0, 0.0), (90.0, 60.0), (0.0, 60.0)])]
    edges = [(7, g, t, "polygon", i, *p, *q) for g, t, pts in shapes for i, (p, q) in enumerate(ring(pts))]
    edges += [e for e in edges if e[1] == 5]
    lines = [(2, "gas_pipe", 5.0, 5.0, 85.0, 195.0), (4, "cable_line", 20.0, 128.0, 70.0, 128.0), (6, "heat_network", 40.0, 150.0, 40.0, 150.0), (8, "tram_track", 70.0, 40.0, 70.0, 63.0)]
    edges += [(7, g, t, "line", 0, *xy) for g, t, *xy in lines] + [(7, 9, "existing_greenery", "point", 0, 15.0, 160.0, 15.0, 160.0), (7, 11, "road", "line", 0, None, 1.0, 2.0, 3.0)]
    return outline, spark.createDataFrame(edges, EDGE)


@pytest.mark.parametrize("kind", ["tree", "lawn"])
def test_strips_equal_joined_cells(drawn, kind):
    outline, edges = drawn
    cells = ar.site_grid(outline).cache()
    blocked = ar.blocker_cells(cells, edges, outline, kind).cache()
    free = ar.buildable(cells, blocked).cache()
    rows = gr.strips(gr.closing_lines(outline, edges, kind), ar.raster(outline)).cache()
    assert sorted(map(tuple, gr.open_cells(rows).collect())) == sorted(map(tuple, free.select("site_id", "cell_id").collect()))
    assert sorted(map(tuple, gr.patches(rows).collect())) == sorted(map(tuple, ar.patches(free).collect()))
    wide = gr.strips(gr.closing_lines(outline, edges, kind), ar.raster(outline), 5.0)
    assert sorted(map(tuple, gr.open_cells(wide, 5.0).collect())) == sorted(map(tuple, ar.clearance(free, edges, kind, "cell_id").collect()))
    got = ar.budget_of_strips(gr.strip_budget(rows), ar.site_frame(outline))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ar.area_budget(cells, blocked).collect()))


@pytest.mark.parametrize("name", ["lawn_patches", "buildable", "clearance_field", "area_budget", "exclusive_area", "blocker_cells"])
def test_no_table_of_cells_is_written_or_shuffled(spark, monkeypatch, name):
    from sitefit import session

    written = []
    keep = lambda df, path=None: written.append(df.columns) or session.cut(df)
    monkeypatch.setattr(q_area, "stored", keep)
    monkeypatch.setattr(session, "stored", keep)
    plan = load()[0][name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any("cell_id" in columns for columns in written)
    assert "hashpartitioning(site_id" not in plan or "cell_id" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_points_are_judged_like_joined_ones(spark, drawn):
    from sitefit.operators.buckets import inside_site

    outline, edges = drawn
    at = spark.range(4000).select(F.lit(7).cast("long").alias("site_id"), F.col("id").alias("cand_id"), (F.col("id") * 37 % 101 - 5).cast("double").alias("x"), (F.col("id") * 53 % 211 - 5 + F.col("id") % 3 / 3).alias("y"))
    odd = spark.createDataFrame([(None, 9001, 20.0, 80.0), (7, 9002, None, 80.0), (8, 9003, 20.0, 80.0)], "site_id long, cand_id long, x double, y double")
    twice = at.filter("cand_id % 7 = 0")
    at = at.unionByName(odd).unionByName(twice).cache()
    for kind in ("tree", "shrub", "lawn"):
        want = at.join(ar.blocker_cells(at, edges, outline, kind, "cand_id"), ["site_id", "cand_id"], "left_anti").join(inside_site(at, outline, "cand_id"), ["site_id", "cand_id"], "left_semi")
        got = sorted(map(tuple, gr.open_points(at, gr.closing_lines(outline, edges, kind), "cand_id").collect()))
        assert got and got == sorted(map(tuple, want.select(at.columns).collect()))


@pytest.mark.parametrize("name", ["scatter_candidates"])
def test_points_are_shuffled_once_to_their_strips(spark, name):
    plan = load()[0][name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert sum("strip" in line for line in dealt) == 2 and not any("cx" in line or "dart_id" in line for line in dealt)


def test_roomiest_spots_know_more_room_than_is_written_out(drawn):
    outline, edges = drawn
    # wide free ground: rooms of more than 5 m tell spots apart
    edges = edges.filter("gid in (1, 6, 9)")
    free = ar.buildable(ar.site_grid(outline), ar.blocker_cells(ar.site_grid(outline), edges, outline, "tree")).cache()
    lines = ar.required_reach(edges, "tree").collect()

    def beyond(x, y):
        def dist(e):
            dx, dy = e.x2 - e.x1, e.y2 - e.y1
            t = max(0.0, min(1.0, ((x - e.x1) * dx + (y - e.y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            return ((x - e.x1 - t * dx) ** 2 + (y - e.y1 - t * dy) ** 2) ** 0.5
        return min(dist(e) - e.required_m for e in lines)

    left = {r.cell_id: (r.x, r.y, beyond(r.x, r.y)) for r in free.collect()}
    patch = {r.cell_id: r.patch_id for r in ar.patch_of(free).collect()}
    want = []
    left = {k: v for k, v in left.items() if v[2] >= 2.5}
    while left:
        best = min(left, key=lambda k: (-left[k][2], k))
        x, y, _ = left[best]
        want.append((best, patch[best]))
        left = {k: v for k, v in left.items() if patch[k] != patch[best] or (v[0] - x) ** 2 + (v[1] - y) ** 2 > 225.0}
    got = gr.roomiest_spots(outline, edges, "tree", 15.0, 2.5).collect()
    assert max(r.clearance_m for r in got) > 30
    assert sorted((r.cell_id, r.patch_id) for r in got) == sorted(want)


def test_exclusive_area_of_a_small_site_is_measured_on_finer_cells(drawn):
    from types import SimpleNamespace

    outline, edges = drawn
    small = outline.withColumns({k: F.col(k) / 2 for k in ("x1", "y1", "x2", "y2")}).withColumns({k: (F.col(k) / 2).cast("long") for k in ("xc1", "yc1", "xc2", "yc2")})
    frame = ar.site_frame(small).first()
    step = max(0.5, (frame.area_m2 / 20000.0) ** 0.5)
    assert step < 2.0
    cells = ar.site_grid(small, step)
    want = ar.area_budget(cells, ar.blocker_cells(cells, edges, small, "tree")).select("site_id", "blocker", "exclusive_m2")
    got = q_area.exclusive_area(SimpleNamespace(outline=small, edges=edges))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
