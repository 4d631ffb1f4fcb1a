"""Spatial join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_rules  # noqa: F401  (rulebook CTEs)
from sitefit.catalog.q_rules import KNOWN, resolve_sql
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, dist, lit, seg, sql
from sitefit.operators import proximity as px
from sitefit.operators.buckets import as_edges, inside, nearest
from sitefit.operators.compliance import CHECKED_TYPES, distances, with_half

CHECKED = ", ".join(lit(t) for t in CHECKED_TYPES)
cte("c_edges", f"SELECT * FROM edges WHERE object_type IN ({CHECKED})")


def box_sql(e: str = "e.") -> str:
    """Square or point to edge."""
    h = "(i.side_c / 200e0)"
    corners = [seg(f"(i.x {a} {h})", f"(i.y {b} {h})", e) for a, b in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"))]
    ends = []
    for k in "12":
        ox, oy = f"greatest(abs({e}x{k} - i.x) - {h}, 0e0)", f"greatest(abs({e}y{k} - i.y) - {h}, 0e0)"
        ends.append(f"sqrt({ox} * {ox} + {oy} * {oy})")

    def side(px_, py_, qx, qy, rx, ry):
        return f"sign((({qx}) - ({px_})) * (({ry}) - ({py_})) - (({qy}) - ({py_})) * (({rx}) - ({px_})))"

    def meet(ax, ay, bx, by):
        p, q = (f"{e}x1", f"{e}y1"), (f"{e}x2", f"{e}y2")
        a, b = (ax, ay), (bx, by)
        return f"({side(*p, *q, *a)} * {side(*p, *q, *b)} < 0 AND {side(*a, *b, *p)} * {side(*a, *b, *q)} < 0)"

    through = f"({meet(f'i.x - {h}', f'i.y - {h}', f'i.x + {h}', f'i.y + {h}')} OR {meet(f'i.x - {h}', f'i.y + {h}', f'i.x + {h}', f'i.y - {h}')})"
    return f"(CASE WHEN i.side_c = 0 THEN {seg('i.x', 'i.y', e)} WHEN {through} THEN 0e0 ELSE least({', '.join(corners + ends)}) END)"


def inside_sql(points: str, pid: str, where: str = "TRUE") -> str:
    return f"""SELECT p.site_id, p.{pid}, e.gid, any_value(e.object_type) AS object_type FROM {points} p
      JOIN (SELECT * FROM edges WHERE geom_kind = 'polygon' AND {where}) e USING (site_id)
      GROUP BY p.site_id, p.{pid}, e.gid HAVING count(*) FILTER ({cross('p.x', 'p.y')}) % 2 = 1"""


def nearest_sql(points: str, pid: str, box: bool) -> str:
    d = box_sql() if box else seg("i.x", "i.y")
    return f"""
      SELECT n.site_id, n.{pid}, n.object_type, CASE WHEN c.{pid} IS NULL THEN n.d ELSE 0e0 END AS actual_m
      FROM (SELECT i.site_id, i.{pid}, e.object_type, min({d}) AS d FROM {points} i JOIN c_edges e USING (site_id) GROUP BY ALL) n
      LEFT JOIN (SELECT DISTINCT site_id, {pid}, object_type FROM ({inside_sql(points, pid, f'object_type IN ({CHECKED})')}) z) c
        ON c.site_id = n.site_id AND c.{pid} = n.{pid} AND c.object_type = n.object_type"""


cte("item_distances", nearest_sql("items", "item_id", True))
cte("ref_distances", nearest_sql("reference_trees", "ref_id", False))
GROUP_CASE = "CASE " + " ".join(
    f"WHEN object_type IN ({', '.join(lit(x) for x in types)}) THEN {lit(g)}" for g, types in fx.DISTANCE_GROUPS) + " END"
cte("g_edges", f"""SELECT site_id, gid, geom_kind, {GROUP_CASE} AS grp, x1, y1, x2, y2 FROM edges
  WHERE {GROUP_CASE} IS NOT NULL
  UNION ALL SELECT site_id, -1, 'line', 'edge', x1, y1, x2, y2 FROM outline""")


def group_distances(points: str, pid: str) -> str:
    """Distance per (point, group), 0 inside a polygon, uncapped."""
    return f"""SELECT p.site_id, p.{pid}, p.grp, min(CASE WHEN p.odd THEN 0e0 ELSE p.d END) AS dist FROM (
        SELECT i.site_id, i.{pid}, e.grp, e.gid, min({seg('i.x', 'i.y')}) AS d,
          any_value(e.geom_kind) = 'polygon' AND count(*) FILTER ({cross('i.x', 'i.y')}) % 2 = 1 AS odd
        FROM {points} i JOIN g_edges e USING (site_id) GROUP BY ALL) p GROUP BY ALL"""


cte("foot_cells", """SELECT site_id, gid, object_type, cx, unnest(range(ay, by1 + 1)) AS cy FROM (SELECT *, unnest(range(ax, bx + 1)) AS cx FROM (
    SELECT site_id, gid, any_value(object_type) AS object_type, CAST(floor(min(least(x1, x2)) / 8e0) AS BIGINT) AS ax, CAST(floor(max(greatest(x1, x2)) / 8e0) AS BIGINT) AS bx,
      CAST(floor(min(least(y1, y2)) / 8e0) AS BIGINT) AS ay, CAST(floor(max(greatest(y1, y2)) / 8e0) AS BIGINT) AS by1 FROM edges GROUP BY site_id, gid) a) b""")


@query("grid_buckets", sql("""SELECT site_id, gid, cells, coalesce(neighbours, 0) AS neighbours FROM (SELECT site_id, gid, count(*) AS cells FROM foot_cells GROUP BY ALL) f
  LEFT JOIN (SELECT a.site_id, a.gid, count(DISTINCT b.gid) AS neighbours FROM foot_cells a JOIN foot_cells b ON a.site_id = b.site_id AND a.cx = b.cx AND a.cy = b.cy AND a.object_type <> b.object_type GROUP BY ALL) n USING (site_id, gid)"""))
def grid_buckets(t):
    """Footprints on an 8 m grid and the features of other types that they share cells with."""
    return px.cell_neighbours(t.edges, 8.0)


@query("within_distance", sql(f"""
  SELECT i.site_id, i.item_id, e.gid, min({seg('i.x', 'i.y')}) AS dist FROM items i JOIN edges e USING (site_id)
  WHERE {seg('i.x', 'i.y')} <= 4e0 + (e.gid % 5) * 1.5e0 GROUP BY ALL"""))
def within_distance(t):
    """Item-object pairs within a radius that differs per object."""
    return px.within_distance(t.items, t.edges, 4.0 + (F.col("gid") % 5) * 1.5, 10.0)


@query("nearest_by_type", sql("SELECT * FROM item_distances"))
def nearest_by_type(t):
    """Distance of every item to the nearest object of each type at its site; 0 inside."""
    return distances(with_half(t.items), t.edges)


@query("nearest_capped", sql(f"""
  SELECT i.site_id, i.item_id, g.grp, least(coalesce(d.dist, 60e0), 60e0) AS dist
  FROM items i CROSS JOIN (SELECT unnest([{', '.join(lit(g) for g, _ in fx.DISTANCE_GROUPS)}]) AS grp) g
  LEFT JOIN ({group_distances('items', 'item_id')}) d ON d.site_id = i.site_id AND d.item_id = i.item_id AND d.grp = g.grp"""))
def nearest_capped(t):
    """Distance to the nearest object of each feature group, capped at 60 m."""
    wide = px.distance_matrix(t.items, px.grouped_edges(t.edges, t.outline), "item_id")
    cols = [f"d_{g}" for g, _ in fx.DISTANCE_GROUPS]
    return wide.unpivot(["site_id", "item_id"], cols, "grp", "dist").withColumn("grp", F.substring("grp", 3, 100))


COUNT_COLS = ", ".join(
    f"count(DISTINCT CASE WHEN grp = {lit(g)} AND (d <= {r}e0 OR odd) THEN gid END)::BIGINT AS n_{g}_{int(r)}" for g, r in fx.COUNT_FEATURES)


@query("count_within", sql(f"""
  SELECT site_id, item_id, {COUNT_COLS} FROM (
    SELECT i.site_id, i.item_id, e.grp, e.gid, min({seg('i.x', 'i.y')}) AS d,
      any_value(e.geom_kind) = 'polygon' AND count(*) FILTER ({cross('i.x', 'i.y')}) % 2 = 1 AS odd
    FROM items i LEFT JOIN g_edges e USING (site_id) GROUP BY ALL) p GROUP BY ALL"""))
def count_within(t):
    """Objects of a group within its radius of every item."""
    return px.counts_within(t.items, px.grouped_edges(t.edges, t.outline), "item_id")


@query("point_in_polygon", sql(f"SELECT site_id, cand_id, gid FROM ({inside_sql('candidates', 'cand_id')}) q"))
def point_in_polygon(t):
    """Polygons that hold each candidate, by the even-odd rule."""
    return inside(t.candidates, t.edges.filter("geom_kind = 'polygon'"), "cand_id")


cte("zoning_hits", inside_sql("candidates", "cand_id", "object_type = 'zoning'"))
cte("cand_zoning", """SELECT h.site_id, h.cand_id, arg_min(f.zoning, h.gid) AS zoning FROM zoning_hits h JOIN features f USING (site_id, gid) GROUP BY ALL""")


@query("zoning_at", sql("SELECT c.site_id, c.cand_id, z.zoning FROM candidates c LEFT JOIN cand_zoning z USING (site_id, cand_id)"))
def zoning_at(t):
    """Zoning category under each candidate."""
    return px.zoning_at(t.candidates, t.edges, t.features, "cand_id")


cte("object_distances", f"""SELECT i.site_id, i.item_id, e.gid, any_value(e.object_type) AS object_type,
    CASE WHEN any_value(e.geom_kind) = 'polygon' AND count(*) FILTER ({cross('i.x', 'i.y')}) % 2 = 1 THEN 0e0 ELSE min({seg('i.x', 'i.y')}) END AS dist
  FROM items i JOIN edges e USING (site_id) GROUP BY ALL""")


@query("distance_to_constraint", sql("SELECT site_id, item_id, gid, dist FROM object_distances WHERE dist <= 20e0"))
def distance_to_constraint(t):
    """Distance of items to single objects up to 20 m; 0 inside."""
    return px.distance_to_objects(t.items, t.edges, 20.0)


cte("trees", "SELECT * FROM items WHERE planting_type = 'tree'")
cte("tree_nearest", f"""SELECT site_id, item_id, arg_min(other_id, (d, other_id)) AS other_id, min(d) AS dist FROM (
    SELECT a.site_id, a.item_id, b.item_id AS other_id, {dist('a.x', 'a.y', 'b.x', 'b.y')} AS d
    FROM trees a JOIN trees b ON a.site_id = b.site_id AND a.item_id <> b.item_id) q GROUP BY ALL""")


@query("self_nearest", sql("SELECT * FROM tree_nearest"))
def self_nearest(t):
    """Nearest other tree of every tree; the lower id on ties."""
    trees = t.items.filter("planting_type = 'tree'").withColumn("kind", F.lit("tree"))
    return nearest(trees, as_edges(trees, F.col("item_id").alias("other_id"), "kind"), "item_id", "kind", near=12.0, target="other_id").drop("kind")


cte("ref_rows", "SELECT site_id, ref_id, object_type, actual_m, 'tree' AS planting_type, 'Рябина обыкновенная' AS species FROM ref_distances")
cte("ref_legal", f"""SELECT r.site_id, r.ref_id, w.ref_id IS NULL AS legal, w.blocker FROM reference_trees r LEFT JOIN (
    SELECT site_id, ref_id, arg_min(object_type, (actual_m - required_m, object_type)) AS blocker
    FROM ({resolve_sql('ref_rows', 'site_id, ref_id, object_type, actual_m')}) q WHERE actual_m + 0.001e0 < required_m GROUP BY ALL) w USING (site_id, ref_id)""")


@query("legal_points", sql("SELECT * FROM ref_legal"))
def legal_points(t):
    """Which reference trees pass the checks for the narrowest crown, and the worst blocker of the rest."""
    return px.legal_points(t.reference_trees, t.edges, "ref_id")


@query("nearby_constraints", sql(f"""
  SELECT site_id, item_id, 'constraint' AS kind, other_id, object_type, required_m FROM ({resolve_sql(
    f'''(SELECT d.site_id, d.item_id, d.gid AS other_id, d.object_type, i.planting_type, i.species
        FROM object_distances d JOIN trees i USING (site_id, item_id) WHERE d.dist <= 15e0 AND d.object_type IN ({CHECKED}))''',
    'site_id, item_id, other_id, object_type')}) c
  UNION ALL
  SELECT a.site_id, a.item_id, 'neighbour', b.item_id, 'neighbour_tree', greatest(sa.interval_m, sb.interval_m)
  FROM trees a JOIN trees b ON a.site_id = b.site_id AND a.item_id <> b.item_id AND abs(a.x - b.x) <= 15e0 AND abs(a.y - b.y) <= 15e0
  LEFT JOIN d_interval sa ON sa.name = a.species LEFT JOIN d_interval sb ON sb.name = b.species
  WHERE greatest(sa.interval_m, sb.interval_m) IS NOT NULL"""))
def nearby_constraints(t):
    """Constraints and neighbour trees within 15 m of every tree, with the required distance."""
    return px.nearby_constraints(t.items, t.edges, 15.0)


cte("grouped_items", "SELECT * FROM items WHERE group_id IS NOT NULL AND planting_type <> 'lawn'")


@query("worst_reading", sql(f"""
  SELECT site_id, group_id, min(actual_m - required_m) AS slack_m, arg_min(object_type, (actual_m - required_m, object_type, item_id)) AS object_type,
    arg_min(item_id, (actual_m - required_m, object_type, item_id)) AS item_id
  FROM ({resolve_sql('(SELECT d.*, s.group_id, s.planting_type, s.species FROM item_distances d JOIN grouped_items s USING (site_id, item_id))',
    'site_id, item_id, group_id, object_type, actual_m')}) q GROUP BY ALL"""))
def worst_reading(t):
    """Most violated or tightest constraint of every group."""
    return px.worst_reading(t.items, t.edges)


def meet_sql(a: str, b: str) -> str:
    def side(p, q, r):
        return f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    p, q = (f"{a}x1", f"{a}y1"), (f"{a}x2", f"{a}y2")
    r, s = (f"{b}x1", f"{b}y1"), (f"{b}x2", f"{b}y2")
    return f"({side(p, q, r)} * {side(p, q, s)} < 0 AND {side(r, s, p)} * {side(r, s, q)} < 0)"


cte("site_distance", f"""SELECT site_id, gid, min(d) AS dist FROM (
    SELECT e.site_id, e.gid, CASE WHEN {meet_sql('e.', 'o.')} THEN 0e0 ELSE
      least({seg('e.x1', 'e.y1', 'o.')}, {seg('e.x2', 'e.y2', 'o.')}, {seg('o.x1', 'o.y1', 'e.')}, {seg('o.x2', 'o.y2', 'e.')}) END AS d
    FROM edges e JOIN outline o USING (site_id)
    UNION ALL
    SELECT e.site_id, e.gid, 0e0 FROM edges e JOIN outline o USING (site_id) GROUP BY e.site_id, e.gid, e.seq
      HAVING count(*) FILTER ({cross('e.x1', 'e.y1', 'o.')}) % 2 = 1) q GROUP BY ALL""")


@query("near_territory", sql(f"""
  SELECT f.site_id, f.gid, f.object_type, b.table_m * CASE WHEN f.kind = 'zone' THEN 5e0 ELSE 1e0 END + 10e0 AS reach
  FROM features f JOIN d_setbacks b ON b.planting_type = 'tree' AND b.rule_key = CASE WHEN f.object_type IN ({KNOWN}) THEN f.object_type ELSE '__other__' END
  JOIN site_distance d USING (site_id, gid) WHERE d.dist <= b.table_m * CASE WHEN f.kind = 'zone' THEN 5e0 ELSE 1e0 END + 10e0"""))
def near_territory(t):
    """Features whose setback zone can reach the site."""
    return px.near_territory(t.features, t.edges, t.outline)


@query("box_query", sql("""
  SELECT site_id, count(*)::BIGINT AS items, min(x - h) AS min_x, max(x + h) AS max_x, min(y - h) AS min_y, max(y + h) AS max_y
  FROM (SELECT *, side_c / 200e0 AS h FROM items) i WHERE x - h >= 50e0 AND x + h <= 250e0 AND y - h >= 40e0 AND y + h <= 220e0 GROUP BY ALL"""))
def box_query(t):
    """Items in a box per site and the bounds of the selection."""
    return px.box_query(t.items, (50.0, 40.0), (250.0, 220.0))


@query("scene_filter", sql("""
  SELECT s.site_id, s.gid, s.object_type, s.area_m2, s.object_type <> 'building' AS clipped FROM (
    SELECT site_id, gid, object_type, abs(CAST(sum(xc1 * yc2 - xc2 * yc1) AS BIGINT)) / 20000e0 AS area_m2,
      CAST(sum(CAST(floor(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * 1000000e0) AS BIGINT)) AS BIGINT) AS per
    FROM edges WHERE geom_kind = 'polygon' AND object_type IN ('building','road','sidewalk','existing_greenery','existing_lawn') GROUP BY ALL) s
  JOIN site_distance d USING (site_id, gid)
  WHERE d.dist <= 30e0 AND (s.object_type <> 'building' OR s.area_m2 * 2e0 / greatest(s.per / 1000000e0, 1e-9) >= 1.5e0)"""))
def scene_filter(t):
    """Polygonal context within 30 m of the site, without slivers."""
    return px.scene_filter(t.edges, t.outline)
