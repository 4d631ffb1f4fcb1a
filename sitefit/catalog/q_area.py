"""Area analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_scalars  # noqa: F401
from sitefit.catalog.q_compliance import rejection_sql
from sitefit.catalog.q_rules import resolve_sql
from sitefit.catalog.q_spatial import nearest_sql
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, cte_over, lit, seg, sql
from sitefit.operators import area as ar
from sitefit.operators import compliance as co
from sitefit.operators import ground as gr
from sitefit.session import stored

cte("site_frames", """SELECT a.site_id, a.area_m2, b.x0, b.y0, b.xm, b.ym, 2e0 AS step FROM site_area a
  JOIN (SELECT site_id, min(x1) AS x0, min(y1) AS y0, max(x1) AS xm, max(y1) AS ym FROM outline GROUP BY ALL) b USING (site_id)""")
cte("all_cells", """SELECT site_id, ix, unnest(range(CAST(ceil((ym - (y0 + step / 2e0)) / step) AS BIGINT))) AS iy, x0, y0, step, area_m2 FROM (
    SELECT *, unnest(range(CAST(ceil((xm - (x0 + step / 2e0)) / step) AS BIGINT))) AS ix FROM site_frames) q""")
cte("cells", f"""SELECT site_id, ix * 1000000 + iy AS cell_id, ix, iy, any_value(x) AS x, any_value(y) AS y, any_value(step) AS step, any_value(area_m2) AS area_m2 FROM (
    SELECT site_id, ix, iy, step, area_m2, x0 + step / 2e0 + ix * step AS x, y0 + step / 2e0 + iy * step AS y FROM all_cells) c JOIN outline e USING (site_id)
  GROUP BY site_id, ix, iy HAVING count(*) FILTER ({cross('c.x', 'c.y')}) % 2 = 1""")


def reach_cte(kind: str) -> str:
    return resolve_sql(f"(SELECT *, '{kind}' AS planting_type, '' AS species FROM c_edges)", "site_id, gid, object_type, geom_kind, x1, y1, x2, y2")


HARD = ", ".join(lit(h) for h in fx.HARD_OBSTACLES)
for kind, margin, radius in (("tree", 5.0, 2.5), ("shrub", 1.5, 1.5), ("lawn", 0.5, 0.0)):
    cte(f"{kind}_reach", reach_cte(kind))


def blocked_sql(points: str, pid: str, kind: str) -> str:
    margin, radius = {"tree": (5.0, 2.5), "shrub": (1.5, 1.5), "lawn": (0.5, 0.0)}[kind]
    trunk = f"""UNION SELECT c.site_id, c.{pid}, 'hard_obstacles' FROM {points} c JOIN edges e USING (site_id)
        WHERE e.geom_kind = 'point' AND e.object_type = 'existing_greenery' AND {seg('c.x', 'c.y')} <= {radius}e0""" if radius else ""
    near = f"""c.x >= least(e.x1, e.x2) - e.required_m - 0.001e0 AND c.x <= greatest(e.x1, e.x2) + e.required_m + 0.001e0
        AND c.y >= least(e.y1, e.y2) - e.required_m - 0.001e0 AND c.y <= greatest(e.y1, e.y2) + e.required_m + 0.001e0"""
    return f"""SELECT c.site_id, c.{pid}, e.object_type AS blocker FROM {points} c JOIN {kind}_reach e USING (site_id) WHERE {near} AND {seg('c.x', 'c.y')} <= e.required_m
      UNION SELECT h.site_id, h.{pid}, k.blocker FROM (SELECT c.site_id, c.{pid}, e.gid, any_value(e.object_type) AS object_type FROM {points} c JOIN (SELECT * FROM edges WHERE geom_kind = 'polygon') e USING (site_id)
          GROUP BY c.site_id, c.{pid}, e.gid HAVING count(*) FILTER ({cross('c.x', 'c.y')}) % 2 = 1) h,
        LATERAL (SELECT h.object_type AS blocker WHERE h.object_type IN ({', '.join(lit(r[0]) for r in fx.SETBACKS)}) UNION ALL SELECT 'hard_obstacles' WHERE h.object_type IN ({HARD})) k
      UNION SELECT c.site_id, c.{pid}, 'territory_margin' FROM {points} c JOIN outline e USING (site_id) WHERE {seg('c.x', 'c.y')} <= {margin}e0 {trunk}"""


cte("tree_blocked", blocked_sql("cells", "cell_id", "tree"))
cte("tree_budget", """SELECT t.site_id, t.area_m2, t.area_m2 * (t.cells - coalesce(c.closed, 0)) / t.cells AS usable_m2, (t.cells - coalesce(c.closed, 0)) / t.cells AS usable_share, s.blocker,
    s.n / t.cells AS share, t.area_m2 * coalesce(a.alone, 0) / t.cells AS exclusive_m2
  FROM (SELECT site_id, any_value(area_m2) AS area_m2, count(*) AS cells FROM cells GROUP BY ALL) t
  LEFT JOIN (SELECT site_id, count(DISTINCT cell_id) AS closed FROM tree_blocked GROUP BY ALL) c USING (site_id)
  LEFT JOIN (SELECT site_id, blocker, count(*) AS n FROM tree_blocked GROUP BY ALL) s USING (site_id)
  LEFT JOIN (SELECT site_id, blocker, count(*) AS alone FROM (SELECT site_id, cell_id, min(blocker) AS blocker FROM tree_blocked GROUP BY ALL HAVING count(*) = 1) q GROUP BY ALL) a
    ON a.site_id = t.site_id AND a.blocker = s.blocker""")


# as fine as the site asks for, never coarser than the grid of the other queries
cte("fine_frames", "SELECT * REPLACE (least(2e0, greatest(0.5e0, sqrt(area_m2 / 20000e0))) AS step) FROM site_frames")
_FINE = cte_over(("tree_budget",), "site_frames", "fine_frames", "fine")


def _strips(t, kind="tree", room=0.0, step=ar.STEP_M):
    return gr.strips(gr.closing_lines(t.outline, t.edges, kind), ar.raster(t.outline, step), room)


def _budget(t, step=ar.STEP_M):
    return ar.budget_of_strips(stored(gr.strip_budget(_strips(t, step=step))), ar.site_frame(t.outline, step))


@query("site_grid", sql("SELECT site_id, ix, iy, x, y FROM cells"))
def site_grid(t):
    """Cell centres inside each site."""
    return ar.site_grid(t.outline).select("site_id", "ix", "iy", "x", "y")


@query("blocker_cells", sql("SELECT site_id, blocker, count(*)::BIGINT AS cells, min(cell_id) AS first_cell, max(cell_id) AS last_cell FROM tree_blocked GROUP BY ALL"))
def blocker_cells(t):
    """Cells closed by each blocker for a tree."""
    rows = gr.strip_budget(_strips(t)).filter("blocker is not null")
    return rows.groupBy("site_id", "blocker").agg(F.sum("n").alias("cells"), F.min("first_cell").alias("first_cell"), F.max("last_cell").alias("last_cell"))


@query("area_budget", sql("SELECT site_id, area_m2, usable_m2, usable_share, blocker, share FROM tree_budget"))
def area_budget(t):
    """Usable area for trees and what closes the rest."""
    return _budget(t).drop("exclusive_m2")


@query("exclusive_area", sql(f"SELECT site_id, blocker, exclusive_m2 FROM {_FINE['tree_budget']}"))
def exclusive_area(t):
    """Area closed by one blocker alone; small sites are cut into finer cells."""
    step = F.least(F.lit(ar.STEP_M), F.greatest(F.lit(0.5), F.sqrt(F.col("area_m2") / 20000.0)))
    return _budget(t, step).select("site_id", "blocker", "exclusive_m2")


@query("zones_summary", sql("""SELECT site_id, count(*)::BIGINT AS groups, arg_max(blocker, (exclusive_m2, blocker)) AS blocker, max(exclusive_m2) AS exclusive_m2,
    CAST(floor(max(exclusive_m2) / 25e0) AS BIGINT) AS extra_items FROM tree_budget WHERE exclusive_m2 > 0 GROUP BY ALL"""))
def zones_summary(t):
    """Which constraint frees most area for trees, and how many would fit."""
    return ar.zones_advice(_budget(t), 5.0)


@query("buildable", sql("SELECT site_id, cell_id FROM cells WHERE (site_id, cell_id) NOT IN (SELECT site_id, cell_id FROM tree_blocked)"))
def buildable(t):
    """Cells where a tree may stand."""
    return gr.open_cells(_strips(t))


@query("lawn_patches")
def lawn_patches(t):
    """Connected parts of the area where lawn is allowed, at least 4 m² each."""
    return gr.patches(_strips(t, "lawn")).filter(F.col("area_m2") >= 4.0)


@query("clearance_field", sql(f"""SELECT c.site_id, c.cell_id, least(5e0, coalesce(min({seg('c.x', 'c.y')} - e.required_m) FILTER ({seg('c.x', 'c.y')} <= e.required_m + 5e0), 5e0)) AS clearance_m
  FROM (SELECT * FROM cells WHERE (site_id, cell_id) NOT IN (SELECT site_id, cell_id FROM tree_blocked)) c LEFT JOIN tree_reach e ON e.site_id = c.site_id
    AND c.x >= least(e.x1, e.x2) - e.required_m - 5.001e0 AND c.x <= greatest(e.x1, e.x2) + e.required_m + 5.001e0
    AND c.y >= least(e.y1, e.y2) - e.required_m - 5.001e0 AND c.y <= greatest(e.y1, e.y2) + e.required_m + 5.001e0 GROUP BY c.site_id, c.cell_id"""))
def clearance_field(t):
    """Room around every allowed cell beyond the required distances."""
    return gr.open_cells(_strips(t, room=5.0), 5.0)


@query("roomiest_spots")
def roomiest_spots(t):
    """Roomiest spots of every connected part, each taking a disc of three intervals, until none is left with an interval of room."""
    return gr.roomiest_spots(t.outline, t.edges, "tree", 15.0, 2.5)


cte("spot_cells", """SELECT site_id, ix, unnest(range(CAST(ceil((ym - (y0 + 5e0)) / 10e0) AS BIGINT))) AS iy, x0, y0 FROM (
    SELECT *, unnest(range(CAST(ceil((xm - (x0 + 5e0)) / 10e0) AS BIGINT))) AS ix FROM site_frames) q""")
cte("spot_probes", f"""SELECT site_id, ix * 1000000 + iy AS cell_id, any_value(x) AS x, any_value(y) AS y, 'tree' AS planting_type, '' AS species FROM (
    SELECT site_id, ix, iy, x0 + 5e0 + ix * 10e0 AS x, y0 + 5e0 + iy * 10e0 AS y FROM spot_cells) c JOIN outline e USING (site_id)
  GROUP BY site_id, ix, iy HAVING count(*) FILTER ({cross('c.x', 'c.y')}) % 2 = 1""")
cte("spot_distances", nearest_sql("spot_probes", "cell_id", False))
cte("spot_reasons", rejection_sql("spot_probes", "cell_id", "spot_distances"))


@query("spot_reasons_by_site", sql("SELECT site_id, kind, object_type, count(DISTINCT cell_id) AS spots, max(required_m - actual_m) AS worst_gap_m FROM spot_reasons GROUP BY ALL"))
def spot_reasons_by_site(t):
    """What forbids trees at each site, on a grid of 10 m: every reason, how many spots it closes, the worst gap."""
    return co.grid_reasons(ar.site_grid(t.outline, 10.0), t.edges, t.outline, "tree", 10.0)


@query("legend_raster", sql("""SELECT site_id, grp, count(DISTINCT (px, py))::BIGINT AS pixels FROM (
    SELECT site_id, grp, CAST(floor((x1 + (x2 - x1) * (i / n)) / 2e0) AS BIGINT) AS px, CAST(floor((y1 + (y2 - y1) * (i / n)) / 2e0) AS BIGINT) AS py FROM (
      SELECT *, unnest(range(n + 1)) AS i FROM (SELECT e.*, l.grp, greatest(CAST(ceil(greatest(abs(x2 - x1), abs(y2 - y1)) / 2e0) AS BIGINT), 1) AS n
        FROM edges e JOIN legend_rows l USING (site_id, gid)) a) b) c GROUP BY ALL"""))
def legend_raster(t):
    """Pixels of each legend group at 2 m."""
    return ar.legend_raster(t.features, t.edges, 2.0)


@query("row_scan_fill", sql(f"""SELECT site_id, gid, count(*)::BIGINT AS cells FROM (
    SELECT c.site_id, c.gid, c.px, c.py FROM (SELECT site_id, gid, (ix + 0.5e0) * 1e0 AS px, (unnest(range(CAST(floor(b0) AS BIGINT), CAST(floor(b1) AS BIGINT) + 1)) + 0.5e0) * 1e0 AS py FROM (
        SELECT *, unnest(range(CAST(floor(a0) AS BIGINT), CAST(floor(a1) AS BIGINT) + 1)) AS ix FROM (
          SELECT site_id, gid, min(least(x1, x2)) AS a0, max(greatest(x1, x2)) AS a1, min(least(y1, y2)) AS b0, max(greatest(y1, y2)) AS b1 FROM edges WHERE geom_kind = 'polygon' GROUP BY ALL) f) g) c
    JOIN edges e ON e.site_id = c.site_id AND e.gid = c.gid GROUP BY ALL HAVING count(*) FILTER ({cross('c.px', 'c.py')}) % 2 = 1) q GROUP BY ALL"""))
def row_scan_fill(t):
    """Interior cells of every polygon by scan lines."""
    return ar.scan_fill(t.edges, 1.0)
