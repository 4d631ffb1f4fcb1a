"""Geometry cleaning and site outline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit.catalog import q_scalars  # noqa: F401
from sitefit.catalog.q_spatial import meet_sql
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, dist, seg, sql
from sitefit.operators import chains as ch
from sitefit.operators import clean as cl
from sitefit.operators import measures as me
from sitefit.operators import territory as te
from sitefit.operators.iterate import shortest_matching
from sitefit.sources import ingest as ig

# drawn lines with copies: every ninth again, backwards
COPIES = """SELECT site_id, object_type, gid, x1, y1, x2, y2 FROM {e} WHERE geom_kind = 'line'
  UNION ALL SELECT site_id, object_type, gid + 1000000000000, x2, y2, x1, y1 FROM {e} WHERE geom_kind = 'line' AND gid % 9 = 0"""
cte("drawn_lines", COPIES.format(e="edges"))
# dashes: runs of six, 1 m long with 0.5 m gaps, every run in its own place and direction
DASH = """SELECT site_id, object_type, gid, bx + ux * i * 1.5e0 AS x1, bx2 + uy * i * 1.5e0 AS y1, bx + ux * (i * 1.5e0 + 1e0) AS x2, bx2 + uy * (i * 1.5e0 + 1e0) AS y2 FROM (
  SELECT k {div} 600 AS site_id, concat('net', (k {div} 6) % 3) AS object_type, k AS gid, k % 6 AS i, ((k {div} 6) * 7919 % 380) * 1e0 AS bx, ((k {div} 6) * 104729 % 280) * 1e0 AS bx2,
    CASE WHEN (k {div} 6) % 2 = 0 THEN 0.6e0 ELSE 0.8e0 END AS ux, CASE WHEN (k {div} 6) % 2 = 0 THEN 0.8e0 ELSE 0.6e0 END AS uy FROM (SELECT o_orderkey AS k FROM {orders}) o) q"""
cte("dashes", DASH.format(div="//", orders="orders"))


def _dashes(t):
    return t.spark.sql(DASH.format(div="div", orders="{orders}"), orders=t.orders)


cte("dash_ends", """SELECT site_id, object_type, gid, gid * 2 AS end_id, x1 AS x, y1 AS y, -(x2 - x1) / len AS ux, -(y2 - y1) / len AS uy FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM dashes) a
  UNION ALL SELECT site_id, object_type, gid, gid * 2 + 1, x2, y2, (x2 - x1) / len, (y2 - y1) / len FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM dashes) a""")
cte("link_rows", f"""SELECT site_id, object_type, a, b, gap FROM (SELECT p.site_id, p.object_type, p.end_id AS a, q.end_id AS b, p.ux, p.uy, q.ux AS vx, q.uy AS vy, p.x, p.y, q.x AS x1, q.y AS y1, {dist('p.x', 'p.y', 'q.x', 'q.y')} AS gap
    FROM dash_ends p JOIN dash_ends q ON p.site_id = q.site_id AND p.object_type = q.object_type AND p.gid <> q.gid AND p.end_id < q.end_id) z
  WHERE gap <= 0.8e0 AND -(ux * vx + uy * vy) >= 0.9659258262890683e0 AND (gap = 0 OR ux * ((x1 - x) / gap) + uy * ((y1 - y) / gap) >= 0.9659258262890683e0)""")


@query("dedupe_lines", sql("SELECT site_id, object_type, min(gid) AS gid FROM drawn_lines GROUP BY site_id, object_type, least(row(x1, y1), row(x2, y2)), greatest(row(x1, y1), row(x2, y2))"))
def dedupe_lines(t):
    """Lines drawn twice, forward or backward, kept once."""
    return cl.dedupe_lines(t.spark.sql(COPIES.format(e="{e}"), e=t.edges))


@query("dash_links", sql("SELECT * FROM link_rows"))
def dash_links(t):
    """Ends of dashes that continue each other."""
    return cl.dash_links(_dashes(t))


def _matched(t):
    lines = _dashes(t)
    return lines, shortest_matching(cl.dash_links(lines).drop("object_type"))


@query("dash_matching")
def dash_matching(t):
    """Shortest gaps first, each end used once (rows only; tested against a sequential pass)."""
    return _matched(t)[1]


# dashes of two edges each, every seventh drawn twice, every fifth backwards
BROKEN = """SELECT site_id, object_type, k AS gid, 'line' AS geom_kind, s AS seq, CASE WHEN back THEN CASE s WHEN 0 THEN x2 ELSE mx END ELSE CASE s WHEN 0 THEN x1 ELSE mx END END AS x1,
    CASE WHEN back THEN CASE s WHEN 0 THEN y2 ELSE my END ELSE CASE s WHEN 0 THEN y1 ELSE my END END AS y1, CASE WHEN back THEN CASE s WHEN 0 THEN mx ELSE x1 END ELSE CASE s WHEN 0 THEN mx ELSE x2 END END AS x2,
    CASE WHEN back THEN CASE s WHEN 0 THEN my ELSE y1 END ELSE CASE s WHEN 0 THEN my ELSE y2 END END AS y2
  FROM (SELECT site_id, object_type, gid + 1000000000000 * d AS k, (gid + d) % 5 = 0 AS back, x1, y1, x2, y2, (x1 + x2) / 2e0 AS mx, (y1 + y2) / 2e0 AS my FROM {dashes}, (SELECT 0 AS d UNION ALL SELECT 1) c WHERE d = 0 OR gid % 7 = 0) a, (SELECT 0 AS s UNION ALL SELECT 1) b"""


def _broken(t):
    return t.spark.sql(BROKEN, dashes=_dashes(t))


@query("merge_dashes")
def merge_dashes(t):
    """Dashes joined into runs as ordered edges with bridges (rows only; tested against a sequential walk)."""
    return ch.merge_dashes(_broken(t))


# even sites: a path with every 50th step missing; odd sites: squares, every third without its last side; some lines backwards
TOUCH = """SELECT site_id, 'net' AS object_type, gid, 'line' AS geom_kind, 0 AS seq, CASE WHEN back THEN q1 ELSE p1 END AS x1, CASE WHEN back THEN q2 ELSE p2 END AS y1, CASE WHEN back THEN p1 ELSE q1 END AS x2, CASE WHEN back THEN p2 ELSE q2 END AS y2 FROM (
  SELECT site_id, gid, back, CASE WHEN odd THEN bx + CASE WHEN side = 1 OR side = 2 THEN 3e0 ELSE 0e0 END ELSE i * 1e0 END AS p1, CASE WHEN odd THEN bx + CASE WHEN side = 2 OR side = 3 THEN 3e0 ELSE 0e0 END ELSE (i {div} 7) * 1e0 END AS p2,
    CASE WHEN odd THEN bx + CASE WHEN side = 0 OR side = 1 THEN 3e0 ELSE 0e0 END ELSE i + 1e0 END AS q1, CASE WHEN odd THEN bx + CASE WHEN side = 1 OR side = 2 THEN 3e0 ELSE 0e0 END ELSE ((i + 1) {div} 7) * 1e0 END AS q2
  FROM (SELECT k {div} 600 AS site_id, k AS gid, k % 3 = 0 AS back, k {div} 600 % 2 = 1 AS odd, k % 4 AS side, k % 600 AS i, (k {div} 4 % 150) * 5e0 AS bx FROM (SELECT o_orderkey AS k FROM {orders}) o) a
  WHERE CASE WHEN odd THEN NOT (side = 3 AND gid {div} 4 % 3 = 0) ELSE gid % 50 <> 0 END) b"""
cte("touching", TOUCH.format(div="//", orders="orders"))
cte("touch_ends", "SELECT site_id, gid, gid * 2 AS e, x1 AS x, y1 AS y FROM touching UNION ALL SELECT site_id, gid, gid * 2 + 1, x2, y2 FROM touching")
cte("touch_pairs", "SELECT site_id, min(e) AS a, max(e) AS b FROM touch_ends GROUP BY site_id, x, y HAVING count(*) = 2 AND min(e) // 2 <> max(e) // 2")
cte("touch_ways", "SELECT e.site_id, e.e AS id, coalesce(p.b, q.a) AS prev FROM touch_ends e LEFT JOIN touch_pairs p ON p.site_id = e.site_id AND p.a = xor(e.e, 1) LEFT JOIN touch_pairs q ON q.site_id = e.site_id AND q.b = xor(e.e, 1)")
cte("touch_walk", "SELECT id AS start, id AS cur, prev, 0 AS n FROM touch_ways UNION ALL SELECT w.start, u.id, u.prev, n + 1 FROM touch_walk w JOIN touch_ways u ON u.id = w.prev WHERE u.id <> w.start")
cte("touch_place", """SELECT start AS id, closed, label, arg_min(n, abs(cur - label)) AS pos FROM (SELECT *, CASE WHEN closed THEN min(cur) OVER s ELSE last_value(cur) OVER (PARTITION BY start ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS label
    FROM (SELECT *, count(*) FILTER (prev IS NULL) OVER (PARTITION BY start) = 0 AS closed FROM touch_walk) a WINDOW s AS (PARTITION BY start)) b GROUP BY ALL""")
cte("touch_lists", "SELECT label, closed, arg_max(id, pos) AS tail, min(id // 2) AS chain FROM touch_place GROUP BY ALL")


@query("touch_merge", sql("""SELECT t.site_id, t.object_type, l.chain AS gid, CAST(p.pos AS BIGINT) AS seq, CASE WHEN p.id % 2 = 1 THEN x1 ELSE x2 END AS x1, CASE WHEN p.id % 2 = 1 THEN y1 ELSE y2 END AS y1,
    CASE WHEN p.id % 2 = 1 THEN x2 ELSE x1 END AS x2, CASE WHEN p.id % 2 = 1 THEN y2 ELSE y1 END AS y2, FALSE AS bridge
  FROM touch_place p JOIN touch_lists l USING (label) JOIN touching t ON t.gid = p.id // 2
  WHERE CASE WHEN l.closed THEN label % 2 = 1 ELSE label // 2 < tail // 2 OR (label // 2 = tail // 2 AND label % 2 = 1) END""", "nothing_ AS (SELECT 1)"))
def touch_merge(t):
    """Lines joined where exactly two ends meet, as ordered edges."""
    return ch.touch_merge(t.spark.sql(TOUCH.format(div="div", orders="{orders}"), orders=t.orders))


@query("stitch_by_type")
def stitch_by_type(t):
    """Utility lines stitched per type beside what is no line (rows only; tested on a fixture)."""
    return ch.stitch_by_type(_broken(t).unionByName(t.edges.filter("geom_kind <> 'line'").select("site_id", "object_type", "gid", "geom_kind", F.col("seq").cast("int").alias("seq"), "x1", "y1", "x2", "y2")))


# a shifted drawing with junk on the origin at every third site
SHIFT = """SELECT site_id, gid, object_type, CASE WHEN far AND NOT junk THEN x1 + 5000e0 WHEN junk THEN 0e0 ELSE x1 END AS x1, CASE WHEN far AND NOT junk THEN y1 + 9000e0 WHEN junk THEN 0.2e0 ELSE y1 END AS y1,
  CASE WHEN far AND NOT junk THEN x2 + 5000e0 WHEN junk THEN 0.3e0 ELSE x2 END AS x2, CASE WHEN far AND NOT junk THEN y2 + 9000e0 WHEN junk THEN 0.4e0 ELSE y2 END AS y2
  FROM (SELECT *, site_id % 3 = 1 AS far, gid % 97 = 0 AS junk FROM {e}) q"""
cte("shifted", SHIFT.format(e="edges"))
cte("shift_near", f"SELECT site_id, gid, min({seg('0e0', '0e0', 'e.')}) AS d, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS xm, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS ym FROM shifted e GROUP BY ALL")
cte("artifacts", """SELECT site_id, coalesce(near AND x0 IS NOT NULL AND diag > 0 AND sqrt(dx * dx + dy * dy) >= diag * 2e0, FALSE) AS artifact FROM (
    SELECT site_id, near, x0, sqrt((xm - x0) * (xm - x0) + (ym - y0) * (ym - y0)) AS diag, greatest(x0, 0e0, -xm) AS dx, greatest(y0, 0e0, -ym) AS dy FROM (
      SELECT site_id, bool_or(d <= 1e0) AS near, min(x0) FILTER (d > 1e0) AS x0, max(xm) FILTER (d > 1e0) AS xm, min(y0) FILTER (d > 1e0) AS y0, max(ym) FILTER (d > 1e0) AS ym FROM shift_near GROUP BY ALL) a) b""")


def _shifted(t):
    return t.spark.sql(SHIFT.format(e="{e}"), e=t.edges)


@query("origin_artifact", sql("SELECT * FROM artifacts"))
def origin_artifact(t):
    """Sites whose origin holds junk."""
    return cl.origin_artifact(_shifted(t))


@query("drop_origin", sql("SELECT site_id, gid, x1, y1 FROM shifted s WHERE NOT EXISTS (SELECT 1 FROM shift_near n JOIN artifacts a USING (site_id) WHERE a.artifact AND n.d <= 1e0 AND n.site_id = s.site_id AND n.gid = s.gid)"))
def drop_origin(t):
    """Features left after origin junk is dropped."""
    return cl.drop_origin(_shifted(t)).select("site_id", "gid", "x1", "y1")


@query("snap_grid", sql("SELECT site_id, gid, seq, floor(x1 / 0.05e0 + 0.5e0) * 0.05e0 AS x_fine, floor(x1 / 2e0 + 0.5e0) * 2e0 AS x_coarse, floor(y1 / 0.1e0 + 0.5e0) * 0.1e0 AS y_mid FROM edges"))
def snap_grid(t):
    """Vertices on the snapping grids."""
    return t.edges.select("site_id", "gid", "seq", cl.snap(F.col("x1"), 0.05).alias("x_fine"), cl.snap(F.col("x1"), 2.0).alias("x_coarse"), cl.snap(F.col("y1"), 0.1).alias("y_mid"))


cte("line_rows", "SELECT site_id, gid, x1, y1, x2, y2 FROM edges WHERE geom_kind = 'line'")
cte("cut_rows", f"""SELECT DISTINCT site_id, gid, t FROM (SELECT p.site_id, p.gid, ((q.x1 - p.x1) * (q.y2 - q.y1) - (q.y1 - p.y1) * (q.x2 - q.x1)) / ((p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1)) AS t
    FROM line_rows p JOIN line_rows q ON p.site_id = q.site_id AND p.gid <> q.gid AND {meet_sql('p.', 'q.')} UNION ALL SELECT site_id, gid, unnest([0e0, 1e0]) FROM line_rows) z""")


@query("node_segments", sql("SELECT * FROM (SELECT site_id, gid, row_number() OVER w AS piece, t AS t1, lead(t) OVER w AS t2 FROM cut_rows WINDOW w AS (PARTITION BY site_id, gid ORDER BY t)) q WHERE t2 IS NOT NULL"))
def node_segments(t):
    """Lines cut at their mutual crossings."""
    return cl.node_segments(t.edges.filter("geom_kind = 'line'"))


@query("self_crossing", sql(f"SELECT DISTINCT p.site_id, p.gid FROM edges p JOIN edges q ON p.site_id = q.site_id AND p.gid = q.gid AND p.seq + 1 < q.seq AND {meet_sql('p.', 'q.')}"))
def self_crossing(t):
    """Rings that cross themselves."""
    return ig.self_crossing(t.edges)


cte("loop_keys", """SELECT f.site_id, f.gid, CAST(floor(f.area_m2 * 10 + 0.5e0) AS BIGINT) AS a, CAST(floor(b.x0 * 10 + 0.5e0) AS BIGINT) AS x0, CAST(floor(b.y0 * 10 + 0.5e0) AS BIGINT) AS y0,
    CAST(floor(b.xm * 10 + 0.5e0) AS BIGINT) AS xm, CAST(floor(b.ym * 10 + 0.5e0) AS BIGINT) AS ym FROM feature_area f
  JOIN (SELECT site_id, gid, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0, max(greatest(x1, x2)) AS xm, max(greatest(y1, y2)) AS ym FROM edges GROUP BY ALL) b USING (site_id, gid)""")


@query("dup_loops", sql("SELECT site_id, min(gid) AS gid, count(*)::BIGINT AS copies FROM loop_keys GROUP BY site_id, a, x0, y0, xm, ym"))
def dup_loops(t):
    """Loops equal by rounded area and bounds."""
    return cl.duplicate_loops(me.polygon_measures(t.edges), cl.bounds_of(t.edges))


@query("kerb_loop_filter", sql(f"""SELECT f.site_id, f.gid, f.area_m2 * 2e0 / f.perimeter_m >= 3e0 AND o.gid IS NULL AS kept FROM feature_area f LEFT JOIN (SELECT DISTINCT site_id, gid FROM (
    SELECT p.site_id, p.gid AS pid, e.gid FROM (SELECT site_id, gid, x1 AS x, y1 AS y FROM edges WHERE seq = 0 AND object_type IN ('building','existing_greenery','existing_lawn','sidewalk','sidewalk_kerb','lighting_pole')) p
    JOIN (SELECT * FROM edges WHERE object_type = 'road' AND geom_kind = 'polygon') e USING (site_id) GROUP BY ALL HAVING count(*) FILTER ({cross('p.x', 'p.y')}) % 2 = 1) z) o USING (site_id, gid) WHERE f.object_type = 'road'"""))
def kerb_loop_filter(t):
    """Kerb loops that may stay roads."""
    return cl.kerb_loop_filter(t.edges, me.polygon_measures(t.edges))


cte("ext_box", "SELECT *, (x0 + xm) / 2e0 AS mx, (y0 + ym) / 2e0 AS my FROM (SELECT site_id, gid, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0, max(greatest(x1, x2)) AS xm, max(greatest(y1, y2)) AS ym FROM shifted GROUP BY ALL) q")
cte("ext_mid", "SELECT b.*, abs(mx - cx) AS ox, abs(my - cy) AS oy FROM ext_box b JOIN (SELECT site_id, quantile_cont(mx, 0.5) AS cx, quantile_cont(my, 0.5) AS cy FROM ext_box GROUP BY ALL) m USING (site_id)")


@query("robust_extent", sql("""SELECT e.site_id, count(*)::BIGINT AS kept, min(x0) AS x0, min(y0) AS y0, max(xm) AS xm, max(ym) AS ym FROM ext_mid e JOIN (
    SELECT site_id, greatest(quantile_cont(ox, 0.5) * 1.4826e0, 50e0) AS sx, greatest(quantile_cont(oy, 0.5) * 1.4826e0, 50e0) AS sy FROM ext_mid GROUP BY ALL) d USING (site_id)
  WHERE ox <= sx * 5e0 AND oy <= sy * 5e0 GROUP BY ALL"""))
def robust_extent(t):
    """Extent of each site without its outliers."""
    return cl.robust_extent(_shifted(t))


# contours: a main box, a hole in it, a near copy of the main box and a part far away
CONTOURS = """SELECT s_suppkey {div} 4 AS site_id, s_suppkey AS piece, CASE WHEN (s_suppkey {div} 4) % 5 = 3 THEN 'order_boundary' WHEN (s_suppkey {div} 4) % 7 = 6 THEN 'other' ELSE 'territory' END AS kind,
  CASE s_suppkey % 4 WHEN 1 THEN 20 WHEN 3 THEN 900 + s_suppkey % 200 ELSE 0 END AS x0, CASE s_suppkey % 4 WHEN 1 THEN 30 ELSE 0 END AS y0,
  CASE s_suppkey % 4 WHEN 1 THEN 50 + s_suppkey % 20 WHEN 3 THEN 950 + s_suppkey % 200 ELSE 200 END AS xm, CASE s_suppkey % 4 WHEN 1 THEN 60 WHEN 2 THEN 150 - (s_suppkey {div} 4) % 3 ELSE 150 END AS ym FROM {s}"""
cte("contours", CONTOURS.format(div="//", s="supplier"))
cte("contour_cells", "SELECT site_id, piece, ix, unnest(range(y0, ym)) AS iy FROM (SELECT *, unnest(range(x0, xm)) AS ix FROM contours) q")


def _contours(t):
    return t.spark.sql(CONTOURS.format(div="div", s="{s}"), s=t.supplier)


SOURCE = """SELECT site_id, CASE WHEN t THEN 'territory' WHEN o THEN 'order_boundary' END AS source, CASE WHEN t THEN 'ok' WHEN o THEN 'order boundary only' ELSE 'missing' END AS status
  FROM (SELECT site_id, bool_or(kind = 'territory') AS t, bool_or(kind = 'order_boundary') AS o FROM contours GROUP BY ALL) q"""
cte("contour_source", SOURCE)
cte("dup_groups", """SELECT p.site_id, p.piece, least(p.piece, coalesce(min(o.other), p.piece)) AS group_piece FROM contours p LEFT JOIN (
    SELECT a.site_id, a.piece, b.piece AS other FROM contours a JOIN contours b ON a.site_id = b.site_id AND a.piece <> b.piece
    WHERE greatest(least(a.xm, b.xm) - greatest(a.x0, b.x0), 0) * greatest(least(a.ym, b.ym) - greatest(a.y0, b.y0), 0) / ((a.xm - a.x0) * (a.ym - a.y0)) > 0.99e0
      AND greatest(least(a.xm, b.xm) - greatest(a.x0, b.x0), 0) * greatest(least(a.ym, b.ym) - greatest(a.y0, b.y0), 0) / ((b.xm - b.x0) * (b.ym - b.y0)) > 0.99e0) o ON o.site_id = p.site_id AND o.piece = p.piece GROUP BY p.site_id, p.piece""")
cte("fold_pieces", "SELECT c.*, (xm - x0) * (ym - y0) AS n FROM contours c JOIN dup_groups USING (site_id, piece) WHERE piece = group_piece")
cte("fold_depth", """SELECT a.site_id, a.piece, a.n, count(*) FILTER ((b.n > a.n OR (b.n = a.n AND b.piece < a.piece))
    AND 100 * greatest(least(a.xm, b.xm) - greatest(a.x0, b.x0), 0) * greatest(least(a.ym, b.ym) - greatest(a.y0, b.y0), 0) > 99 * a.n) AS depth
  FROM fold_pieces a JOIN fold_pieces b ON a.site_id = b.site_id GROUP BY ALL""")
cte("combined", """SELECT site_id, count(*)::BIGINT AS area_m2 FROM (SELECT site_id, ix, iy, arg_max(depth, (-n, piece)) AS depth
    FROM contour_cells JOIN fold_depth USING (site_id, piece) GROUP BY ALL) q WHERE depth % 2 = 0 GROUP BY ALL""")


@query("territory_source", sql("SELECT * FROM contour_source"))
def territory_source(t):
    """Which contour is the site outline."""
    return te.source(_contours(t))


@query("near_duplicates", sql("SELECT * FROM dup_groups"))
def near_duplicates(t):
    """Contours that are copies of one another."""
    return te.near_duplicates(te.contour_cells(_contours(t)))


@query("dominant_cluster", sql("""SELECT c.site_id, c.piece, near OR context >= 5 AS kept FROM (SELECT c.*, sqrt(power(greatest(c.x0 - a.xm, a.x0 - c.xm, 0), 2) + power(greatest(c.y0 - a.ym, a.y0 - c.ym, 0), 2))
      <= sqrt(power(a.xm - a.x0, 2) + power(a.ym - a.y0, 2)) * 2e0 AS near, (SELECT count(*) FROM ext_plain b WHERE b.site_id = c.site_id AND b.x0 <= c.xm + 100 AND b.xm >= c.x0 - 100 AND b.y0 <= c.ym + 100 AND b.ym >= c.y0 - 100) AS context
    FROM contours c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY (xm - x0) * (ym - y0) DESC, piece) AS r FROM contours) q WHERE r = 1) a USING (site_id)) c""".replace(
    "ext_plain", "(SELECT site_id, gid, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0, max(greatest(x1, x2)) AS xm, max(greatest(y1, y2)) AS ym FROM edges GROUP BY ALL)")))
def dominant_cluster(t):
    """Parts that belong to the site."""
    return te.dominant_cluster(_contours(t), t.edges)


def _combined(t):
    cells = te.contour_cells(_contours(t))
    keep = te.near_duplicates(cells).filter("piece = group_piece").select("site_id", "piece")
    return te.combine(cells.join(keep, ["site_id", "piece"], "left_semi"))


@query("combine_holes", sql("SELECT * FROM combined"))
def combine_holes(t):
    """Area left after nested contours are folded."""
    return _combined(t)


@query("territory_or_error", sql("""SELECT s.site_id, c.source, CASE WHEN c.status = 'ok' AND coalesce(a.area_m2, 0) > 0 THEN a.area_m2 END AS area_m2,
    CASE WHEN c.status IS NULL THEN 'missing' WHEN c.status <> 'ok' THEN c.status WHEN coalesce(a.area_m2, 0) <= 0 THEN 'empty' ELSE 'ok' END AS status
  FROM sites s LEFT JOIN contour_source c USING (site_id) LEFT JOIN combined a USING (site_id)"""))
def territory_or_error(t):
    """Outline area or an explicit error for every site."""
    return te.territory_or_error(t.sites, te.source(_contours(t)), _combined(t))
