"""Closed shapes out of line soup, and dashed lines as geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, sql
from sitefit.operators import planar as pl

# Outlines drawn side by side: four lines a shape, some shapes inside the one before, some open with a stub instead of the last side,
# starts a little off the ends they should meet.
SOUP = """SELECT site_id, object_type, gid, 'line' AS geom_kind, 0 AS seq,
    ax + CASE side WHEN 0 THEN 0e0 WHEN 1 THEN w WHEN 2 THEN w + sk ELSE CASE WHEN open THEN w ELSE sk END END + (gid % 3) * 0.01e0 AS x1,
    ay + CASE side WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN h ELSE CASE WHEN open THEN 0e0 ELSE h END END AS y1,
    ax + CASE side WHEN 0 THEN w WHEN 1 THEN w + sk WHEN 2 THEN sk ELSE CASE WHEN open THEN w + 3e0 ELSE 0e0 END END AS x2,
    ay + CASE side WHEN 0 THEN 0e0 WHEN 1 THEN h WHEN 2 THEN h ELSE CASE WHEN open THEN -2e0 ELSE 0e0 END END AS y2
  FROM (SELECT *, (q * 7919 % 200) * 1e0 + CASE WHEN inner_ THEN 2e0 ELSE 0e0 END AS ax, (q * 104729 % 160) * 1e0 + CASE WHEN inner_ THEN 1e0 ELSE 0e0 END AS ay,
      CASE WHEN inner_ THEN 1e0 ELSE 4e0 + r % 9 END AS w, CASE WHEN inner_ THEN 1e0 ELSE 3e0 + r % 7 END AS h, (q % 4) * 0.5e0 AS sk, r % 5 = 0 AS open,
      CASE (q {div} 2) % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'existing_greenery' WHEN 2 THEN 'road' ELSE 'territory' END AS object_type
    FROM (SELECT o_orderkey {div} 600 AS site_id, o_orderkey AS gid, o_orderkey % 4 AS side, o_orderkey {div} 4 AS r, (o_orderkey {div} 4) % 6 = 1 AS inner_,
        o_orderkey {div} 4 - CASE WHEN (o_orderkey {div} 4) % 6 = 1 THEN 1 ELSE 0 END AS q FROM {orders}) a) b"""
cte("soup", SOUP.format(div="//", orders="orders"))


def _soup(t):
    return t.spark.sql(SOUP.format(div="div", orders="{orders}"), orders=t.orders)


def planar_ctes(p: str, source: str, grid: float) -> None:
    """The planar map in SQL: pairs of lines one by one, faces by walking from every half-edge until it comes back."""
    snap = lambda n: f"CAST(floor({n} / {grid!r} + 0.5e0) AS BIGINT)"
    a, b = f"{{'x': {snap('x1')}, 'y': {snap('y1')}}}", f"{{'x': {snap('x2')}, 'y': {snap('y2')}}}"
    side = lambda u, v, w: f"(({v}.x - {u}.x) * ({w}.y - {u}.y) - ({v}.y - {u}.y) * ({w}.x - {u}.x))"
    cte(f"{p}_seg", f"SELECT DISTINCT site_id, object_type, least({a}, {b}) AS p, greatest({a}, {b}) AS q FROM ({source}) z WHERE {a} <> {b}")
    cte(f"{p}_pair", f"""SELECT a.site_id, a.object_type, a.p, a.q, b.p AS r, b.q AS s, {side('a.p', 'a.q', 'b.p')} AS oa, {side('a.p', 'a.q', 'b.q')} AS ob, {side('b.p', 'b.q', 'a.p')} AS oc, {side('b.p', 'b.q', 'a.q')} AS od
        FROM {p}_seg a JOIN {p}_seg b ON a.site_id = b.site_id AND a.object_type = b.object_type AND row(a.p, a.q) < row(b.p, b.q)""")
    at = lambda n: f"p.{n} * 100 + CAST(floor(2 * 100 * oc * (q.{n} - p.{n})::HUGEINT / (2e0 * (oc - od)) + 0.5e0) AS BIGINT)"
    whole = lambda n: f"{{'x': {n}.x * 100, 'y': {n}.y * 100}}"
    on = lambda u, v, w, o: f"SELECT site_id, object_type, {u} AS p, {v} AS q, {whole(w)} AS pt FROM {p}_pair WHERE {o} = 0 AND {w}.x BETWEEN {u}.x AND {v}.x AND {w}.y BETWEEN least({u}.y, {v}.y) AND greatest({u}.y, {v}.y)"
    met = f"(SELECT *, {{'x': {at('x')}, 'y': {at('y')}}} AS pt FROM {p}_pair WHERE sign(oa) * sign(ob) < 0 AND sign(oc) * sign(od) < 0)"
    cte(f"{p}_cut", f"""SELECT site_id, object_type, p, q, pt FROM {met} UNION SELECT site_id, object_type, r, s, pt FROM {met} UNION {on('p', 'q', 'r', 'oa')} UNION {on('p', 'q', 's', 'ob')}
        UNION {on('r', 's', 'p', 'oc')} UNION {on('r', 's', 'q', 'od')} UNION SELECT site_id, object_type, p, q, {whole('p')} FROM {p}_seg UNION SELECT site_id, object_type, p, q, {whole('q')} FROM {p}_seg""")
    cte(f"{p}_piece", f"""SELECT site_id, object_type, u, v, row_number() OVER () AS e FROM (SELECT DISTINCT site_id, object_type, least(pt, nx) AS u, greatest(pt, nx) AS v FROM (
        SELECT *, lead(pt) OVER (PARTITION BY site_id, object_type, p, q ORDER BY (pt.x - p.x * 100) * (q.x - p.x) + (pt.y - p.y * 100) * (q.y - p.y)) AS nx FROM {p}_cut) z WHERE nx IS NOT NULL AND nx <> pt) y""")
    cte(f"{p}_half", f"SELECT site_id, object_type, e * 2 AS id, u, v FROM {p}_piece UNION ALL SELECT site_id, object_type, e * 2 + 1, v, u FROM {p}_piece")
    for step, rows in ((1, f"{p}_half"), (2, f"{p}_left")):
        cte(f"{p}_prev{step}", f"""SELECT *, xor(coalesce(lead(id) OVER w, first_value(id) OVER w), 1) AS prev FROM {rows}
            WINDOW w AS (PARTITION BY site_id, object_type, u ORDER BY atan2(CAST(v.y - u.y AS DOUBLE), CAST(v.x - u.x AS DOUBLE)))""")
        cte(f"{p}_walk{step}", f"SELECT id AS start, id AS cur, 0 AS n FROM {p}_prev{step} UNION ALL SELECT start, prev, n + 1 FROM {p}_walk{step} JOIN {p}_prev{step} ON id = cur WHERE prev <> start")
        cte(f"{p}_face{step}", f"SELECT h.*, f.label FROM {p}_prev{step} h JOIN (SELECT start AS id, min(cur) AS label FROM {p}_walk{step} GROUP BY start) f USING (id)")
        if step == 1:
            cte(f"{p}_loose", f"SELECT a.id // 2 AS e FROM {p}_face1 a JOIN {p}_face1 b ON a.id % 2 = 0 AND b.id = a.id + 1 AND a.label = b.label")
            cte(f"{p}_left", f"SELECT * FROM {p}_half WHERE id // 2 NOT IN (SELECT e FROM {p}_loose)")
    cte(f"{p}_rest", f"""SELECT site_id, object_type, CASE WHEN between_ = 0 OR between_ = total THEN 'dangle' ELSE 'cut' END AS kind, u, v FROM {p}_piece JOIN (
        SELECT w.start // 2 AS e, count(*) FILTER (w.cur // 2 NOT IN (SELECT e FROM {p}_loose)) AS total, count(*) FILTER (w.cur // 2 NOT IN (SELECT e FROM {p}_loose) AND w.n < t.n) AS between_
        FROM {p}_walk1 w JOIN {p}_walk1 t ON t.start = w.start AND t.cur = w.start + 1 WHERE w.start % 2 = 0 AND w.start // 2 IN (SELECT e FROM {p}_loose) GROUP BY w.start // 2) b USING (e)""")
    scale = 100 / grid
    cte(f"{p}_ring", f"""SELECT site_id, object_type, label, sum(CAST(u.x AS HUGEINT) * v.y - CAST(v.x AS HUGEINT) * u.y) AS area2, count(*) AS points, min(u) AS low, max(u).x / {scale!r} AS px, max(u).y / {scale!r} AS py FROM {p}_face2 GROUP BY ALL""")
    cte(f"{p}_wall", f"SELECT f.site_id, f.object_type, f.label, r.area2, u.x / {scale!r} AS x1, u.y / {scale!r} AS y1, v.x / {scale!r} AS x2, v.y / {scale!r} AS y2 FROM {p}_face2 f JOIN {p}_ring r ON f.label = r.label AND r.area2 > 0")
    cte(f"{p}_hole", f"""SELECT label, area2, points, arg_min(shell, (shell_area2, shell)) AS shell FROM (
        SELECT h.label, h.area2, h.points, e.label AS shell, e.area2 AS shell_area2 FROM {p}_ring h JOIN {p}_wall e ON h.site_id = e.site_id AND h.object_type = e.object_type AND h.area2 < 0 WHERE {cross('px', 'py')}
        GROUP BY ALL HAVING count(*) % 2 = 1) z GROUP BY label, area2, points""")
    cte(f"{p}_poly", f"""SELECT r.site_id, r.object_type, r.label, r.low.x / {scale!r} AS x, r.low.y / {scale!r} AS y, CAST(r.points + coalesce(sum(h.points), 0) AS BIGINT) AS points, count(h.label) AS holes,
        CAST(r.area2 + coalesce(sum(h.area2), 0) AS BIGINT) / {2.0 * scale * scale!r} AS area_m2 FROM {p}_ring r LEFT JOIN {p}_hole h ON h.shell = r.label WHERE r.area2 > 0 GROUP BY r.site_id, r.object_type, r.label, r.low, r.points, r.area2""")


NOTHING = "nothing_ AS (SELECT 1)"
planar_ctes("net", "SELECT * FROM soup", 0.05)


@query("polygonize", sql("SELECT site_id, object_type, x, y, points, holes, area_m2 FROM net_poly", NOTHING))
def polygonize(t):
    """Polygons closed by the lines of each type: least vertex, points of all rings, holes, area."""
    return pl.polygons(pl.planar_map(_soup(t), 0.05))


@query("polygonize_leftovers", sql("SELECT site_id, object_type, kind, u.x / 2000e0 AS x1, u.y / 2000e0 AS y1, v.x / 2000e0 AS x2, v.y / 2000e0 AS y2 FROM net_rest", NOTHING))
def polygonize_leftovers(t):
    """Pieces that close nothing: dangles, and cuts between rings."""
    found = pl.planar_map(_soup(t), 0.05)
    return found.leftovers.select("site_id", "object_type", "kind", *[(F.col(n) / F.lit(found.scale)).alias(n) for n in pl.NODE])


def _soup_and_shapes(t):
    """The soup next to the polygons of the site tables."""
    return _soup(t).unionByName(t.edges.filter("geom_kind = 'polygon'").select("site_id", "object_type", "gid", "geom_kind", F.col("seq").cast("int").alias("seq"), *pl.NODE))


for _name, (_grid, _) in fx.CLOSED_OUTLINES.items():
    planar_ctes(f"fp_{_name}", f"SELECT * FROM soup WHERE object_type = '{_name}'", _grid)


def _footprint_sql() -> str:
    parts = ["SELECT e.site_id, e.object_type, 'drawn' AS source, count(DISTINCT gid) AS n, count(*) AS edges, 0e0 AS inflate_m FROM edges e WHERE geom_kind = 'polygon' AND object_type IN (" + ", ".join(f"'{n}'" for n in fx.CLOSED_OUTLINES) + ") GROUP BY ALL"]
    for name, (_, inflate) in fx.CLOSED_OUTLINES.items():
        parts.append(f"SELECT site_id, object_type, 'closed', count(*), CAST(sum(points) AS BIGINT), 0e0 FROM fp_{name}_poly GROUP BY ALL")
        if inflate:
            parts.append(f"SELECT site_id, object_type, 'leftover', count(*), count(*), {inflate!r}::DOUBLE FROM fp_{name}_rest GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query("footprints", sql(_footprint_sql(), NOTHING))
def footprints(t):
    """Outlines closed by type with the grid and width of each type: shapes and edges by site and origin."""
    out = None
    for rule in dict.fromkeys(fx.CLOSED_OUTLINES.values()):  # types with the same rule share a map
        names = [name for name, own in fx.CLOSED_OUTLINES.items() if own == rule]
        own = pl.footprints(_soup_and_shapes(t).filter(F.col("object_type").isin(names)), *rule)
        out = own if out is None else out.unionByName(own)
    return out.groupBy("site_id", "object_type", "source", "inflate_m").agg(F.count_distinct("gid").alias("n"), F.count(F.lit(1)).alias("edges"))


planar_ctes("loop", "SELECT * FROM soup WHERE object_type = 'road'", 0.1)


@query("road_loops", sql("""SELECT site_id, TRUE AS reconstructed_loop, count(*) AS n, CAST(sum(points) AS BIGINT) AS edges FROM loop_poly GROUP BY ALL
    UNION ALL SELECT site_id, FALSE, count(*), count(*) FROM soup WHERE object_type = 'road' GROUP BY ALL""", NOTHING))
def road_loops(t):
    """Road lines of each site and the loops added beside them."""
    out = pl.road_loops(_soup(t).filter("object_type = 'road'"), fx.ROAD_LOOP_GRID_M)
    return out.groupBy("site_id", "reconstructed_loop").agg(F.count_distinct("gid").alias("n"), F.count(F.lit(1)).alias("edges"))
