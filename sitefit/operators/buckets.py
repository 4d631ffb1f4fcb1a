"""Distance joins as equi-joins on a uniform grid.

Catalyst would plan a distance condition as a nested loop. Here the edge side is enumerated over the grid
cells it can reach, the point side keeps its one cell, and the join is an equi-join on (site, cell) with the
exact distance as a residual condition. A point-edge pair meets in exactly one cell, so nothing has to be
de-duplicated; adaptive skew splitting applies to the join because its keys are ordinary columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit.functions.geom import cell, point_distance, ray_crosses, segment_distance, segments_cross
from sitefit.session import stored

SITE = "site_id"


def to_cells(edges: DataFrame, size: float, reach: Column | float) -> DataFrame:
    """One row per (edge, grid cell within ``reach`` of it).

    A long edge is cut into pieces only to enumerate its cells; a cell shared with the piece before is emitted
    once, and the row keeps the original end points. ``reach`` must not exceed one and a half cells.
    """
    c = F.col
    reach = F.lit(float(reach)) if not isinstance(reach, Column) else reach
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / F.lit(4.0 * size))).cast("int")
    eps = F.lit(1e-6)

    def span(a: str, d: Column, i: Column) -> tuple[Column, Column]:
        p, q = c(a) + d * (i / c("_n")), c(a) + d * ((i + 1) / c("_n"))
        return cell(F.least(p, q) - reach - eps, size), cell(F.greatest(p, q) + reach + eps, size)

    cut = edges.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), c("_n") - 1)))
    (lx, hx), (ly, hy) = span("x1", dx, c("_i")), span("y1", dy, c("_i"))
    (px, qx), (py, qy) = span("x1", dx, c("_i") - 1), span("y1", dy, c("_i") - 1)
    seen = (c("_i") > 0) & c("cx").between(px, qx) & c("cy").between(py, qy)
    return (cut.withColumn("cx", F.explode(F.sequence(lx, hx))).withColumn("cy", F.explode(F.sequence(ly, hy)))
            .filter(~seen).drop("_n", "_i"))


def measured(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row, after the join below it.

    A plain ``withColumn`` followed by a filter is pushed into the join condition, where the long distance
    expression is expanded without sharing and becomes a method too large for the JIT. A one-element generator
    is not crossed by that rewrite.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def as_edges(points: DataFrame, *keep: str) -> DataFrame:
    """Points as zero-length edges."""
    return points.select(SITE, *keep, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


def box_distance(px, py, half, x1, y1, x2, y2) -> Column:
    """Distance from an axis-aligned square (half = 0 is a point) to a segment."""
    corners = [segment_distance(px + a * half, py + b * half, x1, y1, x2, y2) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    ends = []
    for ex, ey in ((x1, y1), (x2, y2)):
        ox = F.greatest(F.abs(ex - px) - half, F.lit(0.0))
        oy = F.greatest(F.abs(ey - py) - half, F.lit(0.0))
        ends.append(F.sqrt(ox * ox + oy * oy))
    through = (segments_cross(x1, y1, x2, y2, px - half, py - half, px + half, py + half)
               | segments_cross(x1, y1, x2, y2, px - half, py + half, px + half, py - half))
    square = F.when(through, F.lit(0.0)).otherwise(F.least(*corners, *ends))
    return F.when(half > 0, square).otherwise(segment_distance(px, py, x1, y1, x2, y2))


def near_pairs(points: DataFrame, edges: DataFrame, reach: Column | float, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(point, edge) rows closer than or exactly at ``reach``, with ``dist``. ``reach`` may be a column of the edges.

    Points with a ``size`` column are squares of that half side and are enumerated over the cells they cover.
    """
    right = to_cells(edges.withColumn("_reach", F.lit(float(reach)) if not isinstance(reach, Column) else reach), size, F.col("_reach"))
    c = F.col
    on = [SITE, "cx", "cy", *keys]
    if "size" in points.columns:
        h = c("size")
        gx = F.sequence(cell(c("x") - h, size), cell(c("x") + h, size))
        gy = F.sequence(cell(c("y") - h, size), cell(c("y") + h, size))
        left = points.withColumn("cx", F.explode(gx)).withColumn("cy", F.explode(gy))
        dist = box_distance(c("x"), c("y"), h, c("x1"), c("y1"), c("x2"), c("y2"))
    else:
        left = points.withColumn("cx", cell(c("x"), size)).withColumn("cy", cell(c("y"), size))
        dist = segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
    return measured(left.join(right, on), "dist", dist).filter(c("dist") <= c("_reach")).drop("_reach", "cx", "cy")


def near_few(points: DataFrame, edges: DataFrame, reach: float, size: float) -> DataFrame:
    """Like `near_pairs` for points that are few beside the edges: the points are enumerated over the cells within reach, the edges
    over their own cells only. A pair that shares several cells comes as often.
    """
    c = F.col
    square = "size" in points.columns
    out = F.lit(reach + 1e-6) + (c("size") * 2.0 if square else F.lit(0.0))
    gx, gy = (F.sequence(cell(c(v) - out, size), cell(c(v) + out, size)) for v in ("x", "y"))
    left = points.withColumn("cx", F.explode(gx)).withColumn("cy", F.explode(gy))
    dist = (box_distance(c("x"), c("y"), c("size"), c("x1"), c("y1"), c("x2"), c("y2")) if square
            else segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2")))
    return measured(left.join(to_cells(edges, size, 0.0), [SITE, "cx", "cy"]), "dist", dist).filter(c("dist") <= reach).drop("cx", "cy")


def nearest(points: DataFrame, edges: DataFrame, point_id: str, by: str, near: float = 24.0, far: float = 64.0,
            target: str | None = None) -> DataFrame:
    """Exact distance from every point to the nearest edge of each kind ``by`` present at its site.

    Two stages. Everything closer than ``near`` comes from one grid join, whose result is stored. For the (point, kind) pairs left
    over, the occupied coarse cells of a kind are a list in one row; lower and upper bounds of their distances leave the few cells
    that can hold the nearest edge, and only edges of those are measured. With ``target`` the id of the nearest edge owner is
    returned too (least id on ties) and an owner equal to the point's own id is skipped.
    """
    c = F.col
    if "half" in points.columns:
        dots, squares = points.filter(c("half") == 0).drop("half"), points.filter(c("half") > 0).withColumn("size", c("half"))
        return (nearest(dots, edges, point_id, by, near, far, target)
                .unionByName(nearest(squares.drop("half"), edges, point_id, by, near, far, target)))
    keep = [SITE, point_id, "x", "y"] + (["size"] if "size" in points.columns else [])
    points = points.select(*keep)
    cols = [SITE, by, "x1", "y1", "x2", "y2"] + ([target] if target else [])
    edges = edges.select(*cols)
    half = c("size") if "size" in points.columns else F.lit(0.0)
    if target:
        best = F.min(F.struct("dist", target)).alias("best")
        other = c(target) != c(point_id)
    else:
        best, other = F.min("dist").alias("best"), F.lit(True)

    close = stored(near_few(points, edges, near, near).filter(other).groupBy(SITE, point_id, by).agg(best))

    kinds = edges.groupBy(SITE).agg(F.collect_set(by).alias("_kinds"))
    known = close.groupBy(SITE, point_id).agg(F.collect_set(by).alias("_known"))
    rest = points.join(kinds, SITE).join(known, [SITE, point_id], "left")
    rest = rest.withColumn(by, F.explode(F.when(c("_known").isNull(), c("_kinds")).otherwise(F.array_except("_kinds", "_known")))).drop("_kinds", "_known")
    spread = to_cells(edges, far, 0.0)
    # with each cell the start of one of its edges; which one steers cost only
    occupied = spread.groupBy(SITE, by, "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.first("x1").alias("rx"), F.first("y1").alias("ry"))
    cells = occupied.groupBy(SITE, by).agg(F.collect_list(F.struct("cx", "cy", "n", "rx", "ry")).alias("_cells"))
    square = lambda a, b: a * a + b * b

    def bounds(w: Column) -> Column:
        """Squared distances: no edge of the cell is closer than ``low``, one is at most as far as ``high``."""
        ax, ay = w.cx * far - c("x"), w.cy * far - c("y")
        low = square(F.greatest(ax, -ax - far, F.lit(0.0)), F.greatest(ay, -ay - far, F.lit(0.0)))
        if not target:
            return F.struct(w.cx.alias("cx"), w.cy.alias("cy"), low.alias("low"), square(w.rx - c("x"), w.ry - c("y")).alias("high"))
        high = square(F.greatest(F.abs(ax), F.abs(ax + far)), F.greatest(F.abs(ay), F.abs(ay + far)))
        # the only edge of the point's own cell may be its own
        return F.struct(w.cx.alias("cx"), w.cy.alias("cy"), low.alias("low"), F.when((w.n > 1) | (low > 0), high).alias("high"))

    ways = rest.join(cells, [SITE, by]).withColumn("_cells", F.transform("_cells", bounds))
    reach = F.coalesce(F.sqrt(F.array_min(F.transform("_cells", lambda w: w.high))), F.lit(float("inf"))) + half * 2.0 + 1e-6
    ways = ways.withColumn("_reach", reach).withColumn("_cell", F.explode(F.filter("_cells", lambda w: F.sqrt(w.low) <= c("_reach"))))
    ways = ways.select(*keep, by, c("_cell.cx").alias("cx"), c("_cell.cy").alias("cy"))
    dist = (box_distance(c("x"), c("y"), half, c("x1"), c("y1"), c("x2"), c("y2")) if "size" in points.columns
            else segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2")))
    distant = measured(ways.join(spread, [SITE, by, "cx", "cy"]).filter(other), "dist", dist).groupBy(SITE, point_id, by).agg(best)
    out = close.unionByName(distant)
    if target:
        return out.select(SITE, point_id, by, c("best.dist").alias("dist"), c(f"best.{target}").alias(target))
    return out.withColumnRenamed("best", "dist")


def inside(points: DataFrame, edges: DataFrame, point_id: str, size: float = 16.0) -> DataFrame:
    """(site, point, gid) for every polygon holding the point: even-odd rule, holes are further rings of a gid.

    Each edge is enumerated over the cells of the polygon's own box to the left of the edge, so a point only
    meets edges of polygons whose box covers it.
    """
    c = F.col
    left_of = edges.groupBy(SITE, "gid").agg(F.min(F.least("x1", "x2")).alias("xmin"))
    gx = F.sequence(cell(c("xmin"), size), cell(F.greatest(c("x1"), c("x2")), size))
    gy = F.sequence(cell(F.least(c("y1"), c("y2")), size), cell(F.greatest(c("y1"), c("y2")), size))
    right = (edges.filter(c("y1") != c("y2")).select(SITE, "gid", "x1", "y1", "x2", "y2").join(left_of, [SITE, "gid"])
             .withColumn("cx", F.explode(gx)).withColumn("cy", F.explode(gy)).drop("xmin"))
    left = points.select(SITE, point_id, "x", "y", cell(c("x"), size).alias("cx"), cell(c("y"), size).alias("cy"))
    hit = ray_crosses(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
    return (measured(left.join(right, [SITE, "cx", "cy"]), "hit", hit).filter("hit").groupBy(SITE, point_id, "gid").agg(F.count(F.lit(1)).alias("n"))
            .filter(c("n") % 2 == 1).select(SITE, point_id, "gid"))


def inside_site(points: DataFrame, outline: DataFrame, point_id: str) -> DataFrame:
    """Points inside the outline of their own site."""
    edges = outline.withColumn("gid", F.lit(0).cast("long"))
    return inside(points, edges, point_id).select(SITE, point_id)


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers within ``keys`` without sorting a whole group in one task.

    ``bucket`` is an integer that never decreases along ``order``. Rows are numbered inside (keys, bucket) and
    shifted by the running count of the earlier buckets, which comes from a small pre-aggregated table.
    """
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    shifts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return (df.withColumn("_r", local).join(shifts, [*keys, "_b"])
            .withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before"))
