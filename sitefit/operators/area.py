"""Area analysis on cell tables: a raster is a table of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefit.operators.buckets import SITE

#: Side of a cell in metres, the same for every site however large.
STEP_M = 2.0
#: Cells of the joins of points with constraints. Edges are written out to all cells in reach, so that narrow ones multiply them; one
#: width for all kinds of constraints, so that the points are shuffled once for all.
WIDE_M = 24.0


def site_frame(outline: DataFrame, step: Column | float = STEP_M) -> DataFrame:
    """Area, bounds and grid step of every site; rings other than 0 are holes."""
    c = F.col
    twice = F.sum(c("xc1") * c("yc2") - c("xc2") * c("yc1"))
    rings = outline.groupBy(SITE, "ring").agg(F.abs(twice).alias("a2"), F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x1").alias("xm"), F.max("y1").alias("ym"))
    site = rings.groupBy(SITE).agg((F.sum(F.when(c("ring") == 0, c("a2")).otherwise(-c("a2"))) / F.lit(20000.0)).alias("area_m2"),
                                   F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("xm").alias("xm"), F.max("ym").alias("ym"))
    return site.withColumn("step", step if isinstance(step, Column) else F.lit(float(step)))


def raster(outline: DataFrame, step: Column | float = STEP_M) -> DataFrame:
    """Frame of every site with its numbers of raster columns and lines."""
    c = F.col
    count = lambda low, high: F.ceil((c(high) - (c(low) + c("step") / 2.0)) / c("step"))
    return site_frame(outline, step).withColumn("nx", count("x0", "xm")).withColumn("ny", count("y0", "ym"))


def _numbers(low: Column, high: Column, count: str) -> Column:
    """Raster numbers of a range of places measured in steps from the first centre, one more on either side."""
    a, b = F.greatest(F.floor(low) - 1, F.lit(0).cast("long")), F.least(F.ceil(high) + 1, F.col(count) - 1)
    return F.explode(F.when(a <= b, F.sequence(a, b)))


def _centre(first: str, number: str) -> Column:
    return F.col(first) + F.col("step") / 2.0 + F.col(number) * F.col("step")


def cells_inside(edges: DataFrame, frames: DataFrame, *keys: str) -> DataFrame:
    """Cells whose centre lies in the shape that the edges of (site, keys) close, by the even-odd rule of `ray_crosses`.

    Raster lines are cut with the edges and the cells between two cuts written out: cells are made once and joined with nothing.
    """
    from pyspark.sql import Window as W

    c = F.col
    up = c("y1") <= c("y2")
    ends = {"xa": F.when(up, c("x1")).otherwise(c("x2")), "ya": F.least("y1", "y2"), "xb": F.when(up, c("x2")).otherwise(c("x1")), "yb": F.greatest("y1", "y2")}
    e = edges.filter(c("y1") != c("y2")).select(SITE, *keys, *(v.alias(k) for k, v in ends.items())).join(frames, SITE)
    at = lambda v, first: (v - c(first)) / c("step") - 0.5
    rows = e.withColumn("iy", _numbers(at(c("ya"), "y0"), at(c("yb"), "y0"), "ny")).withColumn("y", _centre("y0", "iy")).filter((c("ya") <= c("y")) & (c("y") < c("yb")))
    rows = rows.withColumn("cut", c("xa") + (c("y") - c("ya")) * (c("xb") - c("xa")) / (c("yb") - c("ya"))).drop(*ends)
    line = W.partitionBy(SITE, *keys, "iy").orderBy("cut")
    rows = rows.withColumn("r", F.row_number().over(line)).withColumn("next", F.lead("cut").over(line)).filter((c("r") % 2 == 1) & (c("next") > c("cut")))
    # the cuts are few and their cells many: the number of tasks goes by the cells
    rows = rows.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), SITE, *keys, "iy")
    rows = rows.withColumn("ix", _numbers(at(c("cut"), "x0"), at(c("next"), "x0"), "nx")).withColumn("x", _centre("x0", "ix"))
    return rows.filter((c("x") >= c("cut")) & (c("x") < c("next"))).withColumn("cell_id", c("ix") * 1000000 + c("iy"))


def cells_near(edges: DataFrame, frames: DataFrame, reach: Column) -> DataFrame:
    """Cells within ``reach`` of each edge, with ``dist``: written out from the edge, column by column, along its part in reach of the column."""
    from sitefit.functions.geom import segment_distance
    from sitefit.operators.buckets import measured

    c = F.col
    slack = 1e-6
    # edges of one place share a task, so that their cells meet before they are shuffled
    tile = [F.floor(c(v) / 64.0) for v in ("x1", "y1")]
    e = edges.withColumn("_r", reach).filter(c("_r") >= 0).join(frames, SITE)
    e = e.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), c(SITE), *tile)
    at = lambda v, first: (v - c(first)) / c("step") - 0.5
    r, dx, dy = c("_r") + slack, c("x2") - c("x1"), c("y2") - c("y1")
    rows = e.withColumn("ix", _numbers(at(F.least("x1", "x2") - r, "x0"), at(F.greatest("x1", "x2") + r, "x0"), "nx")).withColumn("x", _centre("x0", "ix"))
    part = lambda v: F.when(F.abs(dx) > slack, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - c("x1")) / dx)))
    p, q = c("y1") + F.coalesce(part(c("x") - r), F.lit(0.0)) * dy, c("y1") + F.coalesce(part(c("x") + r), F.lit(1.0)) * dy
    rows = rows.withColumn("iy", _numbers(at(F.least(p, q) - r, "y0"), at(F.greatest(p, q) + r, "y0"), "ny")).withColumn("y", _centre("y0", "iy"))
    rows = measured(rows, "dist", segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))).filter(c("dist") <= c("_r"))
    return rows.withColumn("cell_id", c("ix") * 1000000 + c("iy"))


def site_grid(outline: DataFrame, step: float = STEP_M) -> DataFrame:
    """Cell centres inside each site: (site, ix, iy, cell_id, x, y, step)."""
    cells = cells_inside(outline.select(SITE, "x1", "y1", "x2", "y2"), raster(outline, step))
    return cells.select(SITE, "cell_id", "ix", "iy", "x", "y", "step", "area_m2")


def required_reach(edges: DataFrame, planting_type: str) -> DataFrame:
    """Constraint edges with the resolved distance of a planting type (species unknown)."""
    from sitefit.functions.rules import with_resolution
    from sitefit.operators.compliance import constraint_edges

    rows = constraint_edges(edges).withColumn("planting_type", F.lit(planting_type)).withColumn("species", F.lit(""))
    return with_resolution(rows).select(SITE, "gid", "object_type", "geom_kind", "x1", "y1", "x2", "y2", "required_m")


MARGIN_KEY, HARD_KEY = "territory_margin", "hard_obstacles"


def blocker_cells(cells: DataFrame, edges: DataFrame, outline: DataFrame, planting_type: str, point_id: str = "cell_id") -> DataFrame:
    """Distinct (cell, blocker): every object type within its distance, the site margin, and hard obstacles."""
    from sitefit import fixed as fx
    from sitefit.operators.buckets import inside, near_pairs

    c = F.col
    at = cells.select(SITE, point_id, "x", "y")
    rules = required_reach(edges, planting_type)
    by_type = near_pairs(at, rules.select(SITE, "object_type", "x1", "y1", "x2", "y2", "required_m"), c("required_m"), WIDE_M).select(
        SITE, point_id, c("object_type").alias("blocker"))
    areas = edges.filter(c("geom_kind") == "polygon")
    kinds = areas.select(SITE, "gid", "object_type").distinct()
    held = inside(at, areas.filter(c("object_type").isin(sorted({r[0] for r in fx.SETBACKS} | set(fx.HARD_OBSTACLES)))), point_id, WIDE_M).join(kinds, [SITE, "gid"])
    known = held.filter(c("object_type").isin([r[0] for r in fx.SETBACKS])).select(SITE, point_id, c("object_type").alias("blocker"))
    solid = held.filter(c("object_type").isin(list(fx.HARD_OBSTACLES))).select(SITE, point_id, F.lit(HARD_KEY).alias("blocker"))
    norms = next(r for r in fx.TYPE_NORMS if r[0] == planting_type)
    margin = near_pairs(at, outline.select(SITE, "x1", "y1", "x2", "y2"), norms[4], WIDE_M).select(SITE, point_id, F.lit(MARGIN_KEY).alias("blocker"))
    out = by_type.unionByName(known).unionByName(solid).unionByName(margin)
    if planting_type != "lawn":
        trunks = edges.filter((c("geom_kind") == "point") & (c("object_type") == "existing_greenery")).select(SITE, "x1", "y1", "x2", "y2")
        out = out.unionByName(near_pairs(at, trunks, norms[2], WIDE_M).select(SITE, point_id, F.lit(HARD_KEY).alias("blocker")))
    return out.distinct()


def grid_blockers(cells: DataFrame, edges: DataFrame, outline: DataFrame, planting_type: str, step: float = STEP_M) -> DataFrame:
    """`blocker_cells` of the cells of `site_grid`: blockers write out the cells they close, as bits of one number a cell."""
    from sitefit import fixed as fx
    from sitefit.operators.compliance import CHECKED_TYPES

    c = F.col
    names = [*CHECKED_TYPES, MARGIN_KEY, HARD_KEY]
    if len(names) > 63:
        raise ValueError("more kinds of blockers than bits")
    frames = raster(outline, step)
    norms = next(r for r in fx.TYPE_NORMS if r[0] == planting_type)
    key = lambda name: F.lit(name).alias("blocker")
    ends = (SITE, "x1", "y1", "x2", "y2")
    near = required_reach(edges, planting_type).select(*ends, "required_m", c("object_type").alias("blocker"))
    near = near.unionByName(outline.select(*ends, F.lit(norms[4]).cast("double").alias("required_m"), key(MARGIN_KEY)))
    if planting_type != "lawn":
        trunks = edges.filter((c("geom_kind") == "point") & (c("object_type") == "existing_greenery"))
        near = near.unionByName(trunks.select(*ends, F.lit(norms[2]).cast("double").alias("required_m"), key(HARD_KEY)))
    areas = edges.filter((c("geom_kind") == "polygon") & c("object_type").isin(sorted({r[0] for r in fx.SETBACKS} | set(fx.HARD_OBSTACLES))))
    held = cells_inside(areas.select(*ends, "gid", "object_type"), frames, "gid", "object_type")
    bit = lambda name: F.coalesce(*[F.when(name == n, F.lit(1 << k)) for k, n in enumerate(names)]).cast("long")
    known = F.when(c("object_type").isin([r[0] for r in fx.SETBACKS]), bit(c("object_type"))).otherwise(F.lit(0).cast("long"))
    solid = F.when(c("object_type").isin(list(fx.HARD_OBSTACLES)), F.lit(1 << names.index(HARD_KEY))).otherwise(F.lit(0)).cast("long")
    bits = cells_near(near.withColumn("bit", bit(c("blocker"))).drop("blocker"), frames, c("required_m")).select(SITE, "cell_id", "bit")
    bits = bits.unionByName(held.select(SITE, "cell_id", known.bitwiseOR(solid).alias("bit")))
    closed = bits.groupBy(SITE, "cell_id").agg(F.bit_or("bit").alias("bits")).join(cells.select(SITE, "cell_id"), [SITE, "cell_id"], "left_semi")
    return closed.select(SITE, "cell_id", F.explode(F.array_compact(F.array(*[F.when(c("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, n) for k, n in enumerate(names)]))).alias("blocker"))


def area_budget(cells: DataFrame, blocked: DataFrame) -> DataFrame:
    """Usable area and the share closed by each blocker."""
    c = F.col
    total = cells.groupBy(SITE, "area_m2").agg(F.count(F.lit(1)).alias("cells"))
    closed = blocked.groupBy(SITE, "cell_id").agg(F.count(F.lit(1)).alias("cover"), F.min("blocker").alias("only"))
    free = total.join(closed.groupBy(SITE).agg(F.count(F.lit(1)).alias("closed")), SITE, "left").fillna(0, ["closed"])
    free = free.withColumn("usable", c("cells") - c("closed"))
    shares = blocked.groupBy(SITE, "blocker").agg(F.count(F.lit(1)).alias("n"))
    alone = closed.filter("cover = 1").groupBy(SITE, c("only").alias("blocker")).agg(F.count(F.lit(1)).alias("alone"))
    rows = free.join(shares, SITE, "left").join(alone, [SITE, "blocker"], "left").fillna(0, ["alone"])
    return rows.select(SITE, "area_m2", (c("area_m2") * c("usable") / c("cells")).alias("usable_m2"), (c("usable") / c("cells")).alias("usable_share"),
                       "blocker", (c("n") / c("cells")).alias("share"), (c("area_m2") * c("alone") / c("cells")).alias("exclusive_m2"))


def budget_of_strips(sums: DataFrame, frames: DataFrame) -> DataFrame:
    """`area_budget` from the sums of each strip (`ground.strip_budget`)."""
    c = F.col
    total = sums.filter("blocker is null").groupBy(SITE).agg(F.sum("n").alias("cells"), F.sum("alone").alias("closed"))
    by = sums.filter("blocker is not null").groupBy(SITE, "blocker").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"))
    rows = total.join(frames.select(c(SITE).cast("long").alias(SITE), "area_m2"), SITE).withColumn("usable", c("cells") - c("closed"))
    rows = rows.join(by, SITE, "left").fillna(0, ["alone"])
    return rows.select(SITE, "area_m2", (c("area_m2") * c("usable") / c("cells")).alias("usable_m2"), (c("usable") / c("cells")).alias("usable_share"),
                       "blocker", (c("n") / c("cells")).alias("share"), (c("area_m2") * c("alone") / c("cells")).alias("exclusive_m2"))


def zones_advice(budget: DataFrame, interval_m: float) -> DataFrame:
    """The blocker that frees most area when lifted alone, and how many more items would fit."""
    c = F.col
    best = budget.filter(c("exclusive_m2") > 0).groupBy(SITE).agg(
        F.count(F.lit(1)).alias("groups"), F.max(F.struct("exclusive_m2", "blocker")).alias("b"))
    return best.select(SITE, "groups", c("b.blocker").alias("blocker"), c("b.exclusive_m2").alias("exclusive_m2"),
                       F.floor(c("b.exclusive_m2") / (interval_m * interval_m)).cast("long").alias("extra_items"))


def buildable(cells: DataFrame, blocked: DataFrame, point_id: str = "cell_id") -> DataFrame:
    return cells.join(blocked.select(SITE, point_id), [SITE, point_id], "left_anti")


def least_room(points: DataFrame, edges: DataFrame, planting_type: str, point_id: str, cap: float = 5.0) -> DataFrame:
    """(site, point, clearance_m), a row per id of a point that a constraint comes within ``cap`` of beyond its required distance."""
    from sitefit.operators.buckets import near_pairs

    c = F.col
    rules = required_reach(edges, planting_type).select(SITE, "x1", "y1", "x2", "y2", "required_m", (c("required_m") + cap).alias("r"))
    near = near_pairs(points.select(SITE, point_id, "x", "y"), rules, c("r"), WIDE_M)
    return near.groupBy(SITE, point_id).agg(F.min(c("dist") - c("required_m")).alias("clearance_m"))


def grid_clearance(cells: DataFrame, edges: DataFrame, outline: DataFrame, planting_type: str, cap: float = 5.0, step: float = STEP_M) -> DataFrame:
    """`clearance` of cells of `site_grid`: edges write out the cells around them."""
    c = F.col
    rules = required_reach(edges, planting_type).select(SITE, "x1", "y1", "x2", "y2", "required_m")
    found = cells_near(rules, raster(outline, step), c("required_m") + cap).groupBy(SITE, "cell_id").agg(F.min(c("dist") - c("required_m")).alias("clearance_m"))
    return cells.select(SITE, "cell_id").join(found, [SITE, "cell_id"], "left").withColumn("clearance_m", capped_room(cap))


def capped_room(cap: float = 5.0) -> Column:
    return F.coalesce(F.least("clearance_m", F.lit(cap)), F.lit(cap))


def clearance(points: DataFrame, edges: DataFrame, planting_type: str, point_id: str, cap: float = 5.0) -> DataFrame:
    """How much farther than required the nearest constraint is, capped; negative inside a setback."""
    found = least_room(points, edges, planting_type, point_id, cap)
    return points.select(SITE, point_id).join(found, [SITE, point_id], "left").withColumn("clearance_m", capped_room(cap))


def runs_of(cells: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring cells in one raster line."""
    from pyspark.sql import Window as W

    c = F.col
    line = W.partitionBy(SITE, "iy").orderBy("ix")
    rows = cells.withColumn("key", c("ix") - F.row_number().over(line))
    return rows.groupBy(SITE, "iy", "key").agg(F.min("ix").alias("a"), F.max("ix").alias("b"), F.min("cell_id").alias("run_id"), F.count(F.lit(1)).alias("cells")).drop("key")


def labelled_runs(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with the patch they belong to (``label``), and the links between runs of neighbouring lines."""
    from sitefit.operators.iterate import components

    c = F.col
    runs = runs_of(cells)
    above = runs.select(SITE, (c("iy") - 1).alias("iy"), c("a").alias("a2"), c("b").alias("b2"), c("run_id").alias("other"))
    links = runs.join(above, [SITE, "iy"]).filter((c("a") <= c("b2")) & (c("a2") <= c("b"))).select(SITE, c("run_id").alias("u"), c("other").alias("v"))
    labels = components(runs.select(SITE, c("run_id").alias("node")), links)
    return runs.join(labels.withColumnRenamed("node", "run_id"), [SITE, "run_id"]), links


def patch_of(cells: DataFrame) -> DataFrame:
    """(site, cell_id, patch_id): the connected part of the cell set that each cell belongs to."""
    parts, _ = labelled_runs(cells)
    span = parts.select(SITE, "iy", F.explode(F.sequence("a", "b")).alias("ix"), F.col("label").alias("patch_id"))
    return cells.select(SITE, "cell_id", "ix", "iy").join(span, [SITE, "ix", "iy"]).select(SITE, "cell_id", "patch_id")


def patches(cells: DataFrame) -> DataFrame:
    """Connected parts of a cell set (four neighbours): components of runs that touch the run above."""
    c = F.col
    parts, links = labelled_runs(cells)
    runs = parts.select(SITE, "iy", "a", "b", "run_id", "cells")
    step = cells.select(SITE, "step").distinct()
    sides = links.join(runs.select(SITE, c("run_id").alias("u"), c("a").alias("ua"), c("b").alias("ub")), [SITE, "u"]).join(
        runs.select(SITE, c("run_id").alias("v"), c("a").alias("va"), c("b").alias("vb")), [SITE, "v"]).groupBy(SITE, c("u").alias("run_id")).agg(
        F.sum(F.least("ub", "vb") - F.greatest("ua", "va") + 1).alias("shared"))
    rows = parts.join(sides, [SITE, "run_id"], "left").fillna(0, ["shared"]).groupBy(SITE, c("label").alias("patch_id")).agg(
        F.sum("cells").alias("cells"), (F.sum(c("cells") * 2 + 2) - F.sum("shared") * 2).alias("sides"))
    return rows.join(step, SITE).select(SITE, "patch_id", "cells", (c("cells") * c("step") * c("step")).alias("area_m2"), (c("sides") * c("step")).alias("perimeter_m"))


def legend_raster(features: DataFrame, edges: DataFrame, pixel: float) -> DataFrame:
    """Pixels touched by each legend group: edges sampled at pixel steps."""
    from sitefit.operators.measures import legend_key

    c = F.col
    keyed = edges.join(features.select(SITE, "gid", legend_key().alias("grp")), [SITE, "gid"])
    steps = F.ceil(F.greatest(F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1"))) / pixel)
    rows = keyed.withColumn("n", F.greatest(steps, F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), c("n"))))
    at = lambda a, b: F.floor((c(a) + (c(b) - c(a)) * (c("i") / c("n"))) / pixel).cast("long")
    return rows.select(SITE, "grp", at("x1", "x2").alias("px"), at("y1", "y2").alias("py")).groupBy(SITE, "grp").agg(
        F.countDistinct("px", "py").alias("pixels"))


def scan_fill(edges: DataFrame, size: float) -> DataFrame:
    """Cells of polygon interiors line by line: sorted crossings, filled between pairs."""
    from pyspark.sql import Window as W

    c = F.col
    up = c("y1") <= c("y2")
    e = edges.filter(c("geom_kind") == "polygon").select(SITE, "gid", F.when(up, c("x1")).otherwise(c("x2")).alias("xa"), F.least("y1", "y2").alias("ya"),
                                                         F.when(up, c("x2")).otherwise(c("x1")).alias("xb"), F.greatest("y1", "y2").alias("yb")).filter(c("yb") > c("ya"))
    lines = F.sequence(F.floor(c("ya") / size).cast("long"), F.floor(c("yb") / size).cast("long"))
    rows = e.withColumn("iy", F.explode(lines)).withColumn("py", (c("iy") + 0.5) * size).filter((c("ya") <= c("py")) & (c("py") < c("yb")))
    rows = rows.withColumn("cross", c("xa") + (c("py") - c("ya")) * (c("xb") - c("xa")) / (c("yb") - c("ya")))
    w = W.partitionBy(SITE, "gid", "iy").orderBy("cross")
    rows = rows.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("cross").over(w)).filter((c("r") % 2 == 1) & c("next").isNotNull())
    lo, hi = F.ceil(c("cross") / size - 0.5).cast("long"), F.ceil(c("next") / size - 0.5).cast("long") - 1
    return rows.withColumn("lo", lo).withColumn("hi", hi).filter(c("hi") >= c("lo")).groupBy(SITE, "gid").agg(F.sum(c("hi") - c("lo") + 1).alias("cells"))


def roomiest(cells: DataFrame, room: DataFrame, keys: DataFrame, disc_m: float, least: float = 0.0) -> DataFrame:
    """Spots with most room in each patch, one after another, each taking a disc around itself, until no cell with ``least`` room is left.

    The same spots as picking them one by one (most room first, then the lower cell): in a round every cell is taken that no
    better one lies near, at all places at once. Two cells of one square of side disc / sqrt(2) always exclude each other, so only
    the best of each square has to be compared, with the cells of the squares around it. ``round`` numbers the spots of a patch.
    """
    from pyspark.sql import Window as W

    from sitefit.session import discard, new_table, stored

    c, side = F.col, disc_m / 2.0 ** 0.5
    spark = cells.sparkSession
    here = [SITE, "patch_id", "sx", "sy"]
    rows = cells.select(SITE, "cell_id", "x", "y").join(room, [SITE, "cell_id"]).join(keys, [SITE, "cell_id"]).filter(c("clearance_m") >= least)
    path = new_table(spark)
    left = stored(rows.select(SITE, "patch_id", "cell_id", "x", "y", "clearance_m", F.floor(c("x") / side).alias("sx"), F.floor(c("y") / side).alias("sy")), path)
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    near = (c("x") - c("bx")) * (c("x") - c("bx")) + (c("y") - c("by")) * (c("y") - c("by")) <= disc_m * disc_m
    out = None
    while not left.isEmpty():
        best = left.groupBy(*here).agg(F.max(F.struct("clearance_m", (-c("cell_id")).alias("n"), "x", "y")).alias("b"))
        best = best.select(*here, (-c("b.n")).alias("best_id"), c("b.x").alias("bx"), c("b.y").alias("by"), c("b.clearance_m").alias("best_m"))
        spread = best.withColumn("_i", around).withColumn("_j", around).withColumn("sx", c("sx") + c("_i")).withColumn("sy", c("sy") + c("_j")).drop("_i", "_j")
        better = (c("clearance_m") > c("best_m")) | ((c("clearance_m") == c("best_m")) & (c("cell_id") < c("best_id")))
        beaten = spread.join(left, here).filter(near & better).select(SITE, "patch_id", "best_id").distinct()
        won = stored(best.join(beaten, [SITE, "patch_id", "best_id"], "left_anti"))
        out = won if out is None else out.unionByName(won)
        discs = won.withColumn("_i", around).withColumn("_j", around).withColumn("sx", c("sx") + c("_i")).withColumn("sy", c("sy") + c("_j")).select(*here, "bx", "by")
        taken = discs.join(left, here).filter(near).select(SITE, "patch_id", "cell_id").distinct()
        old, path = path, new_table(spark)
        left = stored(left.join(taken, [SITE, "patch_id", "cell_id"], "left_anti"), path)
        discard(spark, old)
    if out is None:
        return left.select(SITE, "patch_id", F.lit(0).alias("round"), "cell_id", "clearance_m")
    order = W.partitionBy(SITE, "patch_id").orderBy(c("best_m").desc(), "best_id")
    return out.select(SITE, "patch_id", (F.row_number().over(order) - 1).alias("round"), c("best_id").alias("cell_id"), c("best_m").alias("clearance_m"))
