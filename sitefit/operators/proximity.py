"""Range, nearest and containment queries on top of the grid join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions import dims
from sitefit.functions.geom import cell
from sitefit.functions.rules import with_resolution, with_setback
from sitefit.operators.buckets import SITE, as_edges, inside, inside_site, measured, near_few, near_pairs, nearest
from sitefit.operators.compliance import constraint_edges, distances, with_half

def footprint_cells(edges: DataFrame, size: float) -> DataFrame:
    """(feature, cell) rows of each bounding box, whatever its size."""
    c = F.col
    box = edges.groupBy(SITE, "gid").agg(F.min(F.least("x1", "x2")).alias("ax"), F.max(F.greatest("x1", "x2")).alias("bx"),
                                         F.min(F.least("y1", "y2")).alias("ay"), F.max(F.greatest("y1", "y2")).alias("by"))
    for n in ("ax", "bx", "ay", "by"):
        box = box.withColumn(n, cell(c(n), size))
    return box.select(SITE, "gid", F.explode(F.sequence("ax", "bx")).alias("cx"), "ay", "by").select(SITE, "gid", "cx", F.explode(F.sequence("ay", "by")).alias("cy"))


def cell_neighbours(edges: DataFrame, size: float) -> DataFrame:
    """Per feature: cells of its footprint and features of other types that share one, by an equi-join on (site, cell)."""
    c = F.col
    cells = footprint_cells(edges, size).join(edges.select(SITE, "gid", "object_type").distinct(), [SITE, "gid"])
    other = cells.select(SITE, "cx", "cy", c("gid").alias("other"), c("object_type").alias("other_type"))
    pairs = cells.join(other, [SITE, "cx", "cy"]).filter(c("object_type") != c("other_type")).select(SITE, "gid", "other").distinct()
    met = pairs.groupBy(SITE, "gid").agg(F.count(F.lit(1)).alias("neighbours"))
    return cells.groupBy(SITE, "gid").agg(F.count(F.lit(1)).alias("cells")).join(met, [SITE, "gid"], "left").fillna(0, ["neighbours"])


def within_distance(points: DataFrame, edges: DataFrame, reach, size: float) -> DataFrame:
    return (near_pairs(points.select(SITE, "item_id", "x", "y"), edges, reach, size)
            .groupBy(SITE, "item_id", "gid").agg(F.min("dist").alias("dist")))


def group_of(column: str = "object_type"):
    """Distance-feature group of an object type."""
    return F.coalesce(*[F.when(F.col(column).isin(list(types)), F.lit(g)) for g, types in fx.DISTANCE_GROUPS])


def grouped_edges(edges: DataFrame, outline: DataFrame) -> DataFrame:
    """Edges with their feature group; the site outline is the group ``edge``."""
    own = edges.select(SITE, "gid", "geom_kind", group_of().alias("grp"), "x1", "y1", "x2", "y2").filter(F.col("grp").isNotNull())
    site = outline.select(SITE, F.lit(-1).cast("long").alias("gid"), F.lit("line").alias("geom_kind"), F.lit("edge").alias("grp"), "x1", "y1", "x2", "y2")
    return own.unionByName(site)


def covered_groups(points: DataFrame, edges: DataFrame, point_id: str) -> DataFrame:
    """(point, gid, grp) of the polygons a point lies in."""
    areas = edges.filter(F.col("geom_kind") == "polygon")
    return inside(points, areas, point_id).join(areas.select(SITE, "gid", "grp").distinct(), [SITE, "gid"])


def capped_distances(points: DataFrame, edges: DataFrame, point_id: str, cap: float = fx.MAX_DISTANCE_M) -> DataFrame:
    """(point, one column ``d_<group>`` a group): distances below the cap, 0 inside a polygon, null from the cap on."""
    c = F.col
    # the points are fewer than the edges, so they are written out to the cells in reach, and the edges to their own cells only
    pairs = near_few(points.select(SITE, point_id, "x", "y"), edges.select(SITE, "grp", "x1", "y1", "x2", "y2"), cap, cap).select(SITE, point_id, "grp", "dist")
    covered = covered_groups(points, edges, point_id).select(SITE, point_id, "grp", F.lit(0.0).alias("dist"))
    cols = [F.min(F.when(c("grp") == g, c("dist"))).alias(f"d_{g}") for g, _ in fx.DISTANCE_GROUPS]
    return pairs.unionByName(covered).groupBy(SITE, point_id).agg(*cols)


def distance_matrix(points: DataFrame, edges: DataFrame, point_id: str) -> DataFrame:
    """One column ``d_<group>`` per group, capped."""
    return points.select(SITE, point_id).join(capped_distances(points, edges, point_id), [SITE, point_id], "left").fillna(fx.MAX_DISTANCE_M, [f"d_{g}" for g, _ in fx.DISTANCE_GROUPS])


def counts_within(points: DataFrame, edges: DataFrame, point_id: str) -> DataFrame:
    """Objects of a group within its radius of each point, by number of distinct owners."""
    c = F.col
    radius = F.coalesce(*[F.when(c("grp") == g, F.lit(r)) for g, r in fx.COUNT_FEATURES])
    chosen = edges.filter(c("grp").isin([g for g, _ in fx.COUNT_FEATURES]))
    near = near_few(points.select(SITE, point_id, "x", "y"), chosen.select(SITE, "grp", "gid", "x1", "y1", "x2", "y2"), float(max(r for _, r in fx.COUNT_FEATURES)), 30.0)
    hits = near.filter(c("dist") <= radius).select(SITE, point_id, "grp", "gid")
    hits = hits.unionByName(covered_groups(points, chosen, point_id).select(SITE, point_id, "grp", "gid")).distinct()
    cols = [F.sum((c("grp") == g).cast("long")).alias(f"n_{g}_{int(r)}") for g, r in fx.COUNT_FEATURES]
    names = [f"n_{g}_{int(r)}" for g, r in fx.COUNT_FEATURES]
    return points.select(SITE, point_id).join(hits.groupBy(SITE, point_id).agg(*cols), [SITE, point_id], "left").fillna(0, names)


def zoning_found(points: DataFrame, edges: DataFrame, features: DataFrame, point_id: str) -> DataFrame:
    """(site, point, zoning), a row per id of a point inside a zoning area: the category of the first (lowest id)."""
    areas = edges.filter(F.col("object_type") == "zoning")
    named = features.filter(F.col("object_type") == "zoning").select(SITE, "gid", "zoning")
    return inside(points, areas, point_id).join(named, [SITE, "gid"]).groupBy(SITE, point_id).agg(F.min_by("zoning", "gid").alias("zoning"))


def zoning_at(points: DataFrame, edges: DataFrame, features: DataFrame, point_id: str) -> DataFrame:
    """Category of the first zoning area (lowest id) that holds the point; null outside all of them."""
    return points.select(SITE, point_id).join(zoning_found(points, edges, features, point_id), [SITE, point_id], "left")


def distance_to_objects(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(point, object) distances up to a radius; 0 inside."""
    near = within_distance(points, edges, radius, radius)
    covered = inside(points, edges.filter("geom_kind = 'polygon'"), "item_id").withColumn("dist", F.lit(0.0))
    return near.unionByName(covered).groupBy(SITE, "item_id", "gid").agg(F.min("dist").alias("dist"))


def legal_points(points: DataFrame, edges: DataFrame, point_id: str, species: str = "Рябина обыкновенная") -> DataFrame:
    """Does the narrowest-crown species fit at each point, and which constraint is violated most where it does not?"""
    c = F.col
    rows = distances(points, edges, point_id).withColumn("planting_type", F.lit("tree")).withColumn("species", F.lit(species))
    failed = with_resolution(rows).filter(c("actual_m") + fx.CHECK_TOLERANCE_M < c("required_m"))
    worst = failed.groupBy(SITE, point_id).agg(F.min(F.struct((c("actual_m") - c("required_m")).alias("slack"), "object_type")).alias("w"))
    return points.select(SITE, point_id).join(worst, [SITE, point_id], "left").select(
        SITE, point_id, c("w").isNull().alias("legal"), c("w.object_type").alias("blocker"))


def nearby_constraints(items: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """All objects within the radius of every tree with their requirement, and its neighbour trees."""
    c = F.col
    trees = items.filter(c("planting_type") == "tree").select(SITE, "item_id", "x", "y", "species")
    objects = constraint_edges(edges)
    near = distance_to_objects(trees, objects, radius)
    kinds = objects.select(SITE, "gid", "object_type").distinct()
    near = near.join(kinds, [SITE, "gid"]).join(trees.select(SITE, "item_id", "species"), [SITE, "item_id"]).withColumn("planting_type", F.lit("tree"))
    constraints = with_resolution(near).select(SITE, "item_id", F.lit("constraint").alias("kind"), c("gid").alias("other_id"), "object_type", "required_m")
    span = dims.species_interval(items.sparkSession).select(c("name").alias("species"), "interval_m")
    spans = trees.join(F.broadcast(span), "species", "left")
    others = as_edges(spans, c("item_id").alias("other_id"), c("interval_m").alias("other_m"))
    pairs = near_pairs(spans.select(SITE, "item_id", "x", "y", "interval_m"), others, radius * 2 ** 0.5 + 1e-6, radius)
    pairs = pairs.filter((c("item_id") != c("other_id")) & (F.abs(c("x") - c("x1")) <= radius) & (F.abs(c("y") - c("y1")) <= radius))
    neighbours = pairs.withColumn("required_m", F.greatest("interval_m", "other_m")).filter(c("required_m").isNotNull()).select(
        SITE, "item_id", F.lit("neighbour").alias("kind"), "other_id", F.lit("neighbour_tree").alias("object_type"), "required_m")
    return constraints.unionByName(neighbours)


def worst_reading(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Most violated, else tightest constraint of each group, over all its members."""
    c = F.col
    chosen = items.filter(c("group_id").isNotNull() & (c("planting_type") != "lawn"))
    rows = distances(with_half(chosen), edges).join(chosen.select(SITE, "item_id", "group_id", "planting_type", "species"), [SITE, "item_id"])
    rows = with_resolution(rows)
    best = F.min(F.struct((c("actual_m") - c("required_m")).alias("slack_m"), "object_type", "item_id")).alias("b")
    return rows.groupBy(SITE, "group_id").agg(best).select(SITE, "group_id", "b.slack_m", "b.object_type", "b.item_id")


def distance_to_site(edges: DataFrame, outline: DataFrame, reach: float) -> DataFrame:
    """Distance of features to their site up to a reach; 0 inside or across the outline."""
    c = F.col
    from sitefit.functions.geom import segment_distance, segments_cross
    from sitefit.operators.buckets import to_cells

    size = 48.0
    left = to_cells(edges.select(SITE, "gid", "seq", "x1", "y1", "x2", "y2"), size, reach)
    right = to_cells(outline.select(SITE, c("x1").alias("ox1"), c("y1").alias("oy1"), c("x2").alias("ox2"), c("y2").alias("oy2"))
                     .withColumnsRenamed({"ox1": "x1", "oy1": "y1", "ox2": "x2", "oy2": "y2"}), size, 0.0)
    right = right.withColumnsRenamed({"x1": "ox1", "y1": "oy1", "x2": "ox2", "y2": "oy2"})
    across = segments_cross(c("x1"), c("y1"), c("x2"), c("y2"), c("ox1"), c("oy1"), c("ox2"), c("oy2"))
    ends = [segment_distance(c(px), c(py), c("ox1"), c("oy1"), c("ox2"), c("oy2")) for px, py in (("x1", "y1"), ("x2", "y2"))]
    ends += [segment_distance(c(px), c(py), c("x1"), c("y1"), c("x2"), c("y2")) for px, py in (("ox1", "oy1"), ("ox2", "oy2"))]
    near = (measured(left.join(right, [SITE, "cx", "cy"]), "dist", F.when(across, 0.0).otherwise(F.least(*ends)))
            .groupBy(SITE, "gid").agg(F.min("dist").alias("dist")))
    starts = edges.withColumn("pid", F.concat_ws(":", c("gid").cast("string"), c("seq").cast("string"))).select(SITE, "gid", "pid", c("x1").alias("x"), c("y1").alias("y"))
    held = inside_site(starts, outline, "pid").join(starts.select(SITE, "pid", "gid"), [SITE, "pid"]).select(SITE, "gid", F.lit(0.0).alias("dist")).distinct()
    return near.unionByName(held).groupBy(SITE, "gid").agg(F.min("dist").alias("dist"))


MITRE_LIMIT, CLIP_MARGIN_M = 5.0, 10.0


def near_territory(features: DataFrame, edges: DataFrame, outline: DataFrame, planting_type: str = "tree") -> DataFrame:
    """Features whose buffer can touch the site: five distances for mitred zones, one for round utilities, plus a margin."""
    c = F.col
    widest = MITRE_LIMIT * max(r[1] for r in fx.SETBACKS) + CLIP_MARGIN_M
    rows = with_setback(features.withColumn("planting_type", F.lit(planting_type)))
    factor = F.when(c("kind") == "zone", F.lit(MITRE_LIMIT)).otherwise(F.lit(1.0))
    reach = rows.select(SITE, "gid", "object_type", (c("table_m") * factor + CLIP_MARGIN_M).alias("reach"))
    found = distance_to_site(edges, outline, widest)
    return reach.join(found, [SITE, "gid"]).filter(c("dist") <= c("reach")).select(SITE, "gid", "object_type", "reach")


def box_query(items: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Selection by box per site: points in it, areas only when wholly inside; the bounds of the selection."""
    c = F.col
    h = c("side_c") / F.lit(200.0)
    picked = items.withColumn("h", h).filter((c("x") - c("h") >= low[0]) & (c("x") + c("h") <= high[0])
                                              & (c("y") - c("h") >= low[1]) & (c("y") + c("h") <= high[1]))
    return picked.groupBy(SITE).agg(F.count(F.lit(1)).alias("items"), F.min(c("x") - c("h")).alias("min_x"), F.max(c("x") + c("h")).alias("max_x"),
                                    F.min(c("y") - c("h")).alias("min_y"), F.max(c("y") + c("h")).alias("max_y"))


SCENE_TYPES = ("building", "road", "sidewalk", "existing_greenery", "existing_lawn")
SCENE_MARGIN_M, MIN_BUILDING_WIDTH_M = 30.0, 1.5


def scene_filter(edges: DataFrame, outline: DataFrame) -> DataFrame:
    """Polygonal zones within 30 m of the site: buildings stay whole unless they are slivers, others are clipped."""
    c = F.col
    areas = edges.filter((c("geom_kind") == "polygon") & c("object_type").isin(list(SCENE_TYPES)))
    shape = areas.groupBy(SITE, "gid", "object_type").agg(
        (F.abs(F.sum(c("xc1") * c("yc2") - c("xc2") * c("yc1"))) / F.lit(20000.0)).alias("area_m2"),
        F.sum(F.floor(F.sqrt((c("x2") - c("x1")) * (c("x2") - c("x1")) + (c("y2") - c("y1")) * (c("y2") - c("y1"))) * 1e6).cast("long")).alias("per"))
    near = distance_to_site(areas, outline, SCENE_MARGIN_M).filter(c("dist") <= SCENE_MARGIN_M)
    width = c("area_m2") * 2.0 / F.greatest(c("per") / F.lit(1e6), F.lit(1e-9))
    rows = shape.join(near, [SITE, "gid"]).withColumn("width_m", width)
    return rows.filter((c("object_type") != "building") | (c("width_m") >= MIN_BUILDING_WIDTH_M)).select(
        SITE, "gid", "object_type", "area_m2", (c("object_type") != "building").alias("clipped"))
