"""From drawing entities and GeoJSON to typed features and edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions.geom import rounded, segments_cross
from sitefit.operators.buckets import SITE
from sitefit.session import cut

def to_edges(vertices: DataFrame, closed: bool) -> DataFrame:
    """Vertex rows (site, gid, seq, x, y) to two-point edges; a closed ring returns to its first vertex."""
    w = W.partitionBy(SITE, "gid").orderBy("seq")
    first = lambda n: F.first(n).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    rows = vertices.withColumn("x2", F.coalesce(nx, first("x")) if closed else nx).withColumn("y2", F.coalesce(ny, first("y")) if closed else ny)
    return rows.filter(F.col("x2").isNotNull()).select(SITE, "gid", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def expand_blocks(inserts: DataFrame) -> DataFrame:
    """Absolute offset and depth of every insert under its chain of parent blocks, however deep.

    Pointer doubling: each insert knows the offset up to an ancestor, and a round replaces that ancestor by the ancestor's own,
    so a chain of n inserts takes log2(n) rounds. Inserts that hang in a cycle, or from a parent that isn't there, never
    reach a root: they come back as rows without offset and depth.
    """
    c = F.col
    none = F.lit(None).cast("long")
    state = cut(inserts.select("k", c("parent").alias("up"), "dx", "dy", c("parent").isNotNull().cast("long").alias("depth")))
    open_before = None
    while True:
        waiting = state.filter(c("up").isNotNull()).count()
        # only cycles and missing parents keep as many open inserts over a round
        if not waiting or waiting == open_before:
            break
        open_before = waiting
        above = state.select(c("k").alias("up"), c("up").alias("next"), c("dx").alias("ax"), c("dy").alias("ay"), c("depth").alias("ad"), F.lit(True).alias("there"))
        moved = state.filter(c("up").isNotNull()).join(above, "up", "left")
        moved = moved.select("k", F.when(c("there"), c("next")).otherwise(c("up")).alias("up"), *[(c(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("dx", "ax"), ("dy", "ay"), ("depth", "ad"))])
        state = cut(state.filter(c("up").isNull()).unionByName(moved))
    return state.select("k", *[F.when(c("up").isNull(), c(name)).otherwise(none).alias(name) for name in ("dx", "dy", "depth")])


def flatten_arcs(arcs: DataFrame, sagitta: float = 0.2) -> DataFrame:
    """Arc rows (id, cx, cy, r, a0, sweep in degrees) to vertices with the given sagitta."""
    c = F.col
    step = F.acos(F.lit(1.0) - F.least(F.lit(sagitta), c("r")) / c("r")) * 2.0
    rows = arcs.withColumn("n", F.greatest(F.lit(1), F.ceil(F.radians("sweep") / step)).cast("long")).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), c("n"))))
    angle = F.radians(c("a0") + c("sweep") * (c("seq") / c("n")))
    return rows.select("id", "seq", rounded(c("cx") + c("r") * F.cos(angle), 6).alias("x"), rounded(c("cy") + c("r") * F.sin(angle), 6).alias("y"))


def self_crossing(edges: DataFrame) -> DataFrame:
    """Owners with two edges that properly cross."""
    c = F.col
    a = edges.select(SITE, "gid", c("seq").alias("s1"), "x1", "y1", "x2", "y2")
    b = edges.select(SITE, "gid", c("seq").alias("s2"), c("x1").alias("u1"), c("y1").alias("v1"), c("x2").alias("u2"), c("y2").alias("v2"))
    hit = segments_cross(c("x1"), c("y1"), c("x2"), c("y2"), c("u1"), c("v1"), c("u2"), c("v2"))
    # long owners meet only where their edges share a cell
    from sitefit.operators.buckets import measured, to_cells
    left = to_cells(a, 8.0, 0.0)
    right = to_cells(b.withColumnsRenamed({"u1": "x1", "v1": "y1", "u2": "x2", "v2": "y2"}), 8.0, 0.0).withColumnsRenamed({"x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2"})
    pairs = left.join(right, [SITE, "gid", "cx", "cy"]).filter(c("s1") + 1 < c("s2"))
    return measured(pairs, "hit", hit).filter("hit").select(SITE, "gid").distinct()


def infer_closed(vertices: DataFrame, tolerance: float = 0.05, least: int = 4) -> DataFrame:
    """Open polylines of at least four points whose ends almost meet and that do not cross themselves."""
    c = F.col
    ends = vertices.groupBy(SITE, "gid").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    dx, dy = c("a.x") - c("b.x"), c("a.y") - c("b.y")
    near = ends.filter((c("n") >= least) & (F.sqrt(dx * dx + dy * dy) <= tolerance))
    return near.select(SITE, "gid").join(self_crossing(to_edges(vertices, False)), [SITE, "gid"], "left_anti")


def hatch_loops(loops: DataFrame) -> DataFrame:
    """Roles of the loops of one fill (boxes): the largest is the exterior, loops inside it are holes, others are separate."""
    c = F.col
    area = (c("hx") - c("lx")) * (c("hy") - c("ly"))
    rows = loops.withColumn("area", area)
    outer = rows.groupBy("fill").agg(F.max(F.struct("area", -c("loop"), "lx", "ly", "hx", "hy")).alias("o"))
    inside = (c("lx") >= c("o.lx")) & (c("hx") <= c("o.hx")) & (c("ly") >= c("o.ly")) & (c("hy") <= c("o.hy"))
    role = F.when(-c("loop") == c("o.col2"), "exterior").when(inside, "hole").otherwise("separate")
    return rows.join(outer, "fill").select("fill", "loop", role.alias("role"))


def bundle_report(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Entities and damaged records of every expected sheet; one that gave no entity is lost."""
    c = F.col
    sums = report.groupBy("sheet").agg(F.sum("features").alias("entities"), F.sum("damaged").alias("damaged"))
    rows = expected.join(sums, "sheet", "left").fillna(0, ["entities", "damaged"])
    return rows.select("sheet", "entities", "damaged", F.when(c("entities") == 0, "lost").otherwise("read").alias("status"))


def pick_base_sheet(layers: DataFrame, main: str, least: int = 20) -> DataFrame:
    """The main sheet if it has substance, else the sheet with most entities."""
    c = F.col
    counts = layers.groupBy(SITE, "sheet").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(SITE).agg(F.max(F.when(c("sheet") == main, c("n"))).alias("main_n"), F.max_by("sheet", F.struct("n", "sheet")).alias("largest"))
    return best.select(SITE, F.when(c("main_n") >= least, F.lit(main)).otherwise(c("largest")).alias("sheet"))


def feature_texts(items: DataFrame) -> DataFrame:
    """GeoJSON feature text per placement."""
    from sitefit.operators.measures import crowns, scheme

    c = F.col
    rows = crowns(items).withColumn("scheme", scheme(c("rationale")))
    props = F.struct(c("item_id").alias("id"), "planting_type", "species", "crown", "crown_m", "score", "rationale", "is_manual_edit", "group_id", "scheme")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return rows.select(SITE, "item_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))
