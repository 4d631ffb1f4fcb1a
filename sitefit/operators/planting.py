"""Planting patterns: guides, points along them, rows, scatter and groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions.rules import with_setback
from sitefit.operators.area import WIDE_M
from sitefit.operators.buckets import SITE, as_edges, near_pairs
from sitefit.operators.firsts import first_come
from sitefit.operators.ground import closing_lines, dealt, open_points, site_lines
from sitefit.operators.measures import hash01
from sitefit.session import stored

GUIDE_TYPES = ("road", "sidewalk", "sidewalk_kerb", "tram_track")
MIN_GUIDE_M, ROW_INSET_M, ROW_BAND_M = 15.0, 0.05, 6.0
MAX_RAW_SAMPLES, OVERSAMPLE = 2_000_000, 4
GROUP_PITCH_M, GROUP_RADIUS_M = 14.0, 3.0
DART_BLOCK = 10_000


def row_guides(measures: DataFrame) -> DataFrame:
    """Outlines long enough to carry a row, with the distance that applies to trees and shrubs."""
    c = F.col
    rows = measures.filter(c("object_type").isin(list(GUIDE_TYPES)) & (c("perimeter_m") >= MIN_GUIDE_M))
    rows = rows.withColumn("planting_type", F.explode(F.array(F.lit("tree"), F.lit("shrub"))))
    return with_setback(rows).select(SITE, "gid", "object_type", "planting_type", c("perimeter_m").alias("length_m"), c("table_m").alias("setback_m"))


def territory_guides(outline: DataFrame) -> DataFrame:
    """The site boundary as a guide at its own margin."""
    c = F.col
    um = F.floor(F.sqrt((c("x2") - c("x1")) * (c("x2") - c("x1")) + (c("y2") - c("y1")) * (c("y2") - c("y1"))) * 1e6).cast("long")
    length = outline.groupBy(SITE).agg((F.sum(um) / F.lit(1e6)).alias("length_m"))
    norms = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("planting_type"), F.lit(r[4]).alias("setback_m")) for r in fx.TYPE_NORMS]))
    return length.withColumn("n", norms).select(SITE, "length_m", "n.planting_type", "n.setback_m")


def points_along(rings: DataFrame, pitch_m: float) -> DataFrame:
    """Points on closed rings: the step is the pitch stretched to divide the length, so there is no seam.

    Lengths are whole micrometres; twice-floored integer positions make the result independent of row order.
    """
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    w = W.partitionBy(SITE, "gid").orderBy("seq")
    part = rings.withColumn("um", F.floor(F.sqrt(dx * dx + dy * dy) * 1e6).cast("long")).withColumn(
        "start", F.coalesce(F.sum("um").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    pitch = int(round(pitch_m * 1e6))
    total = part.groupBy(SITE, "gid").agg(F.sum("um").alias("total")).withColumn("n", F.floor(c("total") / pitch).cast("long")).filter("n > 0")
    spots = total.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1))).withColumn("at", F.floor(c("i") * c("total") / c("n")).cast("long"))
    hit = spots.select(SITE, "gid", "i", "at").join(part, [SITE, "gid"]).filter((c("at") >= c("start")) & (c("at") < c("start") + c("um")))
    t = (c("at") - c("start")) / c("um")
    return hit.select(SITE, "gid", "i", (c("x1") + dx * t).alias("x"), (c("y1") + dy * t).alias("y"), (-dy / (c("um") / 1e6)).alias("nx"), (dx / (c("um") / 1e6)).alias("ny"))


def row_offsets(guides: DataFrame, rings: DataFrame, edges: DataFrame, outline: DataFrame, pitch_m: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Smallest offset on each side of a guide that carries a usable row (else the best one), and all legal offset points."""
    c = F.col
    step = max(pitch_m / 8, 0.25)
    count = int(ROW_BAND_M // step) + 1
    at = points_along(rings.join(guides.filter("planting_type = 'tree'").select(SITE, "gid", "setback_m"), [SITE, "gid"]), pitch_m)
    base = at.join(guides.filter("planting_type = 'tree'").select(SITE, "gid", "setback_m"), [SITE, "gid"])
    rows = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    rows = rows.withColumn("offset_m", c("setback_m") + ROW_INSET_M + c("k") * step).filter(c("offset_m") <= c("setback_m") + ROW_BAND_M)
    rows = rows.select(SITE, "gid", "side", "i", "offset_m", (c("x") + c("nx") * c("side") * c("offset_m")).alias("x"), (c("y") + c("ny") * c("side") * c("offset_m")).alias("y"),
                       F.concat_ws(":", c("gid").cast("string"), c("side").cast("string"), c("i").cast("string"), c("k").cast("string")).alias("pid"))
    legal = stored(open_points(rows, closing_lines(outline, edges, "tree"), "pid"))
    usable = legal.groupBy(SITE, "gid", "side", "offset_m").agg(F.count(F.lit(1)).alias("n"))
    chosen = usable.groupBy(SITE, "gid", "side").agg(F.min(F.when(c("n") >= 3, c("offset_m"))).alias("first"), F.max(F.struct("n", -c("offset_m"))).alias("best"))
    return chosen.select(SITE, "gid", "side", F.coalesce("first", -c("best.col2")).alias("offset_m")), legal


def row_candidates(offsets: DataFrame, legal: DataFrame) -> DataFrame:
    """Row points on the chosen offsets, with their row id."""
    c = F.col
    rid = F.concat(F.lit("tree-row-"), c("gid").cast("string"), F.lit("-"), c("side").cast("string"))
    return legal.join(offsets, [SITE, "gid", "side", "offset_m"]).select(SITE, "pid", "x", "y", rid.alias("group_id"))


def dart_counts(frame: DataFrame, pitch_m: float) -> DataFrame:
    """Raw samples a site takes; ``many`` marks sites that take very many. All are sampled, in blocks that many tasks share."""
    c = F.col
    n = F.ceil(c("area_m2") / (pitch_m * pitch_m) * OVERSAMPLE).cast("long")
    return frame.select(SITE, n.alias("samples"), F.when(n > MAX_RAW_SAMPLES, "many").otherwise("ok").alias("status"))


def darts(frame: DataFrame, pitch_m: float, seed: str) -> DataFrame:
    """Uniform darts over each site's box, fixed by (seed, site, number)."""
    c = F.col
    counts = dart_counts(frame, pitch_m).filter("samples > 0")
    # a site's samples in blocks, dealt out before they are generated, so that a large site is the work of many tasks
    blocks = frame.join(counts, SITE).withColumn("from_", F.explode(F.sequence(F.lit(0).cast("long"), c("samples") - 1, F.lit(DART_BLOCK).cast("long"))))
    blocks = dealt(blocks, SITE, "from_")
    rows = blocks.withColumn("dart_id", F.explode(F.sequence(c("from_"), F.least(c("from_") + (DART_BLOCK - 1), c("samples") - 1))))
    key = F.concat_ws(":", F.lit(seed), c(SITE).cast("string"), c("dart_id").cast("string"))
    u, v = hash01(F.concat(key, F.lit(":x"))), hash01(F.concat(key, F.lit(":y")))
    return rows.select(SITE, "dart_id", (c("x0") + (c("xm") - c("x0")) * u).alias("x"), (c("y0") + (c("ym") - c("y0")) * v).alias("y"))


def scatter_candidates(frame: DataFrame, edges: DataFrame, outline: DataFrame, pitch_m: float, seed: str) -> DataFrame:
    """Darts on legal ground."""
    return open_points(darts(frame, pitch_m, seed), closing_lines(outline, edges, "tree"), "dart_id")


def group_positions(frame: DataFrame, outline: DataFrame, seed: str) -> DataFrame:
    """Group centres in draw order, at least a group pitch apart."""
    c = F.col
    at = darts(frame, GROUP_PITCH_M, seed)
    held = open_points(at, site_lines(outline), "dart_id")
    points = held.select(c(SITE).cast("long").alias(SITE), F.lit(0).cast("long").alias("kind"), c("dart_id").alias("id"), "x", "y", c("y").alias("sy"),
                         F.lit(0.0).alias("r"), F.lit(0.0).alias("k1"), F.lit(0).cast("long").alias("k2"))
    pitch = GROUP_PITCH_M
    return first_come(points, pitch, lambda dx, dy, r, s: np.sqrt(dx * dx + dy * dy) < pitch).select(SITE, "id", "x", "y")


def fill_group(centres: DataFrame, edges: DataFrame, outline: DataFrame, pitch_m: float) -> DataFrame:
    """Dense legal points in a disc around each centre (site, id, x, y), as many draws per disc as its area and the pitch ask for."""
    c = F.col
    n = math.ceil(2 * math.pi * GROUP_RADIUS_M ** 2 / pitch_m ** 2)
    rows = centres.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = F.concat_ws(":", c(SITE).cast("string"), c("id").cast("string"), c("k").cast("string"))
    r, a = F.sqrt(hash01(F.concat(key, F.lit(":r")))) * GROUP_RADIUS_M, hash01(F.concat(key, F.lit(":a"))) * (2 * math.pi)
    rows = rows.select(SITE, "id", key.alias("pid"), (c("x") + r * F.cos(a)).alias("x"), (c("y") + r * F.sin(a)).alias("y"))
    gid = F.concat(F.lit("shrub-group-"), F.round("x").cast("long").cast("string"), F.lit("-"), F.round("y").cast("long").cast("string"))
    named = centres.select(SITE, "id", gid.alias("group_id"))
    return open_points(rows, closing_lines(outline, edges, "shrub"), "pid").join(named, [SITE, "id"])


def accent_layout(spots: DataFrame, edges: DataFrame, outline: DataFrame, pitch_m: float = 5.0) -> DataFrame:
    """A core tree with the best of six rotations of a six-ring around each spot (site, id, x, y)."""
    c = F.col
    ring = spots.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    angle = (c("k") + c("turn") / 6.0) * (math.pi / 3)
    ring = ring.select(SITE, "id", "turn", "k", (c("x") + F.cos(angle) * pitch_m).alias("x"), (c("y") + F.sin(angle) * pitch_m).alias("y"),
                       F.concat_ws(":", c("id").cast("string"), c("turn").cast("string"), c("k").cast("string")).alias("pid"))
    legal = open_points(ring, closing_lines(outline, edges, "tree"), "pid")
    best = legal.groupBy(SITE, "id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy(SITE, "id").agg(F.max(F.struct("n", -c("turn"))).alias("b"))
    rows = spots.join(best, [SITE, "id"], "left")
    return rows.select(SITE, "id", F.coalesce("b.n", F.lit(0)).alias("ring_trees"), F.when(c("b.n") > 0, -c("b.col2")).alias("turn"), F.when(c("b.n") > 0, "group").otherwise("solitaire").alias("kind"))


def crown_cascade(candidates: DataFrame, edges: DataFrame, outline: DataFrame) -> DataFrame:
    """Crown classes from wide to narrow: each class fills what the wider ones left, at the larger interval of the pair."""
    from sitefit.functions.rules import with_resolution
    from sitefit.operators.compliance import constraint_edges
    from sitefit.operators.select import greedy_select

    c = F.col
    trees = candidates.filter("planting_type = 'tree'")
    free = stored(open_points(trees.filter("cand_id is not null"), closing_lines(outline, edges, "tree"), "cand_id"))
    placed = None
    for crown, interval in fx.CROWN_SPACING:
        name = next(s[0] for s in fx.SPECIES if s[1] == "tree" and s[2] == crown)
        rules = with_resolution(constraint_edges(edges).withColumn("planting_type", F.lit("tree")).withColumn("species", F.lit(name))).select(SITE, "x1", "y1", "x2", "y2", "required_m")
        hit = near_pairs(free.select(SITE, "cand_id", "x", "y"), rules, c("required_m"), WIDE_M).select(SITE, "cand_id")
        open_ = free.join(hit, [SITE, "cand_id"], "left_anti")
        if placed is not None:
            need = F.greatest(F.lit(interval), c("interval_m")) + 1e-3
            close = near_pairs(open_.select(SITE, "cand_id", "x", "y"), as_edges(placed.withColumn("need", need), "need"), c("need"), WIDE_M).filter(c("dist") < c("need")).select(SITE, "cand_id")
            open_ = open_.join(close, [SITE, "cand_id"], "left_anti")
        # read by the selection and once more
        open_ = stored(open_)
        won = stored(open_.join(greedy_select(open_, interval / 2), [SITE, "cand_id"], "left_semi").select(
            SITE, "cand_id", "x", "y", "score", F.lit(name).alias("species"), F.lit(crown).alias("crown"), F.lit(interval).alias("interval_m")))
        placed = won if placed is None else placed.unionByName(won)
    return placed
