"""Site outline from drawn contours, on cell sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit.operators.buckets import SITE
from sitefit.operators.iterate import components

DUPLICATE, MAX_DISTANCE_RATIO, CONTEXT_M, MIN_CONTEXT = 0.99, 2.0, 100.0, 5
#: Cells of a line that lie in one block.
BLOCK_CELLS = 64


def source(contours: DataFrame, allow_order: bool = False) -> DataFrame:
    """Work boundary if there is an areal one, else the survey-order boundary (only with consent), else an error status."""
    c = F.col
    has = lambda k: F.max((c("kind") == k).cast("int")) == 1
    rows = contours.groupBy(SITE).agg(has("territory").alias("t"), has("order_boundary").alias("o"))
    pick = F.when(c("t"), "territory").when(c("o"), "order_boundary")
    status = F.when(pick.isNull(), "missing").when((pick == "order_boundary") & F.lit(not allow_order), "order boundary only").otherwise("ok")
    return rows.select(SITE, pick.alias("source"), status.alias("status"))


def contour_cells(contours: DataFrame) -> DataFrame:
    """Metre cells of box contours, as runs (site, piece, block, iy, a, b): the cells a to b of line iy within a block of BLOCK_CELLS."""
    c = F.col
    first, last = (F.floor(x / BLOCK_CELLS).cast("long") for x in (c("x0"), c("xm") - 1))
    rows = contours.filter("xm > x0 and ym > y0").withColumn("block", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("a", F.greatest("x0", c("block") * BLOCK_CELLS)).withColumn("b", F.least(c("xm") - 1, (c("block") + 1) * BLOCK_CELLS - 1))
    return rows.select(SITE, "piece", "block", F.explode(F.sequence("y0", c("ym") - 1)).alias("iy"), "a", "b")


def run_cells() -> Column:
    return F.sum(F.col("b") - F.col("a") + 1)


def common_cells(runs: DataFrame, other: DataFrame) -> DataFrame:
    """Runs that meet one of another table (o_a, o_b and more columns), with the number of cells in both."""
    c = F.col
    met = runs.join(other, [SITE, "block", "iy"]).filter((c("a") <= c("o_b")) & (c("o_a") <= c("b")))
    return met.withColumn("common", F.least("b", "o_b") - F.greatest("a", "o_a") + 1)


def near_duplicates(cells: DataFrame) -> DataFrame:
    """Pieces that cover each other almost completely, as the least piece id of their group."""
    c = F.col
    size = cells.groupBy(SITE, "piece").agg(run_cells().alias("n"))
    # run by run the pieces that cover it are few; pairs are counted per run, never per site
    other = cells.select(SITE, "block", "iy", c("piece").alias("other"), c("a").alias("o_a"), c("b").alias("o_b"))
    both = common_cells(cells, other).filter(c("piece") < c("other")).groupBy(SITE, "piece", "other").agg(F.sum("common").alias("common"))
    rows = both.join(size, [SITE, "piece"]).join(size.select(SITE, c("piece").alias("other"), c("n").alias("m")), [SITE, "other"])
    same = rows.filter((c("common") / c("n") > DUPLICATE) & (c("common") / c("m") > DUPLICATE)).select(SITE, c("piece").alias("u"), c("other").alias("v"))
    return components(size.select(SITE, c("piece").alias("node")), same).select(SITE, c("node").alias("piece"), c("label").alias("group_piece"))


def dominant_cluster(contours: DataFrame, edges: DataFrame) -> DataFrame:
    """A part stays if it is near the largest part, for that part's size, or has enough other objects around it."""
    c = F.col
    area = (c("xm") - c("x0")) * (c("ym") - c("y0"))
    rows = contours.withColumn("area", area)
    anchor = rows.groupBy(SITE).agg(F.max(F.struct("area", -c("piece"), "x0", "y0", "xm", "ym")).alias("a")).select(
        SITE, c("a.x0").alias("ax0"), c("a.y0").alias("ay0"), c("a.xm").alias("axm"), c("a.ym").alias("aym"))
    gx = F.greatest(c("x0") - c("axm"), c("ax0") - c("xm"), F.lit(0)).cast("double")
    gy = F.greatest(c("y0") - c("aym"), c("ay0") - c("ym"), F.lit(0)).cast("double")
    w, h = (c("axm") - c("ax0")).cast("double"), (c("aym") - c("ay0")).cast("double")
    rows = rows.join(anchor, SITE).withColumn("near", F.sqrt(gx * gx + gy * gy) <= F.sqrt(w * w + h * h) * MAX_DISTANCE_RATIO)
    boxes = edges.groupBy(SITE, "gid").agg(F.min(F.least("x1", "x2")).alias("bx0"), F.min(F.least("y1", "y2")).alias("by0"),
                                           F.max(F.greatest("x1", "x2")).alias("bxm"), F.max(F.greatest("y1", "y2")).alias("bym"))
    far = rows.filter(~c("near"))
    touch = ((c("bx0") <= c("xm") + CONTEXT_M) & (c("bxm") >= c("x0") - CONTEXT_M) & (c("by0") <= c("ym") + CONTEXT_M) & (c("bym") >= c("y0") - CONTEXT_M))
    around = far.join(boxes, SITE).filter(touch).groupBy(SITE, "piece").agg(F.count(F.lit(1)).alias("context"))
    out = rows.join(around, [SITE, "piece"], "left").fillna(0, ["context"])
    return out.select(SITE, "piece", (c("near") | (c("context") >= MIN_CONTEXT)).alias("kept"))


def combine(cells: DataFrame) -> DataFrame:
    """Fold of pieces, biggest first: a piece inside what is there is cut out, an island comes back, any other piece is united.

    A piece is inside a bigger one that covers more than 99 % of it, and cut out if an odd number of those do. The last piece of
    the fold that covers a cell decides whether the cell belongs to the result.
    """
    c = F.col
    line = [SITE, "block", "iy"]
    size = cells.groupBy(SITE, "piece").agg(run_cells().alias("n"))
    ranked = cells.join(size, [SITE, "piece"]).withColumn("turn", F.struct(-c("n"), c("piece")))
    other = ranked.select(*line, c("piece").alias("other"), c("turn").alias("other_turn"), c("a").alias("o_a"), c("b").alias("o_b"))
    inside = common_cells(ranked, other).filter(c("other_turn") < c("turn")).groupBy(SITE, "piece", "n", "other").agg(F.sum("common").alias("common"))
    depth = inside.filter(c("common") * 100 > c("n") * 99).groupBy(SITE, "piece").agg(F.count(F.lit(1)).alias("depth"))
    # between two neighbouring ends of runs the same pieces cover all cells of a line
    ends = cells.select(*line, F.explode(F.array(c("a"), c("b") + 1)).alias("o_a")).distinct()
    parts = ends.withColumn("o_b", F.lead("o_a").over(W.partitionBy(*line).orderBy("o_a")) - 1).filter("o_b is not null")
    last = F.max(F.struct("turn", (F.coalesce("depth", F.lit(0)) % 2).alias("odd"))).alias("last")
    cover = common_cells(ranked.join(depth, [SITE, "piece"], "left"), parts).groupBy(*line, "o_a", "common").agg(last)
    return cover.filter(c("last.odd") == 0).groupBy(SITE).agg(F.sum("common").alias("area_m2"))


def territory_or_error(sites: DataFrame, chosen: DataFrame, area: DataFrame) -> DataFrame:
    """Every site gets a row: its area, or an explicit error instead of an empty success."""
    c = F.col
    rows = sites.select(SITE).join(chosen, SITE, "left").join(area, SITE, "left")
    status = F.when(c("status").isNull(), "missing").when(c("status") != "ok", c("status")).when(F.coalesce("area_m2", F.lit(0)) <= 0, "empty").otherwise("ok")
    return rows.select(SITE, "source", F.when(status == "ok", c("area_m2")).alias("area_m2"), status.alias("status"))
