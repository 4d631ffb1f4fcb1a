"""A planar map of drawn lines: noding on a grid, faces as cycles of half-edges, rings with their holes, leftovers.

Vertices are snapped to a grid and everything after that is whole numbers: orientation tests are exact, crossings are rounded once
to a hundredth of the grid from an exact fraction, so both lines get the same node. Segments of up to 200 000 grid units (10 km on
a 5 cm grid) stay within 64 bits; longer ones end the query with an overflow error.

Every piece is two half-edges. At a node the half-edge before an outgoing one is the twin of its neighbour by angle, which makes
faces the cycles of a permutation; their labels and orders come from pointer doubling (`ranked_lists`). A piece with the same face
on both sides bounds nothing: it is a dangle if one end of it leads to no ring, else a cut between rings. Both are told apart by
counting the other half-edges along the face between its two sides. What is left is traced again and consists of rings only: those
with their area on the left bound faces, the others are the outer outlines of what lies in a face.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit.operators.buckets import SITE, inside, to_cells
from sitefit.operators.lists import ranked_lists, running
from sitefit.session import stored

#: Parts of a grid unit to which crossings are rounded.
FINE = 100
TYPE = "object_type"
NODE = ("x1", "y1", "x2", "y2")


class Map(NamedTuple):
    """``rings``: one row per edge (site, type, shell, ring, seq, x1, y1, x2, y2), a hole's ring lists its shell; ``leftovers``:
    pieces that bound no face (site, type, kind, x1, y1, x2, y2). Coordinates are fine units, ``scale`` of them make a metre."""

    rings: DataFrame
    leftovers: DataFrame
    scale: float


def noded(lines: DataFrame, grid: float, size: float = 16.0) -> DataFrame:
    """Distinct pieces (site, type, x1, y1, x2, y2 in fine units, lesser end first) of lines cut where they cross, touch or overlap."""
    c = F.col
    snap = lambda n: F.floor(c(n) / grid + 0.5).cast("long")
    p, q = F.struct(snap("x1").alias("x"), snap("y1").alias("y")), F.struct(snap("x2").alias("x"), snap("y2").alias("y"))
    own = lines.filter(c("x1").isNotNull() & c("y1").isNotNull() & c("x2").isNotNull() & c("y2").isNotNull())
    segments = stored(own.select(SITE, TYPE, F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).filter(c("p") != c("q")).distinct())
    metre = lambda n: (c(n) * F.lit(grid)).alias
    cells = to_cells(segments.select(SITE, TYPE, "p", "q", metre("p.x")("x1"), metre("p.y")("y1"), metre("q.x")("x2"), metre("q.y")("y2")), size, 0.0)
    left = cells.select(SITE, TYPE, "cx", "cy", "p", "q")
    right = left.select(SITE, TYPE, "cx", "cy", c("p").alias("r"), c("q").alias("s"))
    first = (c("p") < c("r")) | ((c("p") == c("r")) & (c("q") < c("s")))
    near = (F.least("p.y", "q.y") <= F.greatest("r.y", "s.y")) & (F.least("r.y", "s.y") <= F.greatest("p.y", "q.y")) & (c("r.x") <= c("q.x")) & (c("p.x") <= c("s.x"))
    pairs = left.join(right, [SITE, TYPE, "cx", "cy"]).filter(first & near).select(SITE, TYPE, "p", "q", "r", "s").distinct()

    side = lambda a, b, d: (c(f"{b}.x") - c(f"{a}.x")) * (c(f"{d}.y") - c(f"{a}.y")) - (c(f"{b}.y") - c(f"{a}.y")) * (c(f"{d}.x") - c(f"{a}.x"))
    pairs = pairs.select("*", F.explode(F.array(F.struct(side("p", "q", "r").alias("a"), side("p", "q", "s").alias("b"), side("r", "s", "p").alias("c"), side("r", "s", "q").alias("d")))).alias("o"))
    sign = F.when(c("o.c") > c("o.d"), 1).otherwise(-1)
    num, den = c("o.c") * sign, (c("o.c") - c("o.d")) * sign
    crossing = (F.signum("o.a") * F.signum("o.b") < 0) & (F.signum("o.c") * F.signum("o.d") < 0)

    def rounded(n: str) -> Column:
        """p + (q - p) * num / den in fine units, rounded half up."""
        double = num * (c(f"q.{n}") - c(f"p.{n}")) * (2 * FINE) + den
        return (c(f"p.{n}") * FINE + F.call_function("div", double - F.pmod(double, den * 2), den * 2)).alias(n)

    def on(a: str, b: str, at: str, turn: str) -> Column:
        """The end ``at`` lies on the segment a-b, between its ends."""
        within = (F.least(f"{a}.y", f"{b}.y") <= c(f"{at}.y")) & (c(f"{at}.y") <= F.greatest(f"{a}.y", f"{b}.y")) & (c(f"{a}.x") <= c(f"{at}.x")) & (c(f"{at}.x") <= c(f"{b}.x"))
        return F.when((c(f"o.{turn}") == 0) & within, F.struct(c(a).alias("p"), c(b).alias("q"), whole(at).alias("at")))

    whole = lambda n: F.struct((c(f"{n}.x") * FINE).alias("x"), (c(f"{n}.y") * FINE).alias("y"))
    meet = F.struct(rounded("x"), rounded("y"))
    crossed = pairs.filter(crossing).select(SITE, TYPE, "p", "q", "r", "s", F.explode(F.array(meet)).alias("at"))
    cuts = crossed.select(SITE, TYPE, "p", "q", "at").unionByName(crossed.select(SITE, TYPE, c("r").alias("p"), c("s").alias("q"), "at"))
    touch = pairs.filter((c("o.a") == 0) | (c("o.b") == 0) | (c("o.c") == 0) | (c("o.d") == 0))
    touch = touch.select(SITE, TYPE, F.explode(F.array(on("p", "q", "r", "a"), on("p", "q", "s", "b"), on("r", "s", "p", "c"), on("r", "s", "q", "d"))).alias("t")).filter("t IS NOT NULL")
    ends = segments.select(SITE, TYPE, "p", "q", F.explode(F.array(whole("p"), whole("q"))).alias("at"))
    points = cuts.unionByName(touch.select(SITE, TYPE, "t.p", "t.q", "t.at")).unionByName(ends).distinct()

    up = F.when(c("q.y") >= c("p.y"), 1).otherwise(-1)  # p.x <= q.x, so the order along the line is x, then y in its direction
    steep = F.abs(c("q.y") - c("p.y")) > c("q.x") - c("p.x")
    along = [F.when(steep, c("at.y") * up).otherwise(c("at.x")), F.when(steep, c("at.x")).otherwise(c("at.y") * up)]
    w = W.partitionBy(SITE, TYPE, "p", "q").orderBy(*along)
    pieces = points.withColumn("to", F.lead("at").over(w)).filter(c("to").isNotNull() & (c("to") != c("at")))
    a, b = F.least("at", "to"), F.greatest("at", "to")
    return pieces.select(SITE, TYPE, a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")).distinct()


def half_edges(pieces: DataFrame) -> DataFrame:
    """Both directions of every piece; ``id`` is even from the lesser end, the twin's differs in the last bit."""
    c = F.col
    rows = stored(pieces.select(SITE, TYPE, *NODE, F.monotonically_increasing_id().alias("e")))
    there, back = (c("e") * 2).alias("id"), (c("e") * 2 + 1).alias("id")
    turned = [c(a).alias(b) for a, b in zip(("x2", "y2", "x1", "y1"), NODE, strict=True)]
    return rows.select(SITE, TYPE, there, *NODE).unionByName(rows.select(SITE, TYPE, back, *turned))


def traced(halves: DataFrame) -> DataFrame:
    """Half-edges with the face on their left: ``label`` and ``pos`` along it."""
    c = F.col
    at = W.partitionBy(SITE, TYPE, "x1", "y1")
    order = [F.atan2((c("y2") - c("y1")).cast("double"), (c("x2") - c("x1")).cast("double")), c("id")]
    round_ = F.coalesce(F.lead("id").over(at.orderBy(*order)), F.first("id").over(at.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    linked = stored(halves.withColumn("prev", round_.bitwiseXOR(F.lit(1).cast("long"))))
    return linked.drop("prev").join(ranked_lists(linked.select(SITE, "id", "prev")), [SITE, "id"])


def doubled_area(rows: DataFrame) -> DataFrame:
    """(site, type, label, area2): twice the signed area of each face in square fine units, an exact whole number."""
    c = F.col
    wide = lambda n: c(n).cast("decimal(18,0)")
    return rows.groupBy(SITE, TYPE, "label").agg(F.sum((wide("x1") * wide("y2") - wide("x2") * wide("y1")).cast("decimal(38,0)")).cast("long").alias("area2"))


def planar_map(lines: DataFrame, grid: float) -> Map:
    """Rings and leftovers of lines (site, type, x1, y1, x2, y2) on a grid of ``grid`` metres, by object type.

    Each ring that bounds a face is a shell; an outline inside it is its hole if no smaller shell holds it. Repeated and
    zero-length lines count once or not at all, lines with a null coordinate are left out, an empty table gives empty tables.
    """
    c = F.col
    scale = FINE / grid
    faces = stored(traced(half_edges(noded(lines, grid))))
    by_piece = faces.groupBy(SITE, TYPE, F.shiftright("id", 1).alias("e")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    loose = by_piece.filter(c("low") == c("high")).select(SITE, "e")
    marked = faces.withColumn("e", F.shiftright("id", 1)).join(loose.withColumn("loose", F.lit(True)), [SITE, "e"], "left").withColumn("loose", c("loose").isNotNull())
    marked = stored(running(marked, [SITE, "label"], F.when(c("loose"), 0).otherwise(1), "before"))
    total = marked.filter(~c("loose")).groupBy(SITE, "label").agg(F.count(F.lit(1)).alias("total"))
    sides = marked.filter("loose").groupBy(SITE, TYPE, "label", "e").agg(F.min("before").alias("b0"), F.max("before").alias("b1"), *[F.min(F.when(c("id") % 2 == 0, c(n))).alias(n) for n in NODE])
    between = c("b1") - c("b0")
    dangles = (between == 0) | (between == F.coalesce("total", F.lit(0)))
    leftovers = sides.join(total, [SITE, "label"], "left").select(SITE, TYPE, F.when(dangles, "dangle").otherwise("cut").alias("kind"), *NODE)

    rings = stored(traced(marked.filter(~c("loose")).select(SITE, TYPE, "id", *NODE)))
    areas = stored(doubled_area(rings))
    shells, outer = areas.filter("area2 > 0"), areas.filter("area2 < 0")
    top = rings.join(outer, [SITE, TYPE, "label"]).groupBy(SITE, TYPE, "label").agg(F.max(F.struct("x1", "y1")).alias("at"))
    metres = lambda n: c(n) / F.lit(scale)
    points = top.select(SITE, c("label").alias("hole"), metres("at.x1").alias("x"), metres("at.y1").alias("y"))
    walls = rings.join(shells, [SITE, TYPE, "label"]).select(SITE, c("label").alias("gid"), *[metres(n).alias(n) for n in NODE])
    holder = inside(points, walls, "hole").join(outer.select(SITE, TYPE, c("label").alias("hole")), [SITE, "hole"]).join(shells.select(SITE, TYPE, c("label").alias("gid"), "area2"), [SITE, TYPE, "gid"])
    parents = holder.groupBy(SITE, TYPE, c("hole").alias("label")).agg(F.min(F.struct("area2", "gid")).alias("best")).select(SITE, TYPE, "label", c("best.gid").alias("shell"))
    owner = shells.select(SITE, TYPE, "label", c("label").alias("shell")).unionByName(parents)
    out = rings.join(owner, [SITE, TYPE, "label"]).select(SITE, TYPE, "shell", c("label").alias("ring"), c("pos").alias("seq"), *NODE)
    return Map(stored(out), stored(leftovers), scale)


def polygons(found: Map) -> DataFrame:
    """One row per polygon: its least vertex, points of all its rings, holes and area in square metres."""
    c = F.col
    own = doubled_area(found.rings.select(SITE, TYPE, c("shell").alias("label"), *NODE)).withColumnRenamed("label", "shell")
    shape = found.rings.groupBy(SITE, TYPE, "shell").agg(
        F.min(F.when(c("ring") == c("shell"), F.struct("x1", "y1"))).alias("at"), F.count(F.lit(1)).alias("points"), (F.count_distinct("ring") - 1).alias("holes"))
    per = F.lit(2.0 * found.scale * found.scale)
    return shape.join(own, [SITE, TYPE, "shell"]).select(SITE, TYPE, (c("at.x1") / F.lit(found.scale)).alias("x"), (c("at.y1") / F.lit(found.scale)).alias("y"), "points", "holes", (c("area2") / per).alias("area_m2"))


def footprints(edges: DataFrame, grid: float, inflate: float) -> DataFrame:
    """Closed outlines out of line soup, as edges (site, type, gid, ring, seq, x1 .. y2, inflate_m, source).

    Polygons pass through (source ``drawn``), rings closed by lines become polygons with their holes (``closed``), and pieces that
    close nothing stay as edges widened by ``inflate`` metres (``leftover``), or go if it is 0. Points are not touched here.
    """
    c = F.col
    drawn = edges.filter(c("geom_kind") == "polygon").select(SITE, TYPE, "gid", F.lit(0).cast("long").alias("ring"), c("seq").cast("long").alias("seq"), *NODE, F.lit(0.0).alias("inflate_m"), F.lit("drawn").alias("source"))
    found = planar_map(edges.filter(c("geom_kind") == "line"), grid)
    metres = [(c(n) / F.lit(found.scale)).alias(n) for n in NODE]
    closed = found.rings.select(SITE, TYPE, (-c("shell") - 1).alias("gid"), "ring", "seq", *metres, F.lit(0.0).alias("inflate_m"), F.lit("closed").alias("source"))
    out = drawn.unionByName(closed)
    if inflate > 0:
        gid = F.xxhash64(SITE, TYPE, *NODE)
        out = out.unionByName(found.leftovers.select(SITE, TYPE, gid.alias("gid"), F.lit(0).cast("long").alias("ring"), F.lit(0).cast("long").alias("seq"), *metres, F.lit(float(inflate)).alias("inflate_m"), F.lit("leftover").alias("source")))
    return out


def road_loops(edges: DataFrame, grid: float = 0.1) -> DataFrame:
    """Surfaces enclosed by kerb lines, as edges beside the lines: (site, type, gid, ring, seq, x1 .. y2, reconstructed_loop).

    All input edges stay as they are; loops of lines of one type are added as polygons of that type with the flag set. Open ends
    and other leftovers add nothing.
    """
    c = F.col
    found = planar_map(edges.filter(c("geom_kind") == "line"), grid)
    metres = [(c(n) / F.lit(found.scale)).alias(n) for n in NODE]
    loops = found.rings.select(SITE, TYPE, (-c("shell") - 1).alias("gid"), "ring", "seq", *metres, F.lit(True).alias("reconstructed_loop"))
    kept = edges.select(SITE, TYPE, "gid", F.lit(0).cast("long").alias("ring"), c("seq").cast("long").alias("seq"), *NODE, F.lit(False).alias("reconstructed_loop"))
    return kept.unionByName(loops)
