"""Planar geometry as Column arithmetic: only ``+ - * /``, ``sqrt``, ``least``, ``greatest``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_distance(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a segment; a zero-length segment is a point."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / F.when(len2 > 0, len2)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    return point_distance(px, py, x1 + t * dx, y1 + t * dy)


def ray_crosses(px, py, x1, y1, x2, y2) -> Column:
    """Does a ray from the point towards +x cross the edge? Evaluated from the lower end of the edge."""
    up = y1 <= y2
    xa, ya = F.when(up, x1).otherwise(x2), F.when(up, y1).otherwise(y2)
    xb, yb = F.when(up, x2).otherwise(x1), F.when(up, y2).otherwise(y1)
    span = F.when(yb > ya, yb - ya)
    return (ya <= py) & (py < yb) & (px < xa + (py - ya) * (xb - xa) / span)


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding by plain arithmetic, equal on every engine."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def fixed2(value: Column) -> Column:
    """Two-decimal text of a number."""
    cents = F.floor(F.abs(value) * 100.0 + 0.5).cast("long")
    sign = F.when((value < 0) & (cents > 0), "-").otherwise("")
    return F.concat(sign, F.floor(cents / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def short(value: Column) -> Column:
    """Shortest text of a number: no trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("long")


def segments_cross(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Proper crossing or touching of two segments by orientation signs."""
    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    d1 = side(ax1, ay1, ax2, ay2, bx1, by1)
    d2 = side(ax1, ay1, ax2, ay2, bx2, by2)
    d3 = side(bx1, by1, bx2, by2, ax1, ay1)
    d4 = side(bx1, by1, bx2, by2, ax2, ay2)
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
