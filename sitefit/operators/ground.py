"""What closes the ground of a site, judged strip by strip: lines go to the strips they reach, a task judges the cells or points of its strip.

Cells are made, measured and summed up where the lines of their strip are; no table of cells is written or shuffled. The arithmetic
is that of `segment_distance` and `ray_crosses`, in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.operators.buckets import SITE

#: Raster lines of a strip of cells; height in metres of a strip of points.
LINES, STRIP_M = 64, 24.0
#: Lines whose cells or points are measured at a time.
AT_ONCE = 1024
SLACK = 1e-6
#: What a line does: closes the site, closes a polygon, keeps its distance, keeps its distance without counting as a constraint.
OUTLINE, POLYGON, CONSTRAINT, MARGIN = range(4)
XY = ("x1", "y1", "x2", "y2")


def blocker_names() -> list[str]:
    from sitefit.operators.area import HARD_KEY, MARGIN_KEY
    from sitefit.operators.compliance import CHECKED_TYPES

    names = [*CHECKED_TYPES, MARGIN_KEY, HARD_KEY]
    if len(names) > 63:
        raise ValueError("more kinds of blockers than bits")
    return names


def closing_lines(outline: DataFrame, edges: DataFrame, planting_type: str) -> DataFrame:
    """(site, role, shape, bit, need, x1 .. y2): all that `blocker_cells` looks at; ``bit`` has a bit set for each blocker named by the line."""
    from sitefit.operators.area import HARD_KEY, MARGIN_KEY, required_reach

    c = F.col
    names = blocker_names()
    norms = next(r for r in fx.TYPE_NORMS if r[0] == planting_type)
    bit = lambda name: F.coalesce(*[F.when(name == n, F.lit(1 << k)) for k, n in enumerate(names)], F.lit(0)).cast("long")
    part = lambda rows, role, shape, bits, need: rows.select(
        c(SITE).cast("long").alias(SITE), F.lit(role).cast("long").alias("role"), shape.cast("long").alias("shape"), bits.alias("bit"), need.cast("double").alias("need"), *XY)
    none = F.lit(0)
    areas = edges.filter((c("geom_kind") == "polygon") & c("object_type").isin(sorted({r[0] for r in fx.SETBACKS} | set(fx.HARD_OBSTACLES))))
    known = F.when(c("object_type").isin([r[0] for r in fx.SETBACKS]), bit(c("object_type"))).otherwise(F.lit(0).cast("long"))
    solid = F.when(c("object_type").isin(list(fx.HARD_OBSTACLES)), bit(F.lit(HARD_KEY))).otherwise(F.lit(0).cast("long"))
    rows = part(outline, OUTLINE, none, none.cast("long"), F.lit(0.0))
    rows = rows.unionByName(part(areas, POLYGON, F.xxhash64("gid", "object_type"), known.bitwiseOR(solid), F.lit(0.0)))
    rows = rows.unionByName(part(required_reach(edges, planting_type), CONSTRAINT, none, bit(c("object_type")), c("required_m")))
    rows = rows.unionByName(part(outline, MARGIN, none, bit(F.lit(MARGIN_KEY)), F.lit(norms[4])))
    if planting_type != "lawn":
        trunks = edges.filter((c("geom_kind") == "point") & (c("object_type") == "existing_greenery"))
        rows = rows.unionByName(part(trunks, MARGIN, none, bit(F.lit(HARD_KEY)), F.lit(norms[2])))
    return rows.filter((c("need") >= 0) & c(SITE).isNotNull())


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, v) for every whole number v from low[k] to high[k]."""
    n = np.maximum(high - low + 1, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + low[k]


def distances(px, py, x1, y1, x2, y2) -> np.ndarray:
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / np.where(len2 > 0, len2, 1.0)
    t = np.where(len2 > 0, np.maximum(0.0, np.minimum(1.0, along)), 0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return np.sqrt(ex * ex + ey * ey)


def columns_of(table: pa.Table, *names: str) -> dict[str, np.ndarray]:
    return {n: table.column(n).to_numpy() for n in names}


LINE = ("role", "shape", "bit", "need", *XY)


def chosen(lines: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {n: v[which] for n, v in lines.items()}


def upward(e: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    up = e["y1"] <= e["y2"]
    return tuple(np.where(up, e[a], e[b]) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1")))


# ---- cells ------------------------------------------------------------------------------------------------------------


def held_cells(e: dict[str, np.ndarray], xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape's line number, cell) of the cells in the shapes that the lines close: cells between two cuts of a raster line."""
    xa, ya, xb, yb = upward(e)
    k, line = spread(np.searchsorted(ys, ya), np.searchsorted(ys, yb) - 1)
    cut = xa[k] + (ys[line] - ya[k]) * (xb[k] - xa[k]) / (yb[k] - ya[k])
    order = np.lexsort((cut, line, e["shape"][k]))
    k, line, at = k[order], line[order], np.searchsorted(xs, cut[order])
    if not len(k):
        return k, k
    shape = e["shape"][k]
    first = np.r_[True, (shape[1:] != shape[:-1]) | (line[1:] != line[:-1])]
    number = np.arange(len(k)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    opens = np.flatnonzero((number[:-1] % 2 == 0) & ~first[1:])
    run, ix = spread(at[opens], at[opens + 1] - 1)
    return k[opens][run], line[opens][run] * len(xs) + ix


def near_cells(e: dict[str, np.ndarray], xs: np.ndarray, ys: np.ndarray, room: float):
    """(line, cell, distance) of the cells within ``need`` and ``room`` of each line, so many lines at a time."""
    for start in range(0, len(e["need"]), AT_ONCE):
        part = {n: v[start : start + AT_ONCE] for n, v in e.items()}
        x1, y1, x2, y2 = (part[n] for n in XY)
        r, dx, dy = part["need"] + room + SLACK, x2 - x1, y2 - y1
        k, line = spread(np.searchsorted(ys, np.minimum(y1, y2) - r), np.searchsorted(ys, np.maximum(y1, y2) + r, "right") - 1)
        steep = np.abs(dy) > SLACK
        slope = np.where(steep, dy, 1.0)
        at = lambda v: np.clip((v - y1[k]) / slope[k], 0.0, 1.0)  # noqa: B023, E731
        p, q = x1[k] + np.where(steep[k], at(ys[line] - r[k]), 0.0) * dx[k], x1[k] + np.where(steep[k], at(ys[line] + r[k]), 1.0) * dx[k]
        i, ix = spread(np.searchsorted(xs, np.minimum(p, q) - r[k]), np.searchsorted(xs, np.maximum(p, q) + r[k], "right") - 1)
        k, line = k[i], line[i]
        yield start + k, line * len(xs) + ix, distances(xs[ix], ys[line], x1[k], y1[k], x2[k], y2[k])


class Strip:
    """The cells of a strip: inside the site or not, what closes each, the room beyond the required distances (infinite: none measured)."""

    def __init__(self, table: pa.Table, room: float | None = None) -> None:
        one = lambda n: table.column(n)[0].as_py()
        self.site, self.strip, self.step = one(SITE), one("strip"), one("step")
        nx, first = one("nx"), self.strip * LINES
        self.iy = np.arange(first, min(first + LINES, one("ny")), dtype=np.int64)
        self.xs = (one("x0") + self.step / 2.0) + np.arange(nx) * self.step
        self.ys = (one("y0") + self.step / 2.0) + self.iy * self.step
        self.shape = (len(self.ys), len(self.xs))
        e = columns_of(table, *LINE)
        with np.errstate(divide="ignore", invalid="ignore"):
            self._judge(e, room)

    def _judge(self, e: dict[str, np.ndarray], room: float | None) -> None:
        size = self.shape[0] * self.shape[1]
        inside, self.bits = np.zeros(size, bool), np.zeros(size, np.int64)
        lines = lambda *roles: chosen(e, np.isin(e["role"], roles))
        inside[held_cells(lines(OUTLINE), self.xs, self.ys)[1]] = True
        self.inside = inside
        part = lines(POLYGON)
        k, at = held_cells(part, self.xs, self.ys)
        self._close(at, part["bit"][k])
        self.room = None if room is None else np.full(size, np.inf)
        for roles, more in (((CONSTRAINT,), room or 0.0), ((MARGIN,), 0.0)):
            part = lines(*roles)
            for k, at, dist in near_cells(part, self.xs, self.ys, more):
                need = part["need"][k]
                hit = dist <= need
                self._close(at[hit], part["bit"][k[hit]])
                if room is not None and roles == (CONSTRAINT,):
                    hit = dist <= need + room
                    np.minimum.at(self.room, at[hit], dist[hit] - need[hit])
        self.free = self.inside & (self.bits == 0)

    def _close(self, at: np.ndarray, bit: np.ndarray) -> None:
        for b in np.unique(bit):
            self.bits[at[bit == b]] |= b

    def cell_ids(self, at: np.ndarray) -> np.ndarray:
        line, ix = np.divmod(at, self.shape[1])
        return ix * 1000000 + self.iy[line]


def strips(lines: DataFrame, frames: DataFrame, room: float = 0.0) -> DataFrame:
    """Each line with the frame of its site, once for every strip of cells within its reach and ``room``."""
    c = F.col
    reach = F.when(c("role") >= CONSTRAINT, c("need") + (room + 2 * SLACK)).otherwise(F.lit(0.0))
    rows = lines.join(frames.select(c(SITE).cast("long").alias(SITE), "x0", "y0", "step", "nx", "ny"), SITE)
    number = lambda v: F.floor((v - c("y0")) / c("step") - 0.5)
    low = F.greatest(number(F.least("y1", "y2") - reach) - 1, F.lit(0).cast("long"))
    high = F.least(number(F.greatest("y1", "y2") + reach) + 2, c("ny") - 1)
    return rows.withColumn("strip", F.explode(F.when(low <= high, F.sequence(F.floor(low / LINES), F.floor(high / LINES)))))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session asks for: few bytes can be much work, so they are not put together by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_strip(rows: DataFrame, work: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """Rows that `work` gives for the lines of each strip, as columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(table: pa.Table) -> pa.Table:
        found = work(table)
        return pa.Table.from_arrays([pa.array(found[f.name], f.type) for f in kinds], schema=kinds)

    return dealt(rows, SITE, "strip").groupBy(SITE, "strip").applyInArrow(run, schema)


def same(value, n: int) -> np.ndarray:
    return np.full(n, value)


def open_cells(rows: DataFrame, room: float | None = None) -> DataFrame:
    """(site, cell_id), with ``room`` also (clearance_m), of the cells of the strips that nothing closes."""

    def work(table: pa.Table) -> dict:
        strip = Strip(table, room)
        at = np.flatnonzero(strip.free)
        found = {SITE: same(strip.site, len(at)), "cell_id": strip.cell_ids(at)}
        return found if room is None else found | {"clearance_m": np.minimum(strip.room[at], room)}

    return by_strip(rows, work, f"{SITE} long, cell_id long" + ("" if room is None else ", clearance_m double"))


def strip_budget(rows: DataFrame) -> DataFrame:
    """(site, blocker, n, alone, first_cell, last_cell) a strip; blocker null: n cells in all, alone: closed ones."""
    names = blocker_names()

    def work(table: pa.Table) -> dict:
        strip = Strip(table)
        bits = strip.bits[strip.inside]
        ids = strip.cell_ids(np.flatnonzero(strip.inside))
        single = (bits & (bits - 1)) == 0
        found = [(None, len(bits), int((bits != 0).sum()), None, None)] if len(bits) else []
        for k, name in enumerate(names):
            on = (bits >> k) & 1 == 1
            if on.any():
                found.append((name, int(on.sum()), int((on & single).sum()), int(ids[on].min()), int(ids[on].max())))
        found = list(zip(*found)) or [()] * 5
        return {SITE: same(strip.site, len(found[0])), **dict(zip(("blocker", "n", "alone", "first_cell", "last_cell"), found))}

    return by_strip(rows, work, f"{SITE} long, blocker string, n long, alone long, first_cell long, last_cell long")


# ---- patches ----------------------------------------------------------------------------------------------------------


def runs_of(free: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, a, b) of the runs of free cells in every raster line."""
    padded = np.zeros((shape[0], shape[1] + 1), np.int8)
    padded[:, :-1] = free.reshape(shape)
    change = np.diff(padded.ravel(), prepend=0)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1
    line, a = np.divmod(starts, shape[1] + 1)
    return line, a, ends - line * (shape[1] + 1)


def touching_runs(line: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of neighbouring lines with a column in common."""
    return spread(np.searchsorted(line * width + b, (line - 1) * width + a), np.searchsorted(line * width + a, (line - 1) * width + b, "right") - 1)


def local_parts(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of the connected part of each of n nodes."""
    least = np.arange(n)
    while len(u):
        low = np.minimum(least[u], least[v])
        np.minimum.at(least, least[u], low)
        np.minimum.at(least, least[v], low)
        least = least[least]
        open_ = least[u] != least[v]
        u, v = u[open_], v[open_]
    while (least[least] != least).any():
        least = least[least]
    return least


def strip_parts(strip: Strip) -> tuple:
    """Runs (line, a, b) of the free cells, the number of the part of the strip that each is in, and the least cell of every part."""
    line, a, b = runs_of(strip.free, strip.shape)
    u, v = touching_runs(line, a, b, strip.shape[1] + 1)
    part = np.unique(local_parts(len(line), u, v), return_inverse=True)[1] if len(line) else line
    node = np.full(part.max() + 1 if len(part) else 0, np.iinfo(np.int64).max)
    np.minimum.at(node, part, a * 1000000 + strip.iy[line])
    return line, a, b, part, node, u, v


def parts_of(rows: DataFrame) -> DataFrame:
    """The parts of free cells of each strip, and the runs on its first and last line.

    (site, node, cells, sides, step, border, upper, a, b): a part has ``border`` null; a run of it lies below (``upper``: above) the
    border of that number.
    """
    schema = f"{SITE} long, node long, cells long, sides long, step double, border long, upper boolean, a long, b long"

    def work(table: pa.Table) -> dict:
        strip = Strip(table)
        line, a, b, part, node, u, v = strip_parts(strip)
        size = b - a + 1
        cells, sides = np.bincount(part, size, len(node)).astype(np.int64), np.bincount(part, size * 2 + 2, len(node)).astype(np.int64)
        if len(u):
            sides -= np.bincount(part[u], 2 * (np.minimum(b[u], b[v]) - np.maximum(a[u], a[v]) + 1), len(node)).astype(np.int64)
        low, high = np.flatnonzero(line == 0), np.flatnonzero(line == LINES - 1)
        ends = np.r_[low, high]
        n, m = len(node), len(ends)
        text = lambda first, second: [*first, *second]
        none = [None] * n
        return {SITE: same(strip.site, n + m), "node": np.r_[node, node[part[ends]]], "cells": text(cells.tolist(), [None] * m), "sides": text(sides.tolist(), [None] * m),
                "step": same(strip.step, n + m), "border": text(none, [strip.strip] * len(low) + [strip.strip + 1] * len(high)),
                "upper": text(none, [True] * len(low) + [False] * len(high)), "a": text(none, a[ends].tolist()), "b": text(none, b[ends].tolist())}

    return by_strip(rows, work, schema)


def part_links(parts: DataFrame) -> DataFrame:
    """(site, u, v, shared): parts of neighbouring strips that touch, with the length of their border in cells."""
    c = F.col
    ends = parts.filter("border is not null")
    below = ends.filter("not upper").select(SITE, "border", c("node").alias("u"), "a", "b")
    above = ends.filter("upper").select(SITE, "border", c("node").alias("v"), c("a").alias("a2"), c("b").alias("b2"))
    met = below.join(above, [SITE, "border"]).filter((c("a") <= c("b2")) & (c("a2") <= c("b")))
    return met.groupBy(SITE, "u", "v").agg(F.sum(F.least("b", "b2") - F.greatest("a", "a2") + 1).alias("shared"))


def patch_labels(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(site, node, patch_id): the least cell of the patch that each part of a strip belongs to."""
    from sitefit.operators.iterate import components

    c = F.col
    tied = links.select(SITE, c("u").alias("node")).union(links.select(SITE, c("v").alias("node"))).distinct()
    labels = components(tied, links).select(SITE, "node", c("label").alias("patch_id"))
    whole = parts.filter("border is null").select(SITE, "node")
    return whole.join(labels, [SITE, "node"], "left").withColumn("patch_id", F.coalesce("patch_id", "node"))


def patches(rows: DataFrame) -> DataFrame:
    """Connected parts of the free cells (four neighbours): (site, patch_id, cells, area_m2, perimeter_m)."""
    from sitefit.session import stored

    c = F.col
    parts = stored(parts_of(rows))
    links = stored(part_links(parts))
    labels = patch_labels(parts, links)
    shared = links.groupBy(SITE, c("u").alias("node")).agg(F.sum("shared").alias("shared"))
    rows = parts.filter("border is null").join(shared, [SITE, "node"], "left").fillna(0, ["shared"]).join(labels, [SITE, "node"])
    rows = rows.groupBy(SITE, "patch_id").agg(F.sum("cells").alias("cells"), (F.sum("sides") - F.sum("shared") * 2).alias("sides"), F.first("step").alias("step"))
    return rows.select(SITE, "patch_id", "cells", (c("cells") * c("step") * c("step")).alias("area_m2"), (c("sides") * c("step")).alias("perimeter_m"))


# ---- points -----------------------------------------------------------------------------------------------------------


def held_points(e: dict[str, np.ndarray], px: np.ndarray, py: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which ids lie in one of the shapes, by the even-odd rule over all rows of an id (rows in order of x, ids numbered by ``code``)."""
    size = int(code.max()) + 1
    inside = np.zeros(size, bool)
    xa, ya, xb, yb = upward(e)
    shapes, number = np.unique(e["shape"], return_inverse=True)
    left = np.full(len(shapes), np.inf)
    np.minimum.at(left, number, np.minimum(xa, xb))
    for start in range(0, len(xa), AT_ONCE):
        part = slice(start, start + AT_ONCE)
        k, p = spread(np.searchsorted(px, left[number[part]]), np.searchsorted(px, np.maximum(xa, xb)[part]) - 1)
        k = k + start
        hit = (ya[k] <= py[p]) & (py[p] < yb[k])
        k, p = k[hit], p[hit]
        hit = px[p] < xa[k] + (py[p] - ya[k]) * (xb[k] - xa[k]) / (yb[k] - ya[k])
        found = number[k[hit]] * size + code[p[hit]]
        # a shape's lines may be in several slices: their crossings are added up at the end
        crossed = found if start == 0 else np.r_[crossed, found]
    if len(xa):
        keys, counts = np.unique(crossed, return_counts=True)
        inside[keys[counts % 2 == 1] % size] = True
    return inside


def site_lines(outline: DataFrame) -> DataFrame:
    """The lines of `closing_lines` that bound the sites."""
    c = F.col
    zero = F.lit(0).cast("long")
    return outline.filter(c(SITE).isNotNull()).select(c(SITE).cast("long").alias(SITE), F.lit(OUTLINE).cast("long").alias("role"), zero.alias("shape"), zero.alias("bit"), F.lit(0.0).alias("need"), *XY)


def open_points(points: DataFrame, lines: DataFrame, point_id: str) -> DataFrame:
    """Points (site, x, y, ...) inside their site that no line closes, with all their columns: points and lines are shuffled once, to their strips.

    Rows of one id in a strip are judged together, as by `inside` and `blocker_cells`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    c = F.col
    strip = lambda v: F.floor(v / STRIP_M).cast("long")
    reach = F.when(c("role") >= CONSTRAINT, c("need") + 2 * SLACK).otherwise(F.lit(0.0))
    right = lines.withColumn("strip", F.explode(F.sequence(strip(F.least("y1", "y2") - reach), strip(F.greatest("y1", "y2") + reach))))
    left = points.filter(c(SITE).isNotNull() & c("x").isNotNull() & c("y").isNotNull()).withColumn("strip", strip(c("y"))).withColumn("_key", c(SITE).cast("long"))
    kinds, names = to_arrow_schema(points.schema), points.columns

    def run(found: pa.Table, near: pa.Table) -> pa.Table:
        if not found.num_rows or not near.num_rows:
            return kinds.empty_table()
        found = found.take(np.argsort(found.column("x").to_numpy(), kind="stable"))
        px, py = (found.column(v).to_numpy().astype(float) for v in ("x", "y"))
        code = found.column(point_id).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        e = columns_of(near, *LINE)
        with np.errstate(divide="ignore", invalid="ignore"):
            free = held_points(chosen(e, e["role"] == OUTLINE), px, py, code)
            free &= ~held_points(chosen(e, e["role"] == POLYGON), px, py, code)
            e = chosen(e, e["role"] >= CONSTRAINT)
            x1, y1, x2, y2 = (e[n] for n in XY)
            r = e["need"] + SLACK
            low, high = np.searchsorted(px, np.minimum(x1, x2) - r), np.searchsorted(px, np.maximum(x1, x2) + r, "right") - 1
            for start in range(0, len(r), AT_ONCE):
                part = slice(start, start + AT_ONCE)
                k, p = spread(low[part], high[part])
                k = k + start
                hit = free[code[p]] & (py[p] >= np.minimum(y1, y2)[k] - r[k]) & (py[p] <= np.maximum(y1, y2)[k] + r[k])
                k, p = k[hit], p[hit]
                free[code[p[distances(px[p], py[p], x1[k], y1[k], x2[k], y2[k]) <= e["need"][k]]]] = False
        return found.select(names).filter(pa.array(free[code])).cast(kinds)

    left, right = (dealt(side, "_key", "strip").groupBy("_key", "strip") for side in (left, right.withColumnRenamed(SITE, "_key")))
    return left.cogroup(right).applyInArrow(run, points.schema)



# ---- roomiest spots ---------------------------------------------------------------------------------------------------

#: Room in metres that is measured by writing out cells; cells with more are measured to their nearest lines.
WRITTEN_ROOM_M = 10.0


def far_cells(lines: DataFrame, frames: DataFrame, edges: DataFrame, planting_type: str) -> DataFrame:
    """(site, strip, cell_id, clearance_m) of the free cells with more room than is written out; infinite where the site has no constraint."""
    from sitefit.operators.area import required_reach
    from sitefit.operators.buckets import nearest
    from sitefit.session import stored

    c, most = F.col, WRITTEN_ROOM_M

    def work(table: pa.Table) -> dict:
        strip = Strip(table, most)
        at = np.flatnonzero(strip.free & np.isinf(strip.room))
        line, ix = np.divmod(at, strip.shape[1])
        return {SITE: same(strip.site, len(at)), "strip_no": same(strip.strip, len(at)), "cell_id": strip.cell_ids(at), "x": strip.xs[ix], "y": strip.ys[line]}

    cells = stored(by_strip(strips(lines, frames, most), work, f"{SITE} long, strip_no long, cell_id long, x double, y double"))
    rules = required_reach(edges, planting_type).withColumn("need", c("required_m").cast("string"))
    found = nearest(cells, rules, "cell_id", "need").groupBy(SITE, "cell_id").agg(F.min(c("dist") - c("need").cast("double")).alias("clearance_m"))
    return cells.join(found, [SITE, "cell_id"], "left").select(SITE, c("strip_no").alias("strip"), "cell_id", F.coalesce("clearance_m", F.lit(float("inf"))).alias("clearance_m"))


def roomiest_spots(outline: DataFrame, edges: DataFrame, planting_type: str, disc_m: float, least: float) -> DataFrame:
    """Free cells with most room in each patch, one after another, each taking a disc around itself, until no cell with ``least`` room is left.

    Room is measured to the nearest constraint however far it is. (site, patch_id, round, cell_id, clearance_m)
    """
    from pyspark.sql import Window as W

    from sitefit.operators.area import STEP_M, raster
    from sitefit.operators.firsts import STATE, as_table, later_turns, schema_of, settle
    from sitefit.session import stored

    c, most = F.col, WRITTEN_ROOM_M
    frames = raster(outline)
    lines = stored(closing_lines(outline, edges, planting_type))
    parts = stored(parts_of(strips(lines, frames)))
    labels = patch_labels(parts, stored(part_links(parts)))
    # the least cell of a part lies in its strip
    named = labels.select(SITE, F.floor((c("node") % 1000000) / LINES).alias("strip"), c("node").alias("key"), c("patch_id").alias("patch"), F.lit(None).cast("double").alias("far"))
    far = far_cells(lines, frames, edges, planting_type).select(SITE, "strip", c("cell_id").alias("key"), F.lit(None).cast("long").alias("patch"), c("clearance_m").alias("far"))
    known = named.unionByName(far)
    kinds, square = schema_of(STATE), disc_m * disc_m
    meets = lambda dx, dy, r, s: dx * dx + dy * dy <= square
    height = float(LINES)  # of a strip, in raster lines

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kinds.empty_table()
        strip = Strip(table, most)
        line, a, b, part, node, _, _ = strip_parts(strip)
        key, patch, room = (known.column(n).to_numpy() for n in ("key", "patch", "far"))
        tied = np.isnan(room)
        order = np.argsort(key[tied])
        # runs and free cells follow each other in the same order
        labelled = patch[tied][order].astype(np.int64)[np.searchsorted(key[tied][order], node)] if len(node) else node
        at = np.flatnonzero(strip.free)
        ids, kind, clear = strip.cell_ids(at), np.repeat(labelled[part], b - a + 1) if len(part) else at, strip.room[at]
        order = np.argsort(key[~tied])
        beyond = np.isinf(clear)
        if beyond.any():
            clear[beyond] = room[~tied][order][np.searchsorted(key[~tied][order], ids[beyond])]
        kept = clear >= least
        at, ids, kind, clear = at[kept], ids[kept], kind[kept], clear[kept]
        row, ix = np.divmod(at, strip.shape[1])
        zero = np.zeros(len(at))
        p = {"kind": kind, "id": ids, "x": strip.xs[ix], "y": strip.ys[row], "sy": strip.iy[row] + 0.5, "r": zero, "k1": -clear, "k2": zero.astype(np.int64)}
        found = settle(p, np.zeros(len(at), bool), strip.strip * height, (strip.strip + 1) * height, disc_m, meets, disc_m / strip.step + SLACK)
        return as_table(found, kinds, strip.site)

    left, right = (dealt(side, SITE, "strip").groupBy(SITE, "strip") for side in (strips(lines, frames, most), known))
    first = left.cogroup(right).applyInArrow(run, STATE)
    won = later_turns(first, height, disc_m, meets, disc_m / STEP_M + SLACK)
    order = W.partitionBy(SITE, "kind").orderBy("k1", "id")
    return won.select(SITE, c("kind").alias("patch_id"), (F.row_number().over(order) - 1).alias("round"), c("id").alias("cell_id"), (-c("k1")).alias("clearance_m"))
