"""First come, first served on points of the plane, in turns over strips of a site.

A point is accepted when no better one that was accepted meets it. In a turn a task goes through the points of its strip, best first,
and settles all that its strip suffices for; a point near the strip's border, or met by a better one left open, stays open. The strips
of the next turn lie half a strip off, so that borders come to lie in the middle. The result is that of one pass over all points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.operators.buckets import SITE
from sitefit.operators.ground import dealt
from sitefit.session import discard, new_table, stored

#: A point of its kind: place, ``sy``: the coordinate that strips cut, ``r`` for `meets`; the lowest (k1, k2, id) comes first.
POINT = f"{SITE} long, kind long, id long, x double, y double, sy double, r double, k1 double, k2 long"
STATE = POINT + ", picked boolean, border boolean"
NAMES = [p.split()[0] for p in POINT.split(", ")]
#: Height of a strip in widest meetings.
STRIP_WIDTHS = 8.0

Meets = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def settle(p: dict[str, np.ndarray], carried: np.ndarray, low: float, high: float, widest: float, meets: Meets, margin: float | None = None) -> dict[str, np.ndarray]:
    """Accepted and open points of a strip from ``low`` to ``high``; ``carried`` ones are accepted already and are not returned.

    ``margin`` is ``widest`` in the measure of ``sy``, if that is another one than that of the places.
    """
    margin = widest if margin is None else margin
    odd = ~carried & ~(np.isfinite(p["x"]) & np.isfinite(p["y"]) & np.isfinite(p["sy"]) & np.isfinite(p["r"]))
    whole = p
    order = np.lexsort((p["id"], p["k2"], p["k1"], ~carried))
    order = order[~odd[order]]
    p, first = {n: v[order] for n, v in p.items()}, int(carried[order].sum())
    x, y, r, n = p["x"], p["y"], p["r"], len(order)
    border = (p["sy"] - low < margin) | (high - p["sy"] < margin)
    state, picked = np.zeros(n, np.uint8), np.zeros(n, bool)  # 1: refused, 2: met by a better one left open
    if n:
        cx, cy = (np.floor(v / widest).astype(np.int64) for v in (x, y))
        cx, cy = cx - cx.min() + 1, cy - cy.min() + 1
        wide = int(cx.max()) + 2
        code = (np.unique(p["kind"], return_inverse=True)[1] * (int(cy.max()) + 2) + cy) * wide + cx
        by = np.argsort(code, kind="stable")
        codes = code[by]
        spans = [(np.searchsorted(codes, code + d * wide - 1).tolist(), np.searchsorted(codes, code + d * wide + 1, "right").tolist()) for d in (-1, 0, 1)]
        seen, edge = memoryview(state), border.tolist()
        for i in range(n):
            if seen[i] == 1 and i >= first:
                continue
            near = np.concatenate([by[a[i] : b[i]] for a, b in spans])
            near = near[near > i]
            near = near[meets(x[near] - x[i], y[near] - y[i], r[i], r[near])]
            if i >= first and (edge[i] or seen[i] == 2):
                state[i] = 2
                state[near[state[near] == 0]] = 2
            else:
                picked[i] = True
                state[near] = 1
    kept = np.flatnonzero((state != 1) & (np.arange(n) >= first))
    out = {name: np.concatenate([p[name][kept], whole[name][odd]]) for name in p}
    return out | {"picked": np.concatenate([picked[kept], np.ones(odd.sum(), bool)]), "border": np.concatenate([border[kept], np.zeros(odd.sum(), bool)])}


def as_table(found: dict[str, np.ndarray], kinds: pa.Schema, site: int | None) -> pa.Table:
    size = len(found["id"])
    columns = [pa.array([site] * size, f.type) if f.name == SITE else pa.array(found[f.name], f.type, from_pandas=True) for f in kinds]
    return pa.Table.from_arrays(columns, schema=kinds)


def schema_of(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def one_turn(rows: DataFrame, turn: int, height: float, widest: float, meets: Meets, margin: float | None = None) -> DataFrame:
    """Accepted and open points (STATE) of rows with ``carried``."""
    kinds, shift = schema_of(STATE), (turn % 2) * 0.5

    def run(table: pa.Table) -> pa.Table:
        p = {n: table.column(n).to_numpy() for n in NAMES if n != SITE}
        site, strip = table.column(SITE)[0].as_py(), table.column("strip")[0].as_py()
        if site is None or strip is None:
            # no place: met by nothing
            return as_table(p | {"picked": np.ones(len(p["id"]), bool), "border": np.zeros(len(p["id"]), bool)}, kinds, site)
        return as_table(settle(p, table.column("carried").to_numpy(), (strip - shift) * height, (strip + 1 - shift) * height, widest, meets, margin), kinds, site)

    rows = rows.select(*NAMES, "carried", F.floor(F.col("sy") / height + shift).cast("long").alias("strip"))
    return dealt(rows, SITE, "strip").groupBy(SITE, "strip").applyInArrow(run, STATE)


def first_come(points: DataFrame, widest: float, meets: Meets) -> DataFrame:
    """The accepted ones of points (POINT), with their columns. Points farther apart than ``widest`` never meet."""
    height = STRIP_WIDTHS * widest
    return later_turns(one_turn(points.select(*NAMES, F.lit(False).alias("carried")), 0, height, widest, meets), height, widest, meets)


def later_turns(settled: DataFrame, height: float, widest: float, meets: Meets, margin: float | None = None) -> DataFrame:
    """The accepted points of a first turn and of the turns after it."""
    spark, turn, out, old = settled.sparkSession, 0, None, None
    while True:
        path = new_table(spark)
        open_path = new_table(spark)
        settled = stored(settled, path)
        won = settled.filter("picked").select(*NAMES)
        out = won if out is None else out.unionByName(won)
        if old:
            discard(spark, old)
        left = stored(settled.filter("not picked").select(*NAMES, F.lit(False).alias("carried")), open_path)
        if left.isEmpty():
            return out
        old, turn = open_path, turn + 1
        # what was accepted by a border refuses what it meets across
        carried = settled.filter("picked and border").select(*NAMES, F.lit(True).alias("carried"))
        settled = one_turn(left.unionByName(carried), turn, height, widest, meets, margin)
