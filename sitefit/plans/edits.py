"""Edit log of a plan: folding, guards, undo snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit.operators.buckets import SITE, inside_site

CHUNK_SECONDS = 6 * 3600


def carried(df: DataFrame, keys: list[str], value: Column, name: str, total: bool = False) -> DataFrame:
    """Last non-null value (or running sum) strictly before each row, in (ts, seq) order per key.

    A long log of one key is not sorted in one task: rows are ordered inside time chunks, and the chunks, one
    small row each, carry their result to the next.
    """
    c = F.col
    df = df.withColumn("_v", value)
    inner = W.partitionBy(*keys, "chunk").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    if total:
        local, whole = F.sum("_v").over(inner), F.sum("_v")
    else:
        local = F.last("_v", ignorenulls=True).over(inner)
        whole = F.max_by("_v", F.when(c("_v").isNotNull(), F.struct("ts", "seq")))
    chunks = df.groupBy(*keys, "chunk").agg(whole.alias("_c"))
    outer = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    over = (F.sum("_c") if total else F.last("_c", ignorenulls=True)).over(outer)
    chunks = chunks.withColumn("_before", over).drop("_c")
    out = df.withColumn("_l", local).join(chunks, [*keys, "chunk"])
    joined = F.coalesce(c("_l"), F.lit(0)) + F.coalesce(c("_before"), F.lit(0)) if total else F.coalesce("_l", "_before")
    return out.withColumn(name, joined).drop("_v", "_l", "_before")


def effective(edits: DataFrame, items: DataFrame) -> DataFrame:
    """Edits of known items with their effect: nothing happens to a deleted item except a restore, and a point
    never becomes a lawn or the other way round."""
    c = F.col
    rows = edits.join(items.select(SITE, "item_id", "planting_type"), "item_id").withColumn("chunk", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / CHUNK_SECONDS))
    rows = carried(rows, ["item_id"], F.when(c("op").isin("delete", "restore"), c("op")), "life")
    alive = F.coalesce(c("life"), F.lit("restore")) == "restore"
    fits = (c("planting_type") == "lawn") == (c("new_type") == "lawn")
    ok = (F.when(c("op") == "restore", ~alive).when(c("op") == "retype", alive & fits).otherwise(alive))
    return rows.withColumn("ok", ok)


def edit_fold(edits: DataFrame, items: DataFrame) -> DataFrame:
    """Current state of every item after the whole log."""
    c = F.col
    at = F.struct("ts", "seq")
    on = lambda op: c("ok") & (c("op") == op)
    state = effective(edits, items).groupBy("item_id").agg(
        F.sum(F.when(on("move"), c("dxc")).otherwise(0)).alias("dxc"), F.sum(F.when(on("move"), c("dyc")).otherwise(0)).alias("dyc"),
        F.max_by("new_type", F.when(on("retype"), at)).alias("last_type"), F.max_by("new_species", F.when(on("patch"), at)).alias("last_species"),
        F.max_by("op", F.when(c("ok") & c("op").isin("delete", "restore"), at)).alias("life"),
        F.bool_or(c("ok") & c("op").isin("move", "retype", "patch")).alias("touched"), F.sum(c("ok").cast("long")).alias("edits"))
    return folded(items, state)


def folded(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with what their edits add up to (item_id, dxc, dyc, last_type, last_species, life, touched, edits)."""
    rows = items.join(state, "item_id", "left").fillna(0, ["dxc", "dyc", "edits"])
    c = F.col
    return rows.select(SITE, "item_id", F.coalesce("last_type", "planting_type").alias("planting_type"), F.coalesce("last_species", "species").alias("species"),
                       ((c("xc") + c("dxc")) / F.lit(100.0)).alias("x"), ((c("yc") + c("dyc")) / F.lit(100.0)).alias("y"),
                       (F.coalesce("life", F.lit("restore")) == "restore").alias("alive"),
                       (c("is_manual_edit") | F.coalesce("touched", F.lit(False))).alias("is_manual_edit"), "edits")


def edit_guards(edits: DataFrame, items: DataFrame, outline: DataFrame) -> DataFrame:
    """A batch is applied as a whole or not at all: unknown ids, restores of present items, moves off the site."""
    c = F.col
    rows = edits.join(items.select(SITE, "item_id", "planting_type", "xc", "yc"), "item_id", "left")
    moved = rows.filter((c("op") == "move") & c(SITE).isNotNull()).select(SITE, "seq", ((c("xc") + c("dxc")) / 100.0).alias("x"), ((c("yc") + c("dyc")) / 100.0).alias("y"))
    held = inside_site(moved, outline, "seq").select("seq", F.lit(True).alias("inside"))
    rows = rows.join(held, "seq", "left")
    unknown = c("planting_type").isNull()
    mismatch = (c("op") == "retype") & ((c("planting_type") == "lawn") != (c("new_type") == "lawn"))
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("edits"), F.sum(unknown.cast("long")).alias("unknown"), F.sum(((c("op") == "restore") & ~unknown).cast("long")).alias("present"),
        F.sum(((c("op") == "move") & ~unknown & c("inside").isNull()).cast("long")).alias("outside"), F.sum(F.coalesce(mismatch, F.lit(False)).cast("long")).alias("skipped")
    ).withColumn("accepted", (c("unknown") + c("present") + c("outside")) == 0)


def edit_inverse(edits: DataFrame, items: DataFrame) -> DataFrame:
    """State of the item just before each effective edit: what an undo has to bring back."""
    c = F.col
    rows = effective(edits, items).filter("ok")
    move = F.when(c("op") == "move", c("dxc")).otherwise(0)
    rows = carried(rows, ["item_id"], move, "px", total=True)
    rows = carried(rows, ["item_id"], F.when(c("op") == "move", c("dyc")).otherwise(0), "py", total=True)
    rows = carried(rows, ["item_id"], F.when(c("op") == "retype", c("new_type")), "ptype")
    rows = carried(rows, ["item_id"], F.when(c("op") == "patch", c("new_species")), "pspecies")
    base = items.select("item_id", "xc", "yc", "species")
    return rows.join(base, "item_id").select("seq", "item_id", "op", ((c("xc") + c("px")) / 100.0).alias("x"), ((c("yc") + c("py")) / 100.0).alias("y"),
                                             F.coalesce("ptype", "planting_type").alias("planting_type"), F.coalesce("pspecies", "species").alias("species"))


def chain_order(items: DataFrame, key: str = "group_id") -> DataFrame:
    """Row members in walking order: start farthest from the mean, then the nearest one not visited.

    The walk is a chain of dependent steps, so a row is one task, whatever its length; a step searches the grid cells around
    the last member, so a row of n members costs about n steps, not n * n.
    """
    rows = items.filter(F.col(key).contains("-row-")).select(SITE, F.col(key).alias("group_id"), "item_id", "xc", "yc")

    def walk(pdf):
        import numpy as np

        pdf = pdf.sort_values("item_id").reset_index(drop=True)
        x, y, n = pdf.xc.to_numpy(), pdf.yc.to_numpy(), len(pdf)
        # n times the offset from the mean keeps the arithmetic in integers
        at = int(np.argmax((n * x - x.sum()) ** 2 + (n * y - y.sum()) ** 2))
        pos = np.empty(n, dtype=np.int64)
        size = max(1, int(max(np.ptp(x), np.ptp(y))) // max(1, n // 2))
        cells: dict = {}
        for i, spot in enumerate(zip((x // size).tolist(), (y // size).tolist(), strict=True)):
            cells.setdefault(spot, set()).add(i)

        def nearest(i):
            """The free member nearest to i, the first of equals; rings of cells until none farther out can be nearer."""
            cx, cy, best, ring = int(x[i] // size), int(y[i] // size), None, 0
            while cells and (best is None or best[0] > ((ring - 1) * size) ** 2):
                if (2 * ring + 1) ** 2 > 4 * len(cells):  # more cells in the square than are occupied
                    return min(((int(x[j] - x[i]) ** 2 + int(y[j] - y[i]) ** 2, j) for spot in cells.values() for j in spot))[1]
                edge = range(-ring, ring + 1)
                spots = {(cx + a, cy + b) for a in edge for b in ((-ring, ring) if abs(a) != ring else edge)}
                found = [(int(x[j] - x[i]) ** 2 + int(y[j] - y[i]) ** 2, j) for spot in spots for j in cells.get(spot, ())]
                best, ring = min([*found, *([best] if best else [])], default=None), ring + 1
            return best[1]

        for k in range(n):
            pos[at] = k
            spot = (int(x[at] // size), int(y[at] // size))
            cells[spot].discard(at)
            if not cells[spot]:
                del cells[spot]
            if k + 1 < n:
                at = nearest(at)
        return pdf[[SITE, "group_id", "item_id"]].assign(pos=pos)

    return rows.groupBy(SITE, "group_id").applyInPandas(walk, f"{SITE} long, group_id string, item_id long, pos long")


def _steps(items: DataFrame) -> DataFrame:
    """Chain members with the micrometre length of the step to the next one and the position along the row."""
    c = F.col
    order = chain_order(items).join(items.select(SITE, "item_id", "x", "y", "species", "planting_type"), [SITE, "item_id"])
    w = W.partitionBy(SITE, "group_id").orderBy("pos")
    dx, dy = F.lead("x").over(w) - c("x"), F.lead("y").over(w) - c("y")
    rows = order.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("um", F.floor(F.sqrt(dx * dx + dy * dy) * 1e6).cast("long"))
    before = F.coalesce(F.sum("um").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", before)


def respace_row(items: DataFrame, pitch_m: float) -> DataFrame:
    """Rows laid out again at another pitch; tree rows never below the widest crown interval among their members."""
    from sitefit.functions import dims

    c = F.col
    steps = _steps(items)
    spans = dims.species_interval(items.sparkSession).select(c("name").alias("species"), "interval_m")
    need = steps.join(F.broadcast(spans), "species", "left").groupBy(SITE, "group_id").agg(
        F.max(F.when(c("planting_type") == "tree", c("interval_m"))).alias("need"), F.sum("um").alias("total"), F.count(F.lit(1)).alias("members"))
    pitch = int(round(pitch_m * 1e6))
    need = need.withColumn("status", F.when(F.coalesce("need", F.lit(0.0)) > pitch_m + 1e-6, "below interval").when(c("total") < pitch, "too short").otherwise("laid"))
    count = F.floor(c("total") / pitch).cast("long") + 1
    laid = need.filter("status = 'laid'").withColumn("lead", c("total") - (count - 1) * pitch).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    # twice the position keeps the half remainder an integer
    laid = laid.select(SITE, "group_id", "i", (c("lead") + c("i") * (2 * pitch)).alias("at2"))
    part = steps.filter((c("um") > 0)).select(SITE, "group_id", "x", "y", "nx", "ny", "um", "start")
    hit = laid.join(part, [SITE, "group_id"]).filter((c("at2") >= c("start") * 2) & (c("at2") < (c("start") + c("um")) * 2))
    t = (c("at2") - c("start") * 2) / (c("um") * 2)
    return hit.select(SITE, "group_id", "i", (c("x") + (c("nx") - c("x")) * t).alias("x"), (c("y") + (c("ny") - c("y")) * t).alias("y"))


def row_gaps(items: DataFrame) -> DataFrame:
    """Gap a deletion would leave between the chain neighbours; null at the ends of a row."""
    c = F.col
    order = chain_order(items).join(items.select(SITE, "item_id", "x", "y"), [SITE, "item_id"])
    w = W.partitionBy(SITE, "group_id").orderBy("pos")
    dx, dy = F.lead("x").over(w) - F.lag("x").over(w), F.lead("y").over(w) - F.lag("y").over(w)
    return order.select(SITE, "group_id", "item_id", F.sqrt(dx * dx + dy * dy).alias("gap_m"))


def density_stops(items: DataFrame, size: float = 40.0, least: int = 3) -> DataFrame:
    """Cells with enough plants, their centroids in centimetres, toured greedily from one end."""
    c = F.col
    cells = items.groupBy(SITE, F.floor(c("x") / size).cast("long").alias("cx"), F.floor(c("y") / size).cast("long").alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("xc").alias("sx"), F.sum("yc").alias("sy")).filter(c("n") >= least)
    stops = cells.select(SITE, F.lit("stops-row-").alias("group_id"), (c("cx") * 100000 + c("cy")).alias("item_id"),
                         F.floor(c("sx") / c("n")).cast("long").alias("xc"), F.floor(c("sy") / c("n")).cast("long").alias("yc"), "n")
    return chain_order(stops).join(stops.select(SITE, "item_id", "xc", "yc", "n"), [SITE, "item_id"]).select(
        SITE, c("item_id").alias("cell"), "pos", "xc", "yc", "n")


def edited_items(items: DataFrame, state: DataFrame) -> DataFrame:
    """The plan after its edits, with the columns of ``items``; deleted items are not in it."""
    now = folded(items, state).filter("alive").select("item_id", "planting_type", "species", "x", "y", "is_manual_edit")
    kept = [n for n in items.columns if n not in now.columns or n == "item_id"]
    return items.select(*kept).join(now, "item_id").select(*items.columns)
