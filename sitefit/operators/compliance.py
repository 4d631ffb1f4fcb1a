"""Checks of placements against the rulebook, and everything derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions import dims
from sitefit.functions.geom import fixed2
from sitefit.functions.rules import citation, with_resolution
from sitefit.operators.buckets import SITE, as_edges, inside, nearest
from sitefit.sources.bindings import UTILITIES

CHECKED_TYPES = tuple(dict.fromkeys(UTILITIES + tuple(r[0] for r in fx.SETBACKS)))
CHECK_COLUMNS = ("site_id", "item_id", "planting_type", "object_type", "required_m", "actual_m", "satisfied", "source_id",
                 "species_rule", "act", "clause", "citation", "table_row", "verified")


def constraint_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("object_type").isin(list(CHECKED_TYPES)))


def distances(items: DataFrame, edges: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Distance from every item to the nearest object of each type at its site; 0 inside a polygon."""
    edges = constraint_edges(edges)
    near = nearest(items, edges, item_id, "object_type")
    areas = edges.filter(F.col("geom_kind") == "polygon")
    owners = areas.select(SITE, "gid", "object_type").distinct()
    covered = (inside(items, areas, item_id).join(owners, [SITE, "gid"]).select(SITE, item_id, "object_type").distinct()
               .withColumn("covered", F.lit(True)))
    return (near.join(covered, [SITE, item_id, "object_type"], "left")
            .select(SITE, item_id, "object_type", F.when(F.col("covered"), F.lit(0.0)).otherwise(F.col("dist")).alias("actual_m")))


def with_half(items: DataFrame) -> DataFrame:
    return items.withColumn("half", F.col("side_c") / F.lit(200.0))


def setback_checks(items: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (item, object type present at the site): required against measured, with the clause."""
    rows = distances(with_half(items), edges).join(items.select(SITE, "item_id", "planting_type", "species"), [SITE, "item_id"])
    rows = with_resolution(rows)
    return rows.withColumn("satisfied", F.col("actual_m") + fx.CHECK_TOLERANCE_M >= F.col("required_m")).select(*CHECK_COLUMNS)


def crown_word(column: str):
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in fx.CROWN_LABELS], F.lit("—"))


def neighbour_checks(items: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Trees only: distance to the nearest other tree against the larger of the two crown intervals.

    With ``scope`` (site, item) only those trees are measured, against all others.
    """
    spark = items.sparkSession
    trees = items.filter(F.col("planting_type") == "tree").select(SITE, "item_id", "x", "y", "species")
    asked = trees if scope is None else trees.join(scope.select(SITE, "item_id"), [SITE, "item_id"], "left_semi")
    found = nearest(asked, as_edges(trees.withColumn("kind", F.lit("tree")), F.col("item_id").alias("other_id"), "kind"),
                    "item_id", "kind", near=12.0, target="other_id")
    spans = dims.species_interval(spark)
    source = next(r for r in fx.SOURCES if r[0] == "mgsn_1_02_02_4_2_9_2")
    own = spans.select(F.col("name").alias("species"), F.col("crown").alias("own_crown"), F.col("interval_m").alias("own_m"))
    other = spans.select(F.col("name").alias("other_species"), F.col("crown").alias("other_crown"), F.col("interval_m").alias("other_m"))
    partner = trees.select(SITE, F.col("item_id").alias("other_id"), F.col("species").alias("other_species"))
    rows = (found.join(trees.select(SITE, "item_id", "species"), [SITE, "item_id"]).join(partner, [SITE, "other_id"])
            .join(F.broadcast(own), "species", "left").join(F.broadcast(other), "other_species", "left")
            .withColumn("required_m", F.greatest("own_m", "other_m")).filter(F.col("required_m").isNotNull()))
    rule = F.concat(F.lit("крона "), crown_word("own_crown"), F.lit(" и "), crown_word("other_crown"), F.lit(" ("),
                    F.col("other_species"), F.lit(") — берётся больший интервал"))
    rows = rows.select(SITE, "item_id", F.lit("tree").alias("planting_type"), F.lit("neighbour_tree").alias("object_type"),
                       "required_m", F.col("dist").alias("actual_m"), rule.alias("species_rule"),
                       F.lit(source[0]).alias("source_id"), F.lit(source[1]).alias("act"), F.lit(source[2]).alias("clause"),
                       F.lit(source[4]).alias("verified"), F.lit(fx.NEIGHBOUR_ROW).alias("table_row"))
    rows = rows.withColumn("citation", citation(F.col("act"), F.col("clause"), F.col("verified")))
    return rows.withColumn("satisfied", F.col("actual_m") + fx.CHECK_TOLERANCE_M >= F.col("required_m")).select(*CHECK_COLUMNS)


def all_checks(items: DataFrame, edges: DataFrame) -> DataFrame:
    return setback_checks(items, edges).unionByName(neighbour_checks(items))


def verdicts(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Per item: compliant, the binding constraint (least slack among positive requirements) and the worst violation.

    Ties go to the type order of the report: object types alphabetically, the neighbour check last.
    """
    c = F.col
    order = F.struct((c("actual_m") - c("required_m")).alias("slack"), (c("object_type") == "neighbour_tree").cast("int").alias("last"),
                     c("object_type"))
    per = checks.groupBy(SITE, "item_id").agg(
        F.bool_and("satisfied").alias("compliant"),
        F.min(F.when(c("required_m") > 0, order)).alias("binding"),
        F.min(F.when(~c("satisfied"), order)).alias("worst"))
    out = items.select(SITE, "item_id", "planting_type").join(per, [SITE, "item_id"], "left")
    return out.select(SITE, "item_id", "planting_type", F.coalesce("compliant", F.lit(True)).alias("compliant"),
                      c("binding.object_type").alias("binding"), c("binding.slack").alias("binding_slack"),
                      c("worst.object_type").alias("worst"), c("worst.slack").alias("worst_slack"))


def summaries(verdict: DataFrame, checks: DataFrame) -> DataFrame:
    """The verdict sentence of every item."""
    c = F.col
    spark = verdict.sparkSession
    shown = F.when(c("compliant"), c("binding")).otherwise(c("worst"))
    rows = verdict.withColumn("object_type", shown).join(
        checks.select(SITE, "item_id", "object_type", "required_m", "actual_m", "citation", "table_row", "species_rule"),
        [SITE, "item_id", "object_type"], "left").join(F.broadcast(dims.labels(spark)), "object_type", "left")
    what = F.coalesce(*[F.when(c("planting_type") == k, v) for k, v in fx.PLANTING_LABELS])
    label = F.coalesce(c("label"), c("object_type"))
    tail = F.concat(
        F.when(c("table_row") != "", F.concat(F.lit(", строка таблицы: «"), c("table_row"), F.lit("»"))).otherwise(""),
        F.when(c("species_rule") != "", F.concat(F.lit(". Поправка по породе: "), c("species_rule"))).otherwise(""), F.lit("."))
    good = F.concat(what, F.lit(": посадка допустима, все нормативные отступы соблюдены. Определяющее ограничение — "), label,
                    F.lit(": требуется "), fixed2(c("required_m")), F.lit(" м, фактически "), fixed2(c("actual_m")),
                    F.lit(" м (запас "), fixed2(c("actual_m") - c("required_m")), F.lit(" м). Основание: "), c("citation"), tail)
    bad = F.concat(what, F.lit(": посадка НЕ допустима, нарушен отступ от "), label, F.lit(" — требуется "), fixed2(c("required_m")),
                   F.lit(" м, фактически "), fixed2(c("actual_m")), F.lit(" м. Основание: "), c("citation"), tail)
    free = F.concat(what, F.lit(": нормируемых препятствий рядом нет."))
    text = F.when(~c("compliant"), bad).when(c("binding").isNull(), free).otherwise(good)
    return rows.select(SITE, "item_id", "compliant", text.alias("summary"))


def site_summary(items: DataFrame, verdict: DataFrame, sites: DataFrame) -> DataFrame:
    """Totals per (region, site) with rollup rows, and the share of each planting type in violation."""
    c = F.col
    rows = verdict.join(sites.select(SITE, "region"), SITE)
    return rows.rollup("region", SITE).agg(
        F.count(F.lit(1)).alias("total_items"), F.sum(c("compliant").cast("long")).alias("compliant_items"),
        F.sum((~c("compliant")).cast("long")).alias("violations"),
        F.sum(((~c("compliant")) & (c("planting_type") == "tree")).cast("long")).alias("tree_violations"))


def unverified(verdict: DataFrame, checks: DataFrame) -> DataFrame:
    """How many binding constraints rest on a citation nobody compared with the act."""
    c = F.col
    rows = verdict.select(SITE, "item_id", c("binding").alias("object_type")).join(checks, [SITE, "item_id", "object_type"])
    return rows.filter(~c("verified")).groupBy(SITE, "citation").agg(F.count(F.lit(1)).alias("bindings"))


def report_sources(checks: DataFrame) -> DataFrame:
    c = F.col
    src = dims.sources(checks.sparkSession).select("source_id", "title")
    used = checks.groupBy("source_id", "act", "clause", "verified").agg(F.count(F.lit(1)).alias("checks"))
    title = F.coalesce("title", F.lit("Тип объекта не сопоставлен ни с одним пунктом"))
    return used.join(F.broadcast(src), "source_id", "left").select("source_id", "act", "clause", title.alias("title"), "verified", "checks")


def report_rows(checks: DataFrame) -> DataFrame:
    c = F.col
    return (checks.filter(c("table_row") != "").groupBy(F.concat_ws("|", "source_id", "object_type", "planting_type").alias("row_key"))
            .agg(F.min("table_row").alias("row_text")))


def report_items(checks: DataFrame) -> DataFrame:
    """One row per item with its checks as a list."""
    packed = F.struct("object_type", "required_m", "actual_m", "satisfied", "source_id")
    return checks.groupBy(SITE, "item_id").agg(F.array_sort(F.collect_list(packed)).alias("checks"))


def report_parts(verdict: DataFrame, checks: DataFrame) -> DataFrame:
    """The whole report as rows (part, site, item, key, text, compliant, binding, checks, n): items with their checks, sources by id,
    table rows by key, bindings on unverified citations, totals.
    """
    c = F.col
    items = verdict.select(SITE, "item_id", "compliant", "binding").join(report_items(checks), [SITE, "item_id"], "left")
    items = items.select(F.lit("item").alias("part"), "*", F.coalesce(F.size("checks"), F.lit(0)).cast("long").alias("n"))
    sources = report_sources(checks).select(F.lit("source").alias("part"), c("source_id").alias("key"), F.concat_ws(" / ", "act", "clause", "title").alias("text"), c("checks").alias("n"))
    rows = report_rows(checks).select(F.lit("row").alias("part"), c("row_key").alias("key"), c("row_text").alias("text"))
    open_ = unverified(verdict, checks).groupBy("citation").agg(F.sum("bindings").alias("n")).select(F.lit("unverified").alias("part"), c("citation").alias("key"), "n")
    ok = F.coalesce(F.sum(c("compliant").cast("long")), F.lit(0))
    totals = verdict.agg(F.count(F.lit(1)).alias("a"), ok.alias("b")).select(F.lit("total").alias("part"), F.inline(F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("n")) for k, v in (("total_items", c("a")), ("compliant_items", c("b")), ("violations", c("a") - c("b")))])))
    for part in (sources, rows, open_, totals):
        items = items.unionByName(part, allowMissingColumns=True)
    return items


def trace(items: DataFrame, checks: DataFrame, verdict: DataFrame) -> DataFrame:
    """One row per (placement, constraint), ready for an expert to sort and filter."""
    c = F.col
    rows = checks.drop("planting_type").join(verdict, [SITE, "item_id"]).join(items.select(SITE, "item_id", "species", "x", "y"), [SITE, "item_id"])
    return rows.select(
        SITE, "item_id", "planting_type", "species", "x", "y", c("compliant").cast("long").alias("compliant"), "object_type",
        fixed2(c("required_m")).alias("required_m"), "actual_m", c("satisfied").cast("long").alias("satisfied"),
        F.coalesce((c("object_type") == c("binding")).cast("long"), F.lit(0)).alias("is_binding"), "act", "clause",
        c("verified").cast("long").alias("verified"), "species_rule", "table_row")


def point_obstacle_radius(planting_type: str = "planting_type"):
    """Existing trunks must stay clear of the new canopy; lawns ignore them."""
    return F.coalesce(*[F.when(F.col(planting_type) == r[0], F.lit(r[2] if r[0] != "lawn" else 0.0)) for r in fx.TYPE_NORMS])


def margin_of(planting_type: str = "planting_type"):
    return F.coalesce(*[F.when(F.col(planting_type) == r[0], F.lit(r[4])) for r in fx.TYPE_NORMS])


def rejections(probes: DataFrame, edges: DataFrame, outline: DataFrame, point_id: str = "probe_id") -> DataFrame:
    """Every reason a planting cannot stand at each probe point (no row: the place is allowed).

    Five branches: distance to an object, existing trunk under the canopy, existing greenery area, outside the
    site, site margin.
    """
    c = F.col
    from sitefit.operators.buckets import inside_site, near_pairs

    keys = probes.select(SITE, point_id, "planting_type", "species")
    base = distances(probes, edges, point_id).join(keys, [SITE, point_id])
    setback = with_resolution(base).filter(c("actual_m") + fx.CHECK_TOLERANCE_M < c("required_m")).select(
        SITE, point_id, F.lit("setback").alias("kind"), "object_type", "required_m", "actual_m")
    widest = max(r[2] for r in fx.TYPE_NORMS)
    trunks = edges.filter((c("geom_kind") == "point") & (c("object_type") == "existing_greenery"))
    radius = point_obstacle_radius()
    trunk = (near_pairs(probes.select(SITE, point_id, "x", "y", "planting_type"), trunks.drop("object_type"), widest, widest)
             .groupBy(SITE, point_id, "planting_type").agg(F.min("dist").alias("actual_m")).withColumn("required_m", radius)
             .filter(c("actual_m") < c("required_m") - fx.CHECK_TOLERANCE_M)
             .select(SITE, point_id, F.lit("existing_tree").alias("kind"), F.lit("existing_greenery").alias("object_type"), "required_m", "actual_m"))
    green = edges.filter((c("geom_kind") == "polygon") & (c("object_type") == "existing_greenery"))
    none = F.lit(None).cast("double")
    area = inside(probes, green, point_id).select(SITE, point_id).distinct().select(
        SITE, point_id, F.lit("existing_object").alias("kind"), F.lit("existing_greenery").alias("object_type"), none.alias("required_m"), none.alias("actual_m"))
    within = inside_site(probes, outline, point_id)
    no_type = F.lit(None).cast("string").alias("object_type")
    outside = keys.join(within, [SITE, point_id], "left_anti").select(
        SITE, point_id, F.lit("outside_territory").alias("kind"), no_type, none.alias("required_m"), none.alias("actual_m"))
    deepest = max(r[4] for r in fx.TYPE_NORMS)
    margin = (near_pairs(probes.select(SITE, point_id, "x", "y", "planting_type"), outline.select(SITE, "x1", "y1", "x2", "y2"), deepest, deepest)
              .groupBy(SITE, point_id, "planting_type").agg(F.min("dist").alias("actual_m")).withColumn("required_m", margin_of())
              .filter(c("actual_m") < c("required_m") - fx.CHECK_TOLERANCE_M).join(within, [SITE, point_id])
              .select(SITE, point_id, F.lit("territory_margin").alias("kind"), no_type, "required_m", "actual_m"))
    return setback.unionByName(trunk).unionByName(area).unionByName(outside).unionByName(margin)


def spot_reasons(spots: DataFrame, edges: DataFrame, outline: DataFrame, point_id: str = "cell_id") -> DataFrame:
    """What forbids planting at a site: every reason with the spots (site, point, x, y, planting_type, species) it closes and the worst gap."""
    c = F.col
    rows = rejections(spots, edges, outline, point_id)
    return rows.groupBy(SITE, "kind", "object_type").agg(F.count_distinct(point_id).alias("spots"), F.max(c("required_m") - c("actual_m")).alias("worst_gap_m"))


def grid_reasons(cells: DataFrame, edges: DataFrame, outline: DataFrame, planting_type: str, step: float) -> DataFrame:
    """`spot_reasons` of the cells of `site_grid` (species unknown): what forbids a planting writes out the cells it closes.

    A cell of the grid lies in its site, so no reason is that it lies outside.
    """
    c = F.col
    from sitefit.operators.area import cells_inside, cells_near, raster, required_reach

    frames = raster(outline, step)
    norms = next(r for r in fx.TYPE_NORMS if r[0] == planting_type)
    ends = (SITE, "x1", "y1", "x2", "y2")
    why = ("kind", "object_type")
    named = lambda kind, what: (F.lit(kind).alias("kind"), (F.lit(what) if what else F.lit(None).cast("string")).alias("object_type"))
    rules = required_reach(edges, planting_type)
    near = rules.select(*ends, "required_m", F.lit("setback").alias("kind"), "object_type")
    near = near.unionByName(outline.select(*ends, F.lit(norms[4]).cast("double").alias("required_m"), *named("territory_margin", None)))
    green = c("object_type") == "existing_greenery"
    if planting_type != "lawn":
        trunks = edges.filter((c("geom_kind") == "point") & green)
        near = near.unionByName(trunks.select(*ends, F.lit(norms[2]).cast("double").alias("required_m"), *named("existing_tree", "existing_greenery")))
    close = cells_near(near, frames, c("required_m")).select(SITE, "cell_id", *why, "required_m", "dist")
    areas = rules.filter(c("geom_kind") == "polygon").select(*ends, "gid", "required_m", F.lit("setback").alias("kind"), "object_type")
    solid = edges.filter((c("geom_kind") == "polygon") & green).select(*ends, "gid", F.lit(None).cast("double").alias("required_m"), *named("existing_object", "existing_greenery"))
    held = cells_inside(areas.unionByName(solid), frames, "gid", *why, "required_m").select(SITE, "cell_id", *why, "required_m", F.lit(0.0).alias("dist"))
    worst = close.unionByName(held).groupBy(SITE, "cell_id", *why, "required_m").agg(F.min("dist").alias("actual_m"))
    limit = F.when(c("kind") == "setback", c("actual_m") + fx.CHECK_TOLERANCE_M < c("required_m")).otherwise(c("actual_m") < c("required_m") - fx.CHECK_TOLERANCE_M)
    rows = worst.filter(c("required_m").isNull() | limit).join(cells.select(SITE, "cell_id"), [SITE, "cell_id"], "left_semi")
    return rows.groupBy(SITE, *why).agg(F.count(F.lit(1)).alias("spots"), F.max(c("required_m") - c("actual_m")).alias("worst_gap_m"))


def violation_mask(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Items that stand inside the setback zone (neighbour intervals are not part of it)."""
    c = F.col
    bad = checks.filter(~c("satisfied") & (c("object_type") != "neighbour_tree")).select(SITE, "item_id").distinct().withColumn("hit", F.lit(True))
    return items.select(SITE, "item_id", "planting_type").join(bad, [SITE, "item_id"], "left").withColumn("violates", F.coalesce("hit", F.lit(False))).drop("hit")


def violation_marks(items: DataFrame, mask: DataFrame) -> DataFrame:
    """Ring centre and radius for every violating item: its canopy radius, or half a lawn's side."""
    c = F.col
    radius = F.coalesce(*[F.when(c("planting_type") == r[0], F.lit(r[2])) for r in fx.TYPE_NORMS])
    return (mask.filter("violates").select(SITE, "item_id").join(items, [SITE, "item_id"])
            .select(SITE, "item_id", "x", "y", F.when(c("planting_type") == "lawn", c("side_c") / F.lit(200.0)).otherwise(radius).alias("radius_m")))


def revalidate(items: DataFrame, touched: DataFrame, edges: DataFrame, reach: float = 8.0, was: DataFrame | None = None) -> DataFrame:
    """Re-check after edits: setbacks of the touched items, intervals of them and of trees near a touched tree.

    ``was`` are the touched items as they stood before (moved, retyped or deleted trees free their old neighbours). Only items in
    that scope are measured.
    """
    c = F.col
    from sitefit.operators.buckets import as_edges, near_pairs

    dirty = items.join(touched.select(SITE, "item_id").distinct(), [SITE, "item_id"], "left_semi")
    trees = items.filter(c("planting_type") == "tree")
    seeds = as_edges(dirty.filter(c("planting_type") == "tree"))
    if was is not None:
        seeds = seeds.unionByName(as_edges(was.filter(c("planting_type") == "tree")))
    around = near_pairs(trees.select(SITE, "item_id", "x", "y"), seeds, reach, reach).select(SITE, "item_id").distinct()
    scope = dirty.select(SITE, "item_id").unionByName(around).distinct()
    bad = setback_checks(dirty, edges).unionByName(neighbour_checks(items, scope)).groupBy(SITE, "item_id").agg(
        F.sum(((~c("satisfied")) & (c("object_type") != "neighbour_tree")).cast("long")).alias("setback_violations"),
        F.sum(((~c("satisfied")) & (c("object_type") == "neighbour_tree")).cast("long")).alias("spacing_violations"))
    return scope.join(bad, [SITE, "item_id"], "left").fillna(0, ["setback_violations", "spacing_violations"])
