"""Scalar functions and small text rules, each over a whole table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_spatial  # noqa: F401
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cte, lit, re2, rnd, seg, short, sql, values, wide, fmt2
from sitefit.functions import dims, geom, text as tx
from sitefit.functions.rules import crown_multiplier, group_pitch
from sitefit.operators import measures as me

FOLD = "replace(lower({}), 'ё', 'е')"
NORM = r"trim(regexp_replace(" + FOLD + r", '[\s_\-$/\\.,()\[\]|]+', ' ', 'g'))"


def rx(expr: str, pattern: str) -> str:
    return f"regexp_matches({wide(expr)}, {lit(re2(pattern))})"


def classify_sql(norm: str, k: int) -> str:
    whens = " ".join(f"WHEN {rx(norm, r[0])} THEN {lit(r[k])}" for r in fx.LAYER_RULES)
    return f"CASE WHEN {norm} = '' OR {rx(norm, tx.any_of(fx.ANNOTATION_PATTERNS))} THEN NULL {whens} END"


cte("bare_layers", "SELECT *, string_split(layer, '|')[-1] AS bare FROM layer_names")
cte("norm_layers", f"SELECT *, {NORM.format('bare')} AS norm FROM bare_layers")


@query("strip_xref", sql("SELECT k, bare FROM bare_layers"))
def strip_xref(t):
    """Layer name without its external-reference prefix."""
    return t.layer_names.select("k", tx.strip_xref(F.col("layer")).alias("bare"))


@query("normalize_layer_name", sql("SELECT k, norm FROM norm_layers"))
def normalize_layer_name(t):
    """Case, ё and separators do not matter in a layer name."""
    return t.layer_names.select("k", tx.normalize_layer(tx.strip_xref(F.col("layer"))).alias("norm"))


@query("classify_layer", sql(f"SELECT k, {classify_sql('norm', 1)} AS kind, {classify_sql('norm', 2)} AS object_type FROM norm_layers"))
def classify_layer(t):
    """First matching rule after the annotation veto."""
    kind, object_type = tx.classify(tx.strip_xref(F.col("layer")))
    return t.layer_names.select("k", kind.alias("kind"), object_type.alias("object_type"))


@query("symbol_layer", sql(f"SELECT k, bare IN ({', '.join(lit(s) for s in fx.SYMBOL_LAYERS)}) OR {rx('norm', tx.any_of(fx.SYMBOL_PATTERNS))} AS is_symbol FROM norm_layers"))
def symbol_layer(t):
    """Layers whose insertion point is the object itself."""
    return t.layer_names.select("k", tx.is_symbol(tx.strip_xref(F.col("layer"))).alias("is_symbol"))


cte("d_layer_map", values(fx.LAYER_MAP, "layer_name,kind,object_type"))
cte("resolved_layers", f"""SELECT n.k, n.site_id, n.sheet, n.layer, n.bare, coalesce(m.kind, {classify_sql('norm', 1)}, 'zone') AS kind,
    coalesce(m.object_type, {classify_sql('norm', 2)}, 'unknown') AS object_type FROM norm_layers n LEFT JOIN d_layer_map m ON m.layer_name = n.bare""")


@query("resolve_layer", sql("SELECT k, kind, object_type FROM resolved_layers"))
def resolve_layer(t):
    """Exact map, then rules, then unknown."""
    kind, object_type = tx.resolve_layer(F.col("layer"))
    return t.layer_names.select("k", kind.alias("kind"), object_type.alias("object_type"))


KEY = r"trim(regexp_replace(" + FOLD + r", '\s+', ' ', 'g'))"
cte("d_species_key", f"SELECT *, {KEY.format('name')} AS key FROM d_species")
cte("d_invasive", values(fx.INVASIVE, "ru,la,grp"))


@query("species_lookup", sql(f"SELECT n.k, s.name AS species, s.crown FROM species_names n LEFT JOIN d_species_key s ON s.key = {KEY.format('n.name')}"))
def species_lookup(t):
    """Catalogue entry by full name, ignoring case, ё and spacing."""
    return me.species_lookup(t.species_names).select("k", "species", "crown")


@query("invasive_flag", sql(f"""SELECT n.k, i.ru AS listed, i.grp FROM species_names n LEFT JOIN d_invasive i
  ON {KEY.format('i.ru')} = {KEY.format('n.name')} OR {KEY.format('i.la')} = {KEY.format('n.name')}"""))
def invasive_flag(t):
    """Entry of the invasive list by Russian or Latin name."""
    return me.invasive(t.species_names)


@query("invasive_in_assortment", sql(f"""SELECT i.planting_type, count(DISTINCT i.species)::BIGINT AS offered, count(DISTINCT CASE WHEN v.ru IS NOT NULL THEN i.species END)::BIGINT AS listed
  FROM items i LEFT JOIN d_invasive v ON {KEY.format('v.ru')} = {KEY.format('i.species')} GROUP BY ALL"""))
def invasive_in_assortment(t):
    """Planted assortment names on the invasive list, per planting type."""
    return me.invasive_assortment(t.items)


@query("segment_distance", sql(f"SELECT i.site_id, i.item_id, e.gid, {seg('i.x', 'i.y')} AS dist FROM items i JOIN edges e ON e.site_id = i.site_id AND e.gid = i.item_id * 20"))
def segment_distance(t):
    """Clamped projection distance from each item to the line drawn with the same number."""
    c = F.col
    d = geom.segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
    numbered = t.items.select("site_id", "item_id", "x", "y", (c("item_id") * 20).alias("gid"))
    return numbered.join(t.edges, ["site_id", "gid"]).select("site_id", "item_id", "gid", d.alias("dist"))


cte("feature_area", """SELECT site_id, gid, object_type, abs(CAST(sum(xc1 * yc2 - xc2 * yc1) AS BIGINT)) / 20000e0 AS area_m2,
    CAST(sum(CAST(floor(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * 1000000e0) AS BIGINT)) AS BIGINT) / 1000000e0 AS perimeter_m FROM edges WHERE geom_kind = 'polygon' GROUP BY ALL""")
cte("site_area", """SELECT site_id, sum(CASE WHEN ring = 0 THEN a ELSE -a END)::BIGINT / 20000e0 AS area_m2 FROM (
    SELECT site_id, ring, abs(CAST(sum(xc1 * yc2 - xc2 * yc1) AS BIGINT)) AS a FROM outline GROUP BY ALL) r GROUP BY ALL""")


@query("ring_area", sql("SELECT site_id, gid, area_m2 FROM feature_area UNION ALL SELECT site_id, -1, area_m2 FROM site_area"))
def ring_area(t):
    """Shoelace area of every polygon and of the site outline minus its hole."""
    return me.polygon_measures(t.edges).select("site_id", "gid", "area_m2").unionByName(
        me.site_area(t.outline).select("site_id", F.lit(-1).cast("long").alias("gid"), "area_m2"))


@query("compactness", sql(f"""SELECT f.site_id, f.gid, CASE WHEN f.geom_kind = 'point' THEN 1e0 WHEN coalesce(a.perimeter_m, 0e0) = 0 THEN 0e0
    ELSE least(1e0, greatest(0e0, 4e0 * {math.pi!r}::DOUBLE * a.area_m2 / (a.perimeter_m * a.perimeter_m))) END AS compactness
  FROM features f LEFT JOIN feature_area a USING (site_id, gid) WHERE f.geom_kind <> 'line'"""))
def compactness(t):
    """4πA/P² clamped to [0, 1]; 1 for points."""
    return me.compactness(t.features, t.edges)


@query("local_project", sql(f"SELECT site_id, item_id, {rnd('(37.6e0 + x / 100000e0) * 111320e0 * cos(radians(55.75e0 + y / 100000e0))', 4)} AS mx, (55.75e0 + y / 100000e0) * 110540e0 AS my FROM items"))
def local_project(t):
    """Degrees to metres on a local plane."""
    lon, lat = 37.6 + F.col("x") / 100000.0, 55.75 + F.col("y") / 100000.0
    mx, my = me.local_metres(lon, lat)
    return t.items.select("site_id", "item_id", geom.rounded(mx, 4).alias("mx"), my.alias("my"))


def utm_sql() -> str:
    """Transverse Mercator by the series in n, for zone 37 north."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    al = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    ser_x = " + ".join(f"{v!r}::DOUBLE * cos({2 * k}e0 * xi) * sinh({2 * k}e0 * eta)" for k, v in enumerate(al, 1))
    ser_y = " + ".join(f"{v!r}::DOUBLE * sin({2 * k}e0 * xi) * cosh({2 * k}e0 * eta)" for k, v in enumerate(al, 1))
    return f"""SELECT site_id, item_id, {rnd(f'500000e0 + 0.9996e0 * {big!r}::DOUBLE * (eta + {ser_x})', 4)} AS easting, {rnd(f'0.9996e0 * {big!r}::DOUBLE * (xi + {ser_y})', 4)} AS northing
      FROM (SELECT site_id, item_id, atan2(tau, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1e0 + tau * tau)) AS eta
        FROM (SELECT site_id, item_id, radians(lon - 39e0) AS dl, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS tau
          FROM (SELECT site_id, item_id, 37.6e0 + x / 100000e0 AS lon, 55.75e0 + y / 100000e0 AS lat FROM items) p) q) r"""


@query("to_utm", sql(utm_sql()))
def to_utm(t):
    """WGS84 degrees to UTM metres in the zone of the data."""
    east, north = me.to_utm(37.6 + F.col("x") / 100000.0, 55.75 + F.col("y") / 100000.0, 37)
    return t.items.select("site_id", "item_id", geom.rounded(east, 4).alias("easting"), geom.rounded(north, 4).alias("northing"))


@query("from_utm", sql(f"""SELECT site_id, item_id, {rnd('37.6e0 + x / 100000e0', 7)} AS lon, {rnd('55.75e0 + y / 100000e0', 7)} AS lat FROM items"""))
def from_utm(t):
    """UTM metres back to degrees: the check knows the degrees that the metres were made from."""
    east, north = me.to_utm(37.6 + F.col("x") / 100000.0, 55.75 + F.col("y") / 100000.0, 37)
    rows = t.items.select("site_id", "item_id", east.alias("e"), north.alias("n"))
    lon, lat = me.from_utm(F.col("e"), F.col("n"), 37)
    return rows.select("site_id", "item_id", geom.rounded(lon, 7).alias("lon"), geom.rounded(lat, 7).alias("lat"))


@query("is_geographic", sql("SELECT object_type, min(x1) >= -180 AND max(x2) <= 180 AND min(y1) >= -90 AND max(y2) <= 90 AS is_geographic FROM edges GROUP BY ALL"))
def is_geographic(t):
    """Do the bounds of a file (here: of an object type) look like degrees?"""
    return me.is_geographic(t.edges, "object_type")


@query("crown_multiplier", sql("SELECT i.site_id, i.item_id, coalesce(greatest(1e0, s.crown_m / 5e0), 1e0) AS multiplier FROM items i LEFT JOIN d_species s ON s.name = i.species"))
def crown_multiplier_(t):
    """max(1, crown / 5 m); 1 when the crown is unknown."""
    return dims.with_species(t.items).select("site_id", "item_id", crown_multiplier(F.col("crown_m")).alias("multiplier"))


@query("group_pitch", sql("""SELECT i.site_id, i.item_id, CASE WHEN s.density > 0 THEN sqrt(2e0 / (sqrt(3e0) * s.density)) ELSE 0.5e0 END AS pitch_m
  FROM items i LEFT JOIN d_species s ON s.name = i.species WHERE i.planting_type = 'shrub'"""))
def group_pitch_(t):
    """Hexagonal packing pitch of each shrub's species."""
    return dims.with_species(t.items.filter("planting_type = 'shrub'")).select("site_id", "item_id", group_pitch(F.col("density")).alias("pitch_m"))


@query("citation", sql("""SELECT f.site_id, f.gid, c.citation FROM features f JOIN d_setbacks b ON b.rule_key = f.object_type AND b.planting_type = 'shrub' JOIN d_cited c ON c.source_id = b.table_source"""))
def citation(t):
    """Citation line of the shrub distance behind every feature."""
    from sitefit.functions.rules import with_resolution

    rows = with_resolution(t.features.withColumn("planting_type", F.lit("shrub")).withColumn("species", F.lit("")))
    return rows.filter(F.col("raw_source") != "").select("site_id", "gid", "citation")


SCHEME = f"""CASE WHEN contains(rationale, {lit(fx.ROW_PREFIX)}) THEN 'row' WHEN contains(rationale, {lit(fx.TREE_GROUP_PREFIX)}) THEN 'group'
  WHEN contains(rationale, {lit(fx.SOLITAIRE_PREFIX)}) THEN 'solitaire' WHEN contains(rationale, {lit(fx.SHRUB_GROUP_PREFIX)}) THEN 'curtain' ELSE 'scatter' END"""


@query("scheme_of", sql(f"SELECT site_id, item_id, {SCHEME} AS scheme FROM items"))
def scheme_of(t):
    """Planting scheme by rationale prefix."""
    return t.items.select("site_id", "item_id", me.scheme(F.col("rationale")).alias("scheme"))


@query("crown_of", sql("""SELECT i.site_id, i.item_id, CASE WHEN i.planting_type = 'tree' THEN s.crown END AS crown, CASE WHEN i.planting_type <> 'lawn' THEN s.crown_m END AS crown_m
  FROM items i LEFT JOIN d_species s ON s.name = i.species"""))
def crown_of(t):
    """Crown class of trees, crown diameter of trees and shrubs."""
    return me.crowns(t.items).select("site_id", "item_id", "crown", "crown_m")


cte("d_rank", values(fx.PAINT_RANK, "grp,rank"))
cte("d_legend", values(fx.LEGEND_LABELS, "grp,label"))
cte("legend_rows", "SELECT *, CASE WHEN kind = 'utility' THEN 'utility' WHEN object_type = 'zoning' THEN concat('zoning:', coalesce(zoning, 'unknown')) ELSE object_type END AS grp FROM features")


@query("legend_group", sql("""SELECT f.site_id, f.grp, count(*)::BIGINT AS features, any_value(coalesce(l.label, f.grp)) AS label,
    any_value(CASE WHEN f.grp LIKE 'zoning:%' THEN 5 ELSE coalesce(r.rank, 50) END)::BIGINT AS rank
  FROM legend_rows f LEFT JOIN d_legend l USING (grp) LEFT JOIN d_rank r USING (grp) GROUP BY f.site_id, f.grp"""))
def legend_group(t):
    """Legend groups with label, paint rank and size."""
    return me.legend(t.features)


@query("stable_hash01", sql("SELECT plan_id, CAST(('0x' || substr(md5(concat(plan_id, ':tree')), 1, 8)) AS BIGINT) / 4294967296e0 AS u FROM plans"))
def stable_hash01(t):
    """Deterministic number in [0, 1) per plan."""
    return t.plans.select("plan_id", me.hash01(F.concat(F.col("plan_id").cast("string"), F.lit(":tree"))).alias("u"))


@query("pixel_transform", sql(f"""SELECT i.site_id, i.item_id, (i.x - b.x0) * b.scale AS px, (b.y1 - i.y) * b.scale AS py FROM items i JOIN (
    SELECT site_id, x0, y1, 6000e0 / greatest(greatest(x1 - x0, 1e-6), greatest(y1 - y0, 1e-6)) AS scale FROM (
      SELECT site_id, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM outline GROUP BY ALL) q) b USING (site_id)"""))
def pixel_transform(t):
    """World to pixel: y flipped, the longer side is 6000 px."""
    return me.to_pixels(t.items, t.outline, 6000).select("site_id", "item_id", "px", "py")
