"""Rulebook resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cte, fmt2, lit, short, sql, values
from sitefit.functions import dims
from sitefit.functions.rules import with_resolution, with_setback
from sitefit.operators import rulebook as rb

cte("d_setbacks", values(dims.setback_rows(), "rule_key,planting_type,table_m,table_source,table_text"))
cte("d_sources", values(fx.SOURCES, "source_id,act,clause,title,verified"))
cte("d_species", values(fx.SPECIES, "name,species_type,crown,crown_m,heat_min_m,shades,density"))
cte("d_types", values(fx.TYPE_NORMS, "planting_type,min_distance_m,canopy_radius_m,min_area_m2,margin_m"))
cte("d_spacing", values(fx.CROWN_SPACING, "crown,interval_m"))
cte("d_labels", values(fx.OBJECT_LABELS, "object_type,label"))
cte("d_plabels", values(fx.PLANTING_LABELS, "planting_type,plabel"))
cte("d_zoning", values(fx.ZONING_SUITABILITY, "category,suitability"))
cte("d_interval", "SELECT s.*, p.interval_m FROM d_species s LEFT JOIN d_spacing p USING (crown)")
cte("d_cited", f"""SELECT source_id, act, clause, verified,
  concat(CASE WHEN clause <> '' AND clause <> '—' THEN concat(act, ' — ', clause) ELSE act END,
         CASE WHEN verified THEN '' ELSE {lit(fx.UNVERIFIED_NOTE)} END) AS citation FROM d_sources""")
KNOWN = ", ".join(lit(r[0]) for r in fx.SETBACKS)
SCALED = ", ".join(lit(s) for s in fx.CROWN_SCALED_SOURCES)


def resolve_sql(source: str, keep: str, paving: str = "FALSE") -> str:
    """Requirement resolution over rows of (object_type, planting_type, species)."""
    tree = "planting_type = 'tree'"
    mult = (f"CASE WHEN q.{tree} AND crown_m IS NOT NULL AND table_source IN ({SCALED}) "
            f"THEN greatest(1e0, crown_m / 5e0) ELSE 1e0 END")
    return f"""
      SELECT {keep}, table_m, crown, crown_m,
        CASE WHEN pave THEN 1e0 ELSE mult END AS crown_multiplier,
        CASE WHEN pave THEN greatest(table_m, 1e0) WHEN heat THEN heat_min_m WHEN shade THEN 10e0 ELSE base_m END AS required_m,
        CASE WHEN pave THEN 'ppm_743_9_8' WHEN heat THEN 'mgsn_1_02_02_4_2_8' WHEN shade THEN 'ppm_743_t3_6_1_note3'
             ELSE table_source END AS source_id,
        CASE WHEN pave THEN {lit(fx.PAVING_ROW)}
             WHEN heat THEN concat('порода «', species, '» названа в перечне отступов от теплотрасс')
             WHEN shade THEN concat('«деревья с широкой кроной ..., затеняющие жилые помещения, должны сажаться не ближе 10 м от здания»; порода «', species, '»')
             ELSE table_text END AS table_row,
        CASE WHEN pave THEN '' WHEN heat THEN concat('поимённый минимум для породы «', species, '»') WHEN shade THEN {lit(fx.SHADE_RULE)}
             WHEN power THEN concat('до кроны ', {short('table_m')}, ' м + ', CASE WHEN crown_m IS NULL THEN 'радиус опорной кроны ' ELSE 'радиус кроны ' END,
                                    {short('coalesce(crown_m, 5e0) / 2e0')}, ' м')
             WHEN mult > 1 THEN concat('крона ', {short('crown_m')}, ' м больше 5 м — табличный отступ увеличен в ', {fmt2('mult')}, ' раза')
             ELSE '' END AS species_rule
      FROM (SELECT *, power0 AS power, {tree} AND object_type = 'heat_network' AND coalesce(heat_min_m > base_m, FALSE) AS heat,
              {tree} AND object_type = 'building' AND coalesce(shades, FALSE) AND 10e0 > base_m AS shade,
              {tree} AND object_type = 'sidewalk' AND {paving} AS pave
            FROM (SELECT *, CASE WHEN power0 THEN table_m + coalesce(crown_m, 5e0) / 2e0 ELSE table_m * mult END AS base_m
                  FROM (SELECT q.*, b.table_m, b.table_source, b.table_text, s.crown, s.crown_m, s.heat_min_m, s.shades, {mult} AS mult,
                          q.{tree} AND q.object_type = 'power_line_corridor' AS power0
                        FROM {source} q
                        JOIN d_setbacks b ON b.rule_key = CASE WHEN q.object_type IN ({KNOWN}) THEN q.object_type ELSE '__other__' END
                             AND b.planting_type = q.planting_type
                        LEFT JOIN d_species s ON s.name = q.species) r0) r1) r2"""


cte("site_types", "SELECT DISTINCT site_id, object_type FROM features WHERE object_type NOT IN ('existing_greenery','existing_lawn','zoning')")
cte("species_at_types", "SELECT DISTINCT t.site_id, t.object_type, i.planting_type, i.species FROM site_types t JOIN items i USING (site_id)")


@query("norms_dim", sql("""
  SELECT f.object_type, b.planting_type, b.table_m, b.table_source AS source_id, b.table_text AS row_text, count(*)::BIGINT AS features
  FROM features f JOIN d_setbacks b ON b.rule_key = f.object_type GROUP BY ALL"""))
def norms_dim(t):
    """Rulebook dimension joined to the features it governs."""
    used = t.features.groupBy("object_type").agg(F.count(F.lit(1)).alias("features"))
    rules = dims.setbacks(t.spark).withColumnRenamed("rule_key", "object_type")
    return used.join(F.broadcast(rules), "object_type").select(
        "object_type", "planting_type", "table_m", F.col("table_source").alias("source_id"), F.col("table_text").alias("row_text"), "features")


@query("setback_for", sql(f"""
  SELECT DISTINCT t.site_id, t.object_type, i.planting_type, b.table_m AS setback_m
  FROM site_types t JOIN items i USING (site_id) JOIN d_setbacks b ON b.planting_type = i.planting_type
    AND b.rule_key = CASE WHEN t.object_type IN ({KNOWN}) THEN t.object_type ELSE '__other__' END"""))
def setback_for(t):
    """Table distance of every (object type, planting type) met at a site; unknown types fail large."""
    return with_setback(rb.types_by_planting(t.features, t.items)).select("site_id", "object_type", "planting_type", F.col("table_m").alias("setback_m"))


@query("resolve_setback", sql(resolve_sql(
    "(SELECT *, (site_id % 2 = 1) AS paving FROM species_at_types)",
    "site_id, object_type, planting_type, species", "paving").replace("table_m, crown, crown_m,", "table_m,", 1)))
def resolve_setback(t):
    """Competing corrections per species: the largest wins and is the cited source; odd sites allow trees in paving."""
    rows = rb.types_by_species(t.features, t.items)
    out = with_resolution(rows, paving=F.col("site_id") % 2 == 1)
    return out.select("site_id", "object_type", "planting_type", "species", "table_m", "crown_multiplier", "required_m",
                      F.col("raw_source").alias("source_id"), F.when(F.col("raw_source") == "", "").otherwise(F.col("table_row")).alias("table_row"), "species_rule")


@query("source_for", sql(f"""
  SELECT q.object_type, q.planting_type, q.n::BIGINT AS features, c.act, c.clause, b.table_text AS row_text, c.verified
  FROM (SELECT object_type, p.planting_type, count(*) AS n FROM features, d_types p GROUP BY ALL) q
  LEFT JOIN d_setbacks b ON b.rule_key = q.object_type AND b.planting_type = q.planting_type
  LEFT JOIN d_sources c ON c.source_id = b.table_source"""))
def source_for(t):
    """Act, clause and row behind each table distance; null where no clause is mapped."""
    used = t.features.groupBy("object_type").agg(F.count(F.lit(1)).alias("features"))
    used = used.withColumn("planting_type", F.explode(F.array(*[F.lit(p) for p in fx.PLANTING_TYPES])))
    rules = dims.setbacks(t.spark).withColumnRenamed("rule_key", "object_type").join(
        F.broadcast(dims.sources(t.spark).withColumnRenamed("source_id", "table_source")), "table_source", "left")
    return used.join(F.broadcast(rules), ["object_type", "planting_type"], "left").select(
        "object_type", "planting_type", "features", "act", "clause", F.col("table_text").alias("row_text"), "verified")


@query("spacing_for", sql("""
  SELECT p.plan_id, d.planting_type,
    CASE d.planting_type WHEN 'tree' THEN coalesce(p.tree_spacing_m, d.min_distance_m) WHEN 'shrub' THEN coalesce(p.shrub_spacing_m, d.min_distance_m)
         ELSE d.min_distance_m END AS min_distance_m,
    CASE WHEN d.planting_type = 'tree' AND p.tree_spacing_m IS NOT NULL THEN p.tree_spacing_m / 2e0
         WHEN d.planting_type = 'shrub' AND p.shrub_spacing_m IS NOT NULL THEN p.shrub_spacing_m / 2e0 ELSE d.canopy_radius_m END AS canopy_radius_m
  FROM plans p JOIN d_types d ON list_contains(string_split(p.planting_types, ','), d.planting_type)"""))
def spacing_for(t):
    """Interval and canopy radius per (plan, planting type); a user interval also sets the radius."""
    return rb.plan_spacing(t.plans)


@query("norms_for_species", sql("""
  SELECT p.plan_id, s.name AS species, s.species_type AS planting_type,
    CASE WHEN s.species_type = 'tree' THEN greatest(s.interval_m, coalesce(p.tree_spacing_m, s.interval_m))
         ELSE coalesce(p.shrub_spacing_m, 3e0) END AS interval_m,
    CASE WHEN s.species_type = 'tree' THEN greatest(s.interval_m, coalesce(p.tree_spacing_m, s.interval_m)) / 2e0
         ELSE coalesce(p.shrub_spacing_m / 2e0, 1.5e0) END AS canopy_radius_m
  FROM plans p JOIN d_interval s ON list_contains(string_split(p.planting_types, ','), s.species_type)"""))
def norms_for_species(t):
    """Interval by species: trees take the larger of the crown class and the user's interval, shrubs keep theirs."""
    return rb.species_spacing(t.plans)


@query("margin_zoning", sql("""
  SELECT f.site_id, f.gid, coalesce(f.zoning, 'unknown') AS category, coalesce(z.suitability, 0.5e0) AS suitability, d.planting_type, d.margin_m
  FROM features f CROSS JOIN d_types d LEFT JOIN d_zoning z ON z.category = f.zoning WHERE f.object_type = 'zoning'"""))
def margin_zoning(t):
    """Territory margin per planting type and zoning suitability per zoning area."""
    return rb.margins_and_zoning(t.features)


MILLI = "CAST(CAST(floor({} * 1000e0 + 0.5e0) AS BIGINT) AS VARCHAR)"
cte("named", "SELECT planting_type, species, count(*)::BIGINT AS n FROM items WHERE planting_type <> 'lawn' GROUP BY ALL")
cte("named_types", f"SELECT n.planting_type, n.species, o.object_type FROM named n CROSS JOIN ({values([(r[0],) for r in fx.SETBACKS], 'object_type')}) o")
cte("resolved_named", resolve_sql("named_types", "planting_type, species, object_type"))
cte("species_keys", f"""
  SELECT n.planting_type, n.species, n.n AS items,
    string_agg({MILLI.format('r.required_m')}, ',' ORDER BY r.object_type) || '|' ||
    coalesce(CASE WHEN n.planting_type = 'tree' THEN {MILLI.format('any_value(s.interval_m)')} END, '-') || '|' ||
    coalesce(CASE WHEN n.planting_type = 'shrub' THEN {MILLI.format('coalesce(sqrt(2e0 / (sqrt(3e0) * any_value(s.density))), 0.5e0)')} END, '-') AS class_key
  FROM named n JOIN resolved_named r USING (planting_type, species) JOIN d_interval s ON s.name = n.species GROUP BY n.planting_type, n.species, n.n""")


@query("species_classes", sql("""
  SELECT planting_type, species, items, min(species) OVER (PARTITION BY planting_type, class_key) AS class_first,
    count(*) OVER (PARTITION BY planting_type, class_key)::BIGINT AS class_size FROM species_keys"""))
def species_classes(t):
    """Species with equal requirements, interval and group pitch are interchangeable."""
    return rb.species_classes(t.items)


cte("palette", """
  SELECT plan_id, site_id, planting_type, name, rank FROM (
    SELECT p.plan_id, p.site_id, s.species_type AS planting_type, s.name,
      row_number() OVER (PARTITION BY p.plan_id, s.species_type ORDER BY md5(concat(p.plan_id, ':', s.species_type, ':', s.name))) AS rank
    FROM plans p JOIN d_species s ON list_contains(string_split(p.planting_types, ','), s.species_type)) q WHERE rank <= 3""")


@query("species_palette", sql("SELECT plan_id, planting_type, name AS species, rank::BIGINT AS rank FROM palette"))
def species_palette(t):
    """Up to three species per (plan, planting type), fixed by the plan key."""
    return rb.species_palette(t.plans)


@query("recipe_norms", sql(f"""
  SELECT plan_id, planting_type, object_type, required_m, source_id, min_distance_m FROM (
    {resolve_sql("""(SELECT p.plan_id, d.planting_type, o.rule_key AS object_type, NULL::VARCHAR AS species, p.trees_in_paving AS paving,
        CASE d.planting_type WHEN 'tree' THEN coalesce(p.tree_spacing_m, d.min_distance_m) WHEN 'shrub' THEN coalesce(p.shrub_spacing_m, d.min_distance_m)
             ELSE d.min_distance_m END AS min_distance_m
      FROM plans p JOIN d_types d ON list_contains(string_split(p.planting_types, ','), d.planting_type)
      JOIN d_setbacks o ON o.planting_type = d.planting_type WHERE o.rule_key <> '__other__')""",
      "plan_id, planting_type, object_type, min_distance_m", "paving")}) z"""))
def recipe_norms(t):
    """Effective distances and intervals of every plan, from its recipe."""
    return rb.recipe_norms(t.plans)


@query("palette_cycle", sql("""
  SELECT g.site_id, g.group_id, g.idx::BIGINT AS idx, a.name AS group_species, coalesce(b.name, a.name) AS scatter_species
  FROM (SELECT site_id, group_id, planting_type, row_number() OVER (PARTITION BY site_id, planting_type ORDER BY group_id) - 1 AS idx
        FROM (SELECT DISTINCT site_id, group_id, planting_type FROM items WHERE group_id IS NOT NULL) x) g
  JOIN (SELECT *, count(*) OVER (PARTITION BY plan_id, planting_type) AS n FROM palette) a
    ON a.plan_id = g.site_id * 600 + 2 AND a.planting_type = g.planting_type AND a.rank - 1 = g.idx % a.n
  LEFT JOIN palette b ON b.plan_id = a.plan_id AND b.planting_type = a.planting_type
    AND b.rank = (SELECT min(rank) FROM palette c WHERE c.plan_id = a.plan_id AND c.planting_type = a.planting_type AND c.name <> a.name)"""))
def palette_cycle(t):
    """The i-th group takes the i-th palette species, round robin; scatter takes the first other species."""
    return rb.palette_cycle(t.items, t.plans)
