"""Compliance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_spatial  # noqa: F401  (distance CTEs)
from sitefit.catalog.q_rules import resolve_sql
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, dist, fmt2, lit, seg, sql
from sitefit.operators import compliance as co
from sitefit.operators.area import site_grid
from sitefit.session import stored

cte("item_rows", "SELECT d.*, i.planting_type, i.species FROM item_distances d JOIN items i USING (site_id, item_id)")
CITED = f"""coalesce(c.source_id, '{fx.UNMAPPED_SOURCE}') AS source_id, q.species_rule, coalesce(c.act, {lit(fx.UNMAPPED_ACT)}) AS act, coalesce(c.clause, '—') AS clause,
    coalesce(c.citation, {lit(fx.UNMAPPED_CITATION)}) AS citation, CASE WHEN c.source_id IS NULL THEN '' ELSE q.table_row END AS table_row, coalesce(c.verified, FALSE) AS verified"""
cte("setback_rows", f"""SELECT q.site_id, q.item_id, q.planting_type, q.object_type, q.required_m, q.actual_m, q.actual_m + 0.001e0 >= q.required_m AS satisfied, {CITED}
  FROM ({resolve_sql('item_rows', 'site_id, item_id, planting_type, species, object_type, actual_m')}) q LEFT JOIN d_cited c ON c.source_id = q.source_id""")
CROWN = "CASE {} WHEN 'wide' THEN 'широкая' WHEN 'medium' THEN 'средняя' WHEN 'narrow' THEN 'узкая' ELSE '—' END"
cte("neighbour_rows", f"""
  SELECT n.site_id, n.item_id, 'tree' AS planting_type, 'neighbour_tree' AS object_type, greatest(sa.interval_m, sb.interval_m) AS required_m, n.dist AS actual_m,
    n.dist + 0.001e0 >= greatest(sa.interval_m, sb.interval_m) AS satisfied, c.source_id,
    concat('крона ', {CROWN.format('sa.crown')}, ' и ', {CROWN.format('sb.crown')}, ' (', b.species, ') — берётся больший интервал') AS species_rule,
    c.act, c.clause, c.citation, {lit(fx.NEIGHBOUR_ROW)} AS table_row, c.verified
  FROM tree_nearest n JOIN items a ON a.site_id = n.site_id AND a.item_id = n.item_id JOIN items b ON b.site_id = n.site_id AND b.item_id = n.other_id
  LEFT JOIN d_interval sa ON sa.name = a.species LEFT JOIN d_interval sb ON sb.name = b.species
  JOIN d_cited c ON c.source_id = 'mgsn_1_02_02_4_2_9_2' WHERE greatest(sa.interval_m, sb.interval_m) IS NOT NULL""")
cte("check_rows", "SELECT * FROM setback_rows UNION ALL SELECT * FROM neighbour_rows")
ORD = "(actual_m - required_m, CASE WHEN object_type = 'neighbour_tree' THEN 1 ELSE 0 END, object_type)"
cte("verdict_rows", f"""SELECT i.site_id, i.item_id, i.planting_type, coalesce(bool_and(k.satisfied), TRUE) AS compliant,
    arg_min(k.object_type, {ORD}) FILTER (k.required_m > 0) AS binding, min(k.actual_m - k.required_m) FILTER (k.required_m > 0) AS binding_slack,
    arg_min(k.object_type, {ORD}) FILTER (NOT k.satisfied) AS worst, min(k.actual_m - k.required_m) FILTER (NOT k.satisfied) AS worst_slack
  FROM items i LEFT JOIN check_rows k USING (site_id, item_id) GROUP BY i.site_id, i.item_id, i.planting_type""")


def _checks(t):
    return stored(co.all_checks(t.items, t.edges))


@query("checks", sql("SELECT * FROM setback_rows"))
def checks(t):
    """Flagship: every placement against every object type at its site."""
    return co.setback_checks(t.items, t.edges)


@query("neighbour_checks", sql("SELECT * FROM neighbour_rows"))
def neighbour_checks(t):
    """Trees against their nearest other tree."""
    return co.neighbour_checks(t.items)


@query("binding", sql("SELECT * FROM verdict_rows"))
def binding(t):
    """Binding constraint, verdict and worst violation per placement."""
    return co.verdicts(t.items, _checks(t))


@query("summary_text", sql(f"""
  SELECT v.site_id, v.item_id, v.compliant, CASE
    WHEN NOT v.compliant THEN concat(p.plabel, ': посадка НЕ допустима, нарушен отступ от ', coalesce(l.label, k.object_type), ' — требуется ', {fmt2('k.required_m')},
      ' м, фактически ', {fmt2('k.actual_m')}, ' м. Основание: ', k.citation, CASE WHEN k.table_row <> '' THEN concat(', строка таблицы: «', k.table_row, '»') ELSE '' END,
      CASE WHEN k.species_rule <> '' THEN concat('. Поправка по породе: ', k.species_rule) ELSE '' END, '.')
    WHEN v.binding IS NULL THEN concat(p.plabel, ': нормируемых препятствий рядом нет.')
    ELSE concat(p.plabel, ': посадка допустима, все нормативные отступы соблюдены. Определяющее ограничение — ', coalesce(l.label, k.object_type), ': требуется ',
      {fmt2('k.required_m')}, ' м, фактически ', {fmt2('k.actual_m')}, ' м (запас ', {fmt2('k.actual_m - k.required_m')}, ' м). Основание: ', k.citation,
      CASE WHEN k.table_row <> '' THEN concat(', строка таблицы: «', k.table_row, '»') ELSE '' END,
      CASE WHEN k.species_rule <> '' THEN concat('. Поправка по породе: ', k.species_rule) ELSE '' END, '.') END AS summary
  FROM verdict_rows v JOIN d_plabels p USING (planting_type)
  LEFT JOIN check_rows k ON k.site_id = v.site_id AND k.item_id = v.item_id AND k.object_type = CASE WHEN v.compliant THEN v.binding ELSE v.worst END
  LEFT JOIN d_labels l ON l.object_type = k.object_type"""))
def summary_text(t):
    """The verdict sentence of every placement."""
    k = _checks(t)
    return co.summaries(co.verdicts(t.items, k), k)


@query("compliance_summary", sql("""
  SELECT s.region, v.site_id, count(*)::BIGINT AS total_items, count(*) FILTER (compliant)::BIGINT AS compliant_items,
    count(*) FILTER (NOT compliant)::BIGINT AS violations, count(*) FILTER (NOT compliant AND planting_type = 'tree')::BIGINT AS tree_violations
  FROM verdict_rows v JOIN sites s USING (site_id) GROUP BY ROLLUP (s.region, v.site_id)"""))
def compliance_summary(t):
    """Totals and violations per site, region and overall."""
    return co.site_summary(t.items, co.verdicts(t.items, _checks(t)), t.sites)


@query("unverified_sources", sql("""
  SELECT k.site_id, k.citation, count(*)::BIGINT AS bindings FROM verdict_rows v JOIN check_rows k
    ON k.site_id = v.site_id AND k.item_id = v.item_id AND k.object_type = v.binding WHERE NOT k.verified GROUP BY ALL"""))
def unverified_sources(t):
    """Bindings that rest on an unverified citation."""
    k = _checks(t)
    return co.unverified(co.verdicts(t.items, k), k)


@query("report_tables", sql("""
  SELECT 'source' AS part, s.source_id AS key, concat_ws(' / ', s.act, s.clause, s.title) AS text, s.n AS checks FROM (
    SELECT k.source_id, k.act, k.clause, coalesce(d.title, 'Тип объекта не сопоставлен ни с одним пунктом') AS title, count(*)::BIGINT AS n
    FROM check_rows k LEFT JOIN d_sources d ON d.source_id = k.source_id GROUP BY ALL) s
  UNION ALL SELECT 'row', concat_ws('|', source_id, object_type, planting_type), min(table_row), NULL FROM check_rows WHERE table_row <> '' GROUP BY ALL
  UNION ALL SELECT 'item', concat_ws(':', site_id, item_id), string_agg(object_type, ',' ORDER BY object_type), count(*)::BIGINT FROM check_rows GROUP BY site_id, item_id"""))
def report_tables(t):
    """The normalised report: sources by id, table rows by key, items with their checks."""
    k = _checks(t)
    s = co.report_sources(k).select(F.lit("source").alias("part"), F.col("source_id").alias("key"), F.concat_ws(" / ", "act", "clause", "title").alias("text"), "checks")
    r = co.report_rows(k).select(F.lit("row").alias("part"), F.col("row_key").alias("key"), F.col("row_text").alias("text"), F.lit(None).cast("long").alias("checks"))
    i = co.report_items(k).select(F.lit("item").alias("part"), F.concat_ws(":", "site_id", "item_id").alias("key"),
                                  F.array_join("checks.object_type", ",").alias("text"), F.size("checks").cast("long").alias("checks"))
    return s.unionByName(r).unionByName(i)


cte("trace_rows", f"""SELECT k.site_id, k.item_id, v.planting_type, i.species, i.x, i.y, v.compliant::BIGINT AS compliant, k.object_type, {fmt2('k.required_m')} AS required_m, k.actual_m,
    k.satisfied::BIGINT AS satisfied, coalesce((k.object_type = v.binding)::BIGINT, 0) AS is_binding, k.act, k.clause, k.verified::BIGINT AS verified, k.species_rule, k.table_row
  FROM check_rows k JOIN verdict_rows v USING (site_id, item_id) JOIN items i USING (site_id, item_id)""")


@query("trace", sql("SELECT * FROM trace_rows"))
def trace(t):
    """Flat trace: placement, norm, clause, measured distance."""
    k = _checks(t)
    return co.trace(t.items, k, co.verdicts(t.items, k))


def rejection_sql(probes: str, pid: str, distances: str) -> str:
    """Union of the five reasons over a probe CTE with planting_type and species."""
    rad = "CASE p.planting_type WHEN 'tree' THEN 2.5e0 WHEN 'shrub' THEN 1.5e0 ELSE 0e0 END"
    mar = "CASE p.planting_type WHEN 'tree' THEN 5e0 WHEN 'shrub' THEN 1.5e0 ELSE 0.5e0 END"
    rows = f"(SELECT d.*, p.planting_type, p.species FROM {distances} d JOIN {probes} p USING (site_id, {pid}))"
    return f"""
      SELECT site_id, {pid}, 'setback' AS kind, object_type, required_m, actual_m FROM ({resolve_sql(rows, f'site_id, {pid}, object_type, actual_m')}) q
        WHERE actual_m + 0.001e0 < required_m
      UNION ALL SELECT site_id, {pid}, 'existing_tree', 'existing_greenery', r, d FROM (
        SELECT p.site_id, p.{pid}, {rad} AS r, min({seg('p.x', 'p.y')}) AS d FROM {probes} p JOIN edges e USING (site_id)
        WHERE e.geom_kind = 'point' AND e.object_type = 'existing_greenery' GROUP BY ALL) z WHERE d < r - 0.001e0
      UNION ALL SELECT DISTINCT site_id, {pid}, 'existing_object', 'existing_greenery', NULL::DOUBLE, NULL::DOUBLE FROM (
        SELECT p.site_id, p.{pid}, e.gid FROM {probes} p JOIN edges e USING (site_id) WHERE e.geom_kind = 'polygon' AND e.object_type = 'existing_greenery'
        GROUP BY ALL HAVING count(*) FILTER ({cross('p.x', 'p.y')}) % 2 = 1) z
      UNION ALL SELECT site_id, {pid}, CASE WHEN ins THEN 'territory_margin' ELSE 'outside_territory' END, NULL, CASE WHEN ins THEN m END, CASE WHEN ins THEN d END FROM (
        SELECT p.site_id, p.{pid}, {mar} AS m, min({seg('p.x', 'p.y')}) AS d, count(*) FILTER ({cross('p.x', 'p.y')}) % 2 = 1 AS ins
        FROM {probes} p JOIN outline e USING (site_id) GROUP BY ALL) z WHERE NOT ins OR d < m - 0.001e0"""


cte("ref_probes", "SELECT site_id, ref_id, x, y, 'shrub' AS planting_type, 'Сирень обыкновенная' AS species FROM reference_trees")


@query("explain_rejection", sql(rejection_sql("ref_probes", "ref_id", "ref_distances")))
def explain_rejection(t):
    """All reasons why a lilac could not stand at each reference point."""
    probes = t.reference_trees.withColumn("planting_type", F.lit("shrub")).withColumn("species", F.lit("Сирень обыкновенная"))
    return co.rejections(probes, t.edges, t.outline, "ref_id")


cte("mask_rows", """SELECT i.site_id, i.item_id, i.planting_type, coalesce(k.bad, FALSE) AS violates FROM items i LEFT JOIN
    (SELECT site_id, item_id, bool_or(NOT satisfied) AS bad FROM setback_rows GROUP BY ALL) k USING (site_id, item_id)""")


@query("violation_mask", sql("SELECT * FROM mask_rows"))
def violation_mask(t):
    """Does the placement stand inside the setback zone?"""
    return co.violation_mask(t.items, co.setback_checks(t.items, t.edges))


@query("violation_marks", sql("""
  SELECT i.site_id, i.item_id, i.x, i.y, CASE WHEN i.planting_type = 'lawn' THEN i.side_c / 200e0 ELSE d.canopy_radius_m END AS radius_m
  FROM mask_rows m JOIN items i USING (site_id, item_id) JOIN d_types d ON d.planting_type = i.planting_type WHERE m.violates"""))
def violation_marks(t):
    """Ring centre and radius per violating placement."""
    return co.violation_marks(t.items, co.violation_mask(t.items, co.setback_checks(t.items, t.edges)))


cte("touched", "SELECT DISTINCT i.site_id, i.item_id FROM items i JOIN edits e USING (item_id)")
cte("scope_rows", f"""SELECT * FROM touched UNION
  SELECT a.site_id, a.item_id FROM trees a JOIN trees b ON a.site_id = b.site_id AND {dist('a.x', 'a.y', 'b.x', 'b.y')} <= 8e0
    JOIN touched t ON t.site_id = b.site_id AND t.item_id = b.item_id""")


@query("revalidate_scoped", sql("""
  SELECT s.site_id, s.item_id, coalesce(a.n, 0)::BIGINT AS setback_violations, coalesce(b.n, 0)::BIGINT AS spacing_violations FROM scope_rows s
  LEFT JOIN (SELECT site_id, item_id, count(*) AS n FROM setback_rows JOIN touched USING (site_id, item_id) WHERE NOT satisfied GROUP BY ALL) a USING (site_id, item_id)
  LEFT JOIN (SELECT site_id, item_id, count(*) AS n FROM neighbour_rows WHERE NOT satisfied GROUP BY ALL) b USING (site_id, item_id)"""))
def revalidate_scoped(t):
    """Re-check of edited placements and of the trees around them."""
    return co.revalidate(t.items, t.items.join(t.edits.select("item_id").distinct(), "item_id", "left_semi"), t.edges)
