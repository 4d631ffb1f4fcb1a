"""Plan-level queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_compliance  # noqa: F401
from sitefit.catalog.q_rules import resolve_sql
from sitefit.catalog.q_scalars import KEY, SCHEME
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, dist, lit, rnd, seg, short, sql
from sitefit.operators import compliance as co
from sitefit.operators import measures as me
from sitefit.operators import proximity as px
from sitefit.plans import versions as pv
from sitefit.session import stored

cte("version_links", f"""SELECT n.site_id, n.planting_type, n.item_id AS new_id, n.rank, list(o.item_id ORDER BY {dist('n.x', 'n.y', 'o.x', 'o.y')}, o.item_id) FILTER (o.item_id IS NOT NULL) AS olds
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id, planting_type ORDER BY item_id) AS rank FROM items_b WHERE planting_type <> 'lawn') n
  LEFT JOIN items o ON o.site_id = n.site_id AND o.planting_type = n.planting_type AND {dist('n.x', 'n.y', 'o.x', 'o.y')} <= 0.5e0 GROUP BY ALL""")
MATCH_FOLD = """match_fold(site_id, planting_type, n, taken) USING KEY (site_id, planting_type) AS (
    SELECT DISTINCT site_id, planting_type, 0::BIGINT, []::BIGINT[] FROM version_links
    UNION SELECT f.site_id, f.planting_type, f.n + 1, list_append(f.taken, list_filter(coalesce(l.olds, []::BIGINT[]), lambda o: NOT coalesce(list_contains(f.taken, o), FALSE))[1])
    FROM match_fold f JOIN version_links l ON l.site_id = f.site_id AND l.planting_type = f.planting_type AND l.rank = f.n + 1),
  matched AS (SELECT l.site_id, l.new_id, f.taken[l.rank] AS old_id FROM match_fold f JOIN version_links l USING (site_id, planting_type)),
  diff_rows AS (SELECT site_id, CASE WHEN old_id IS NULL THEN 'added' ELSE 'unchanged' END AS change, new_id, old_id FROM matched
    UNION ALL SELECT i.site_id, 'removed', NULL, i.item_id FROM items i WHERE planting_type <> 'lawn' AND NOT EXISTS (
      SELECT 1 FROM matched m WHERE m.site_id = i.site_id AND m.old_id = i.item_id))"""


@query("plan_diff", sql("SELECT * FROM diff_rows", MATCH_FOLD))
def plan_diff(t):
    """Placements added, removed and kept between two versions."""
    return pv.plan_diff(t.items, t.items_b)


STATS = f"""SELECT site_id, sum(trees)::BIGINT AS trees, sum(shrubs)::BIGINT AS shrubs, sum(lawn_c)::BIGINT / 10000e0 AS lawn_m2, count(*) FILTER (named > 0)::BIGINT AS species_count,
    coalesce(sum(crown_t), 0)::BIGINT * {math.pi!r}::DOUBLE / 400e0 AS canopy_m2, CASE WHEN sum(trees) > 0 THEN sum(designed)::BIGINT / sum(trees)::BIGINT END AS designed_share,
    CASE WHEN sum(named) > 0 THEN max(named)::BIGINT / sum(named)::BIGINT END AS top_species_share FROM (
  SELECT i.site_id, i.species, count(*) FILTER (i.planting_type = 'tree') AS trees, count(*) FILTER (i.planting_type = 'shrub') AS shrubs,
    sum(i.side_c * i.side_c) AS lawn_c, sum(CAST(round(s.crown_m * 10) AS BIGINT) * CAST(round(s.crown_m * 10) AS BIGINT)) FILTER (i.planting_type = 'tree') AS crown_t,
    count(*) FILTER (i.planting_type = 'tree' AND (contains(i.rationale, 'Рядовая посадка') OR contains(i.rationale, 'Групповая посадка деревьев') OR contains(i.rationale, 'Солитер'))) AS designed,
    count(*) FILTER (i.planting_type <> 'lawn' AND i.species <> 'default') AS named
  FROM items i LEFT JOIN d_species s ON s.name = i.species GROUP BY ALL) q GROUP BY site_id"""


@query("plan_stats", sql(STATS))
def plan_stats(t):
    """Counts, canopy, designed share and the most frequent species per site."""
    return pv.plan_stats(t.items)


cte("similar_rows", f"""SELECT i.*, {SCHEME} AS scheme, CASE WHEN i.planting_type = 'tree' THEN s.crown END AS crown, m.violates FROM items i LEFT JOIN d_species s ON s.name = i.species
  JOIN mask_rows m ON m.site_id = i.site_id AND m.item_id = i.item_id""")


@query("similar_items", sql("""SELECT site_id, item_id, key, n::BIGINT AS n FROM (
  SELECT site_id, item_id, 'row' AS key, CASE WHEN group_id IS NOT NULL AND scheme IN ('row','group','curtain') AND count(*) OVER (PARTITION BY site_id, group_id) > 1 THEN count(*) OVER (PARTITION BY site_id, group_id) END AS n FROM similar_rows
  UNION ALL SELECT site_id, item_id, 'species', CASE WHEN species <> 'default' AND count(*) OVER (PARTITION BY site_id, planting_type, species) > 1 THEN count(*) OVER (PARTITION BY site_id, planting_type, species) END FROM similar_rows
  UNION ALL SELECT site_id, item_id, 'crown', CASE WHEN crown IS NOT NULL AND count(*) OVER (PARTITION BY site_id, crown) > 1 THEN count(*) OVER (PARTITION BY site_id, crown) END FROM similar_rows
  UNION ALL SELECT site_id, item_id, 'violations', nullif(count(*) FILTER (violates) OVER (PARTITION BY site_id), 0) FROM similar_rows
  UNION ALL SELECT site_id, item_id, 'manual', nullif(count(*) FILTER (is_manual_edit) OVER (PARTITION BY site_id), 0) FROM similar_rows) q WHERE n IS NOT NULL"""))
def similar_items(t):
    """What can be selected as similar to each placement."""
    return pv.similar_items(t.items, co.violation_mask(t.items, co.setback_checks(t.items, t.edges)))


@query("estimate", sql("""
  SELECT plan_id, planting_type, CAST(greatest(0e0, round_even(value * (1e0 - spread), 0)) AS BIGINT) AS low, CAST(round_even(value * (1e0 + spread), 0) AS BIGINT) AS high,
    CASE WHEN planting_type = 'lawn' THEN 'm2' ELSE 'items' END AS unit, CASE WHEN has THEN 'plan' ELSE 'area' END AS basis
  FROM (SELECT *, CASE planting_type WHEN 'tree' THEN CASE WHEN has THEN base * (pow(greatest(coalesce(a_tree, 0e0), 4e0) / greatest(coalesce(tree_spacing_m, 0e0), 4e0), 0.75e0) * d1 / d0)
        ELSE usable / (1.09e0 * 16e0) * pow(4e0 / greatest(coalesce(tree_spacing_m, 0e0), 4e0), 0.75e0) * d1 END
      WHEN 'shrub' THEN CASE WHEN has THEN base * (coalesce(a_shrub, 0.5e0) / coalesce(shrub_spacing_m, 0.5e0)) ELSE usable * (1e0 / 3e0) / coalesce(shrub_spacing_m, 0.5e0) END
      ELSE CASE WHEN has THEN lawn_m2 ELSE usable * 0.93e0 END END AS value,
    CASE WHEN planting_type = 'lawn' THEN 0.08e0 WHEN NOT has THEN 0.45e0 WHEN planting_type = 'tree' AND a_paving <> trees_in_paving THEN 0.2e0 ELSE 0.12e0 END AS spread
  FROM (SELECT p.plan_id, d.planting_type, p.tree_spacing_m, p.shrub_spacing_m, p.trees_in_paving, a.tree_spacing_m AS a_tree, a.shrub_spacing_m AS a_shrub, a.trees_in_paving AS a_paving,
      CASE WHEN p.tree_rows >= 2 THEN 0.71e0 ELSE 1e0 END AS d1, CASE WHEN a.tree_rows >= 2 THEN 0.71e0 ELSE 1e0 END AS d0, c.base, c.lawn_m2, u.area_m2 AS usable,
      a.plan_id IS NOT NULL AND coalesce(c.base, 0) > 0 AS has
    FROM plans p JOIN d_types d ON list_contains(string_split(p.planting_types, ','), d.planting_type)
    LEFT JOIN plans a ON a.site_id = p.site_id AND a.is_current AND a.materialized
    LEFT JOIN (SELECT site_id, planting_type, count(*)::BIGINT AS base, sum(side_c * side_c)::BIGINT / 10000e0 AS lawn_m2 FROM items GROUP BY ALL) c ON c.site_id = p.site_id AND c.planting_type = d.planting_type
    JOIN site_area u ON u.site_id = p.site_id) q) r"""))
def estimate(t):
    """Expected count ranges for every requested recipe."""
    return pv.estimate(t.plans, t.items, me.site_area(t.outline))


@query("plan_facts", sql(f"""
  SELECT site_id, planting_type, scheme, species, count(*)::BIGINT AS items, count(*) FILTER (is_manual_edit)::BIGINT AS manual,
    count(*) FILTER (contains(rationale, {lit(fx.IN_PAVING_PREFIX)}))::BIGINT AS in_paving, sum(side_c * side_c)::BIGINT / 10000e0 AS lawn_m2
  FROM (SELECT *, {SCHEME} AS scheme FROM items) q GROUP BY GROUPING SETS ((site_id, planting_type), (site_id, planting_type, scheme), (site_id, planting_type, species))"""))
def plan_facts(t):
    """Counts by type, scheme and species."""
    return pv.plan_facts(t.items)


@query("export_summary", sql("""
  SELECT v.site_id, v.items, v.violations, u.citation, u.n, u.ids FROM (SELECT site_id, count(*)::BIGINT AS items, count(*) FILTER (NOT compliant)::BIGINT AS violations FROM verdict_rows GROUP BY ALL) v
  LEFT JOIN (SELECT site_id, citation, count(*)::BIGINT AS n, array_to_string(list_slice(list(item_id ORDER BY item_id), 1, 5), ',') AS ids FROM (
    SELECT k.* FROM verdict_rows v JOIN check_rows k ON k.site_id = v.site_id AND k.item_id = v.item_id AND k.object_type = v.binding WHERE NOT k.verified) z GROUP BY ALL) u USING (site_id)"""))
def export_summary(t):
    """Totals, violations and unverified citations with example ids."""
    k = stored(co.all_checks(t.items, t.edges))
    return pv.export_summary(co.verdicts(t.items, k), k)


@query("layer_export_filter", sql("SELECT site_id, gid, grp FROM legend_rows WHERE grp IN ('utility', 'road', 'building', 'zoning:public')"))
def layer_export_filter(t):
    """Only the chosen layers are exported."""
    return pv.export_layers(t.features, ["utility", "road", "building", "zoning:public"])


def metrics_sql(ref: str) -> str:
    d = dist('r.x', 'r.y', 't.x', 't.y')
    return f"""SELECT a.site_id, a.recall, b.precision, CASE WHEN a.recall + b.precision > 0 THEN a.recall * 2e0 * b.precision / (a.recall + b.precision) ELSE 0e0 END AS f1, a.median_nn_m FROM (
      SELECT site_id, count(*) FILTER (d <= 3e0) / count(*) AS recall, quantile_cont(floor(d * 10000e0), 0.5) / 10000e0 AS median_nn_m FROM (
        SELECT r.site_id, r.ref_id, min({d}) AS d FROM {ref} r JOIN trees t USING (site_id) GROUP BY ALL) q GROUP BY site_id) a
      JOIN (SELECT site_id, count(*) FILTER (d <= 3e0) / count(*) AS precision FROM (SELECT t.site_id, t.item_id, min({d}) AS d FROM trees t JOIN {ref} r USING (site_id) GROUP BY ALL) q GROUP BY site_id) b USING (site_id)"""


@query("match_metrics", sql(metrics_sql("reference_trees")))
def match_metrics(t):
    """Recall, precision, F1 and median distance against the reference trees."""
    return pv.match_metrics(t.items.filter("planting_type = 'tree'"), t.reference_trees)


cte("ref_in", f"""SELECT r.* FROM reference_trees r JOIN (SELECT p.site_id, p.ref_id FROM reference_trees p JOIN outline e USING (site_id) GROUP BY ALL
    HAVING count(*) FILTER ({cross('p.x', 'p.y')}) % 2 = 1 OR min({seg('p.x', 'p.y')}) <= 1e0) q USING (site_id, ref_id)""")
cte("ref_ok", "SELECT r.* FROM ref_in r JOIN ref_legal l USING (site_id, ref_id) WHERE l.legal")
cte("eval_rows", f"""SELECT o.site_id, o.trees, o.trees / (a.area_m2 / 10000e0) AS trees_per_ha, g.compliance, o.rows / o.trees AS row_share, c.ref_trees, c.ref_in, c.ref_legal,
    CASE WHEN c.ref_in > 0 THEN c.ref_legal / c.ref_in END AS legal_share, CASE WHEN c.ref_legal > 0 THEN o.trees / c.ref_legal END AS count_ratio,
    m.recall, m.precision, m.f1, n.recall AS recall_all, n.precision AS precision_all, n.f1 AS f1_all
  FROM (SELECT site_id, count(*)::BIGINT AS trees, count(*) FILTER (contains(rationale, {lit(fx.ROW_PREFIX)}))::BIGINT AS rows FROM trees GROUP BY ALL) o
  LEFT JOIN (SELECT site_id, count(*) FILTER (compliant) / count(*) AS compliance FROM verdict_rows WHERE planting_type = 'tree' GROUP BY ALL) g USING (site_id)
  JOIN (SELECT r.site_id, count(*)::BIGINT AS ref_trees, count(i.ref_id)::BIGINT AS ref_in, count(k.ref_id)::BIGINT AS ref_legal FROM reference_trees r
    LEFT JOIN ref_in i USING (site_id, ref_id) LEFT JOIN ref_ok k USING (site_id, ref_id) GROUP BY ALL) c USING (site_id)
  LEFT JOIN ({metrics_sql('ref_ok')}) m USING (site_id) LEFT JOIN ({metrics_sql('ref_in')}) n USING (site_id) JOIN site_area a USING (site_id)""")


def _evaluation(t):
    k = stored(co.all_checks(t.items, t.edges))
    return pv.site_evaluation(t.items, t.reference_trees, co.verdicts(t.items, k), px.legal_points(t.reference_trees, t.edges, "ref_id"), t.outline, me.site_area(t.outline))


@query("site_evaluation", sql("SELECT * FROM eval_rows"))
def site_evaluation(t):
    """Quality of every site's plan against its reference."""
    return _evaluation(t)


NANO = "sum(CAST(floor({0} * 1000000000e0) AS BIGINT))::BIGINT / count({0}) / 1000000000e0 AS mean_{0}"


@query("eval_summary", sql(f"""SELECT count(*)::BIGINT AS sites, {', '.join(NANO.format(n) for n in ('recall', 'precision', 'f1', 'legal_share', 'f1_all'))},
  sum(trees)::BIGINT AS trees_total, min(compliance) AS min_compliance FROM eval_rows WHERE legal_share IS NOT NULL"""))
def eval_summary(t):
    """Macro means over sites with a reference."""
    return pv.evaluation_summary(_evaluation(t))


@query("worst_blockers", sql("SELECT site_id, blocker, count(*)::BIGINT AS trees FROM ref_legal WHERE blocker IS NOT NULL GROUP BY ALL"))
def worst_blockers(t):
    """Which constraint blocks the reference trees most often."""
    return pv.worst_blockers(px.legal_points(t.reference_trees, t.edges, "ref_id"))


TYPES = "array_to_string(list_sort(string_split({}planting_types, ',')), ',')"


@query("recipe_reuse", sql(f"""SELECT a.plan_id, a.site_id, h.plan_id AS reuse_id FROM plans a JOIN plans h ON h.site_id = a.site_id AND h.is_current AND NOT h.has_manual_edits
  AND {TYPES.format('a.')} = {TYPES.format('h.')} AND a.scoring_mode = h.scoring_mode AND a.tree_spacing_m IS NOT DISTINCT FROM h.tree_spacing_m
  AND a.shrub_spacing_m IS NOT DISTINCT FROM h.shrub_spacing_m AND a.tree_rows = h.tree_rows AND a.trees_in_paving = h.trees_in_paving"""))
def recipe_reuse(t):
    """Requests answered by an existing plan."""
    return pv.recipe_reuse(t.plans)


@query("stale_plans", sql("SELECT plan_id, site_id FROM plans WHERE NOT is_current AND materialized AND NOT has_manual_edits"))
def stale_plans(t):
    """Plans whose items may be dropped."""
    return pv.stale_plans(t.plans)


@query("recipe_defaults", sql("""SELECT p.plan_id, coalesce(p.tree_spacing_m, r.tree_spacing_m, c.tree_spacing_m) AS tree_spacing_m,
    CASE WHEN p.tree_spacing_m IS NOT NULL THEN 'server' WHEN r.tree_spacing_m IS NOT NULL THEN 'remembered' WHEN c.tree_spacing_m IS NOT NULL THEN 'current' END AS origin,
    CASE WHEN p.tree_spacing_m IS NULL AND p.shrub_spacing_m IS NULL THEN CASE WHEN p.tree_rows = 1 AND p.trees_in_paving THEN 'dense' WHEN p.tree_rows = 1 THEN 'norms' WHEN NOT p.trees_in_paving THEN 'alley' END END AS preset
  FROM plans p LEFT JOIN plans r ON r.plan_id = p.plan_id - 1 AND r.site_id = p.site_id LEFT JOIN plans c ON c.site_id = p.site_id AND c.is_current"""))
def recipe_defaults(t):
    """Recipe fields shown for each plan and the preset they match."""
    return pv.recipe_defaults(t.plans)


@query("plan_history", sql("""SELECT p.site_id, row_number() OVER (PARTITION BY p.site_id ORDER BY p.created_at DESC, p.plan_id)::BIGINT AS position, p.plan_id, p.scoring_mode, p.is_current,
    CASE WHEN p.is_current AND p.materialized THEN coalesce(c.n, 0) ELSE 0 END::BIGINT AS items FROM plans p LEFT JOIN (SELECT site_id, count(*) AS n FROM items GROUP BY ALL) c USING (site_id)"""))
def plan_history(t):
    """Plans of a site, newest first."""
    return pv.plan_history(t.plans, t.items)


DELTA = {"planting_types": TYPES.format("{0}."), "tree_spacing_m": short("{0}.tree_spacing_m"), "shrub_spacing_m": short("{0}.shrub_spacing_m"),
         "tree_rows": "CAST({0}.tree_rows AS VARCHAR)", "trees_in_paving": "CAST({0}.trees_in_paving AS VARCHAR)", "scoring_mode": "{0}.scoring_mode"}


@query("settings_delta", sql(" UNION ALL ".join(
    f"""SELECT p.plan_id, {lit(k)} AS field, {v.format('r')} AS before, {v.format('p')} AS after FROM plans p JOIN plans r ON r.plan_id = p.plan_id - 1 AND r.site_id = p.site_id
    WHERE {v.format('r')} IS DISTINCT FROM {v.format('p')}""" for k, v in DELTA.items())))
def settings_delta(t):
    """Recipe fields that differ from the previous plan."""
    return pv.settings_delta(t.plans)


@query("principal_axis", sql(f"""SELECT i.site_id, {rnd('any_value(m.angle)', 9)} AS angle, {rnd('min((i.x - m.mx) * cos(m.angle) + (i.y - m.my) * sin(m.angle))', 6)} AS low,
    {rnd('max((i.x - m.mx) * cos(m.angle) + (i.y - m.my) * sin(m.angle))', 6)} AS high FROM items i JOIN (
    SELECT site_id, mx, my, atan2(cxy * 2e0, cxx - cyy) * 0.5e0 AS angle FROM (SELECT site_id, sx / n / 100e0 AS mx, sy / n / 100e0 AS my, sxx / n - (sx / n) * (sx / n) AS cxx,
      syy / n - (sy / n) * (sy / n) AS cyy, sxy / n - (sx / n) * (sy / n) AS cxy FROM (SELECT site_id, count(*) AS n, sum(xc)::DOUBLE AS sx, sum(yc)::DOUBLE AS sy, sum(xc * xc)::DOUBLE AS sxx,
        sum(yc * yc)::DOUBLE AS syy, sum(xc * yc)::DOUBLE AS sxy FROM items GROUP BY ALL) a) b) m USING (site_id) GROUP BY i.site_id"""))
def principal_axis(t):
    """Main axis of each site's placements."""
    from sitefit.functions.geom import rounded

    c = F.col
    return pv.principal_axis(t.items).select("site_id", rounded(c("angle"), 9).alias("angle"), rounded(c("low"), 6).alias("low"), rounded(c("high"), 6).alias("high"))


@query("species_selection", sql(f"SELECT site_id, item_id, species FROM items WHERE planting_type = 'tree' AND contains({KEY.format('species')}, 'клен')"))
def species_selection(t):
    """Placements of a target type by part of a species name."""
    return pv.species_selection(t.items, "tree", "Клён")


cte("b_bad", f"""SELECT DISTINCT site_id, item_id FROM ({resolve_sql('''(SELECT n.site_id, n.item_id, n.object_type, b.planting_type, b.species, n.d FROM (
    SELECT i.site_id, i.item_id, e.object_type, min(''' + seg('i.x', 'i.y') + ''') AS d FROM items_b i JOIN c_edges e USING (site_id) GROUP BY ALL) n JOIN items_b b USING (site_id, item_id))''',
    'site_id, item_id, object_type, d')}) q WHERE d + 0.001e0 < required_m
  UNION SELECT DISTINCT q.site_id, q.item_id FROM ({resolve_sql('''(SELECT p.site_id, p.item_id, e.object_type, any_value(p.planting_type) AS planting_type, any_value(p.species) AS species
    FROM items_b p JOIN (SELECT * FROM c_edges WHERE geom_kind = 'polygon') e USING (site_id) GROUP BY p.site_id, p.item_id, e.gid, e.object_type HAVING count(*) FILTER (''' + cross('p.x', 'p.y') + ''') % 2 = 1)''',
    'site_id, item_id, object_type')}) q WHERE required_m > 0.001e0""")


@query("version_compare", sql("""SELECT * FROM (
  SELECT site_id, coalesce(max(trees) FILTER (v = 'old'), 0)::BIGINT AS old_trees, coalesce(max(shrubs) FILTER (v = 'old'), 0)::BIGINT AS old_shrubs, coalesce(max(bad) FILTER (v = 'old'), 0)::BIGINT AS old_violations,
    coalesce(max(trees) FILTER (v = 'new'), 0)::BIGINT AS new_trees, coalesce(max(shrubs) FILTER (v = 'new'), 0)::BIGINT AS new_shrubs, coalesce(max(bad) FILTER (v = 'new'), 0)::BIGINT AS new_violations FROM (
    SELECT i.site_id, 'old' AS v, count(*) FILTER (i.planting_type = 'tree') AS trees, count(*) FILTER (i.planting_type = 'shrub') AS shrubs, count(*) FILTER (m.violates) AS bad FROM items i JOIN mask_rows m USING (site_id, item_id) GROUP BY ALL
    UNION ALL SELECT i.site_id, 'new', count(*) FILTER (i.planting_type = 'tree'), count(*) FILTER (i.planting_type = 'shrub'), count(m.item_id) FROM items_b i LEFT JOIN b_bad m USING (site_id, item_id) GROUP BY ALL) q GROUP BY ALL) a
  JOIN (SELECT site_id, count(*) FILTER (change = 'added')::BIGINT AS added, count(*) FILTER (change = 'removed')::BIGINT AS removed, count(*) FILTER (change = 'unchanged')::BIGINT AS unchanged FROM diff_rows GROUP BY ALL) d USING (site_id)""", MATCH_FOLD))
def version_compare(t):
    """Two versions side by side."""
    b = t.items_b.withColumn("side_c", F.lit(0).cast("long"))
    return pv.version_compare(t.items, t.items_b, co.violation_mask(t.items, co.setback_checks(t.items, t.edges)), co.violation_mask(b, co.setback_checks(b, t.edges)))
