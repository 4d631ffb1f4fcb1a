"""Scoring, learning and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_area  # noqa: F401
from sitefit.catalog.q_area import blocked_sql
from sitefit.catalog.q_rules import resolve_sql
from sitefit.catalog.q_spatial import group_distances
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, dist, lit, seg, sql
from sitefit.operators import area as ar
from sitefit.operators import measures as me
from sitefit.operators import proximity as px
from sitefit.operators import scoring as sc
from sitefit.operators import select as se
from sitefit.sources import bindings

cte("cand_room", f"""SELECT c.site_id, c.cand_id, least(5e0, coalesce(min({seg('c.x', 'c.y')} - e.required_m) FILTER ({seg('c.x', 'c.y')} <= e.required_m + 5e0), 5e0)) AS clearance_m
  FROM candidates c LEFT JOIN tree_reach e ON e.site_id = c.site_id
    AND c.x >= least(e.x1, e.x2) - e.required_m - 5.001e0 AND c.x <= greatest(e.x1, e.x2) + e.required_m + 5.001e0
    AND c.y >= least(e.y1, e.y2) - e.required_m - 5.001e0 AND c.y <= greatest(e.y1, e.y2) + e.required_m + 5.001e0 GROUP BY c.site_id, c.cand_id""")
cte("cand_gap", f"""SELECT site_id, cand_id, min(CASE WHEN odd THEN 0e0 ELSE d END) AS gap FROM (
    SELECT c.site_id, c.cand_id, e.gid, min({seg('c.x', 'c.y')}) AS d, any_value(e.geom_kind) = 'polygon' AND count(*) FILTER ({cross('c.x', 'c.y')}) % 2 = 1 AS odd
    FROM candidates c JOIN edges e USING (site_id) WHERE e.object_type = 'existing_greenery' GROUP BY ALL) q GROUP BY ALL""")
clamp = lambda e: f"greatest(0e0, least(1e0, {e}))"
cte("cand_features", f"""SELECT c.site_id, c.cand_id, c.planting_type, {clamp('r.clearance_m / 5e0')} AS extra_clearance_ratio, {clamp('t.canopy_radius_m * t.canopy_radius_m / 50e0')} AS size_score,
    1e0 AS compactness, coalesce(s.suitability, 0.5e0) AS zoning_suitability, {clamp('least(coalesce(g.gap, 30e0), 30e0) / 30e0')} AS existing_greenery_gap_score
  FROM candidates c JOIN cand_room r USING (site_id, cand_id) JOIN d_types t ON t.planting_type = c.planting_type
  LEFT JOIN cand_zoning z ON z.site_id = c.site_id AND z.cand_id = c.cand_id LEFT JOIN d_zoning s ON s.category = coalesce(z.zoning, 'unknown')
  LEFT JOIN cand_gap g ON g.site_id = c.site_id AND g.cand_id = c.cand_id""")
PARTS = [f"{n} * {w}e0" for n, w in fx.SCORE_WEIGHTS]
cte("cand_scores", f"""SELECT *, {' + '.join(PARTS)} AS score, CASE {' '.join(f"WHEN {p} >= greatest({', '.join(PARTS)}) THEN {lit(n)}" for p, (n, _) in zip(PARTS, fx.SCORE_WEIGHTS))} END AS top_factor FROM cand_features""")
HASH = "CAST(('0x' || substr(md5(concat(cand_id, ':{}')), 1, 8)) AS BIGINT) / 4294967296e0"
cte("cand_weak", f"""SELECT *, CAST(floor((score + sqrt(ln(1e0 - {HASH.format('a')}) * -2e0) * cos({HASH.format('b')} * (2e0 * pi())) * 0.08e0) * 1000000e0 + 0.5e0) / 1000000e0 >= 0.55e0 AS BIGINT) AS label FROM cand_scores""")


def _features(t):
    return sc.score_features(t.candidates, t.edges, t.features)


@query("score_features", sql("SELECT * FROM cand_features"))
def score_features(t):
    """Five placement features of every candidate."""
    return _features(t)


@query("heuristic_score", sql("SELECT site_id, cand_id, score, top_factor FROM cand_scores"))
def heuristic_score(t):
    """Weighted score with its main positive factor."""
    return sc.heuristic(_features(t)).select("site_id", "cand_id", "score", "top_factor")


@query("weak_labels", sql("SELECT site_id, count(*)::BIGINT AS n, sum(label)::BIGINT AS positives FROM cand_weak GROUP BY ALL"))
def weak_labels(t):
    """Noisy labels drawn from the heuristic score, counted per site."""
    rows = sc.weak_labels(sc.heuristic(_features(t)))
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("weak_model")
def weak_model(t):
    """Held-out accuracy of the logistic model on the weak labels (rows only)."""
    from sitefit.session import cut

    _, tested = sc.fit_weak(cut(sc.weak_labels(sc.heuristic(_features(t)))))
    return tested.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query("batch_predict")
def batch_predict(t):
    """Probability of every candidate under the weak model (rows only)."""
    from sitefit.session import cut

    labelled = cut(sc.weak_labels(sc.heuristic(_features(t))))
    model, _ = sc.fit_weak(labelled)
    return sc.predict(model, labelled)


MATRIX = ", ".join(f"min(CASE WHEN grp = {lit(g)} THEN least(dist, 60e0) ELSE 60e0 END) AS d_{g}" for g, _ in fx.DISTANCE_GROUPS)
cte("ref_matrix", f"SELECT site_id, ref_id, {MATRIX} FROM ({group_distances('reference_trees', 'ref_id')}) q GROUP BY ALL")
COUNTS = ", ".join(f"count(DISTINCT CASE WHEN grp = {lit(g)} AND (d <= {r}e0 OR odd) THEN gid END)::BIGINT AS n_{g}_{int(r)}" for g, r in fx.COUNT_FEATURES)


@query("designer_features", sql(f"""SELECT m.*, c.* EXCLUDE (site_id, ref_id), least(m.d_road + m.d_sidewalk, 60e0) AS strip_width, m.d_road - m.d_sidewalk AS kerb_minus_walk
  FROM ref_matrix m JOIN (SELECT site_id, ref_id, {COUNTS} FROM (SELECT i.site_id, i.ref_id, e.grp, e.gid, min({seg('i.x', 'i.y')}) AS d,
      any_value(e.geom_kind) = 'polygon' AND count(*) FILTER ({cross('i.x', 'i.y')}) % 2 = 1 AS odd FROM reference_trees i JOIN g_edges e USING (site_id) GROUP BY ALL) p GROUP BY ALL) c
  ON c.site_id = m.site_id AND c.ref_id = m.ref_id"""))
def designer_features(t):
    """Fourteen context features of every reference tree."""
    return _designer(t)


def _designer(t):
    c = F.col
    edges = px.grouped_edges(t.edges, t.outline)
    wide = px.distance_matrix(t.reference_trees, edges, "ref_id").join(px.counts_within(t.reference_trees, edges, "ref_id"), ["site_id", "ref_id"])
    return wide.withColumn("strip_width", F.least(c("d_road") + c("d_sidewalk"), F.lit(60.0))).withColumn("kerb_minus_walk", c("d_road") - c("d_sidewalk"))


cte("cand_labels", f"""SELECT c.*, (h.cand_id IS NOT NULL)::BIGINT AS label FROM candidates c LEFT JOIN (SELECT DISTINCT c.site_id, c.cand_id FROM candidates c JOIN reference_trees r USING (site_id)
    WHERE {dist('c.x', 'c.y', 'r.x', 'r.y')} <= 2e0) h USING (site_id, cand_id)""")
cte("cand_sets", f"""SELECT l.site_id, l.cand_id, l.label, l.score, NOT b.closed AS narrow FROM cand_labels l JOIN (
    SELECT c.site_id, c.cand_id, count(k.blocker) > 0 AS closed FROM candidates c LEFT JOIN ({blocked_sql('candidates', 'cand_id', 'tree')}) k USING (site_id, cand_id) GROUP BY ALL) b USING (site_id, cand_id)""")


@query("designer_samples", sql("SELECT site_id, count(*)::BIGINT AS wide, sum(label)::BIGINT AS wide_positive, count(*) FILTER (narrow)::BIGINT AS narrow, coalesce(sum(label) FILTER (narrow), 0)::BIGINT AS narrow_positive FROM cand_sets GROUP BY ALL"))
def designer_samples(t):
    """Sample sets for the designer model: label within 2 m of a reference tree, wide set and legal (narrow) set."""
    c = F.col
    labelled = sc.label_points(t.candidates, "cand_id", t.reference_trees)
    closed = ar.blocker_cells(t.candidates, t.edges, t.outline, "tree", "cand_id").select("site_id", "cand_id").distinct().withColumn("closed", F.lit(True))
    rows = labelled.join(closed, ["site_id", "cand_id"], "left").withColumn("narrow", c("closed").isNull())
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("wide"), F.sum("label").alias("wide_positive"), F.sum(c("narrow").cast("long")).alias("narrow"),
                                       F.sum(F.when(c("narrow"), c("label")).otherwise(0)).alias("narrow_positive"))


@query("group_weights", sql("SELECT site_id, n, (SELECT count(*) FROM candidates) / (n * count(*) OVER ()) AS weight FROM (SELECT site_id, count(*)::BIGINT AS n FROM candidates GROUP BY ALL) q"))
def group_weights(t):
    """Equal total weight per site."""
    return sc.group_weights(t.candidates)


@query("loso_models")
def loso_models(t):
    """Out-of-fold probabilities of boosted trees, one region left out at a time (rows only)."""
    c = F.col
    feats = [f"d_{g}" for g, _ in fx.DISTANCE_GROUPS] + [f"n_{g}_{int(r)}" for g, r in fx.COUNT_FEATURES] + ["strip_width", "kerb_minus_walk"]
    legal = px.legal_points(t.reference_trees, t.edges, "ref_id").select("site_id", "ref_id", c("legal").cast("double").alias("label"))
    rows = _designer(t).join(legal, ["site_id", "ref_id"]).join(sc.group_weights(t.reference_trees).drop("n"), "site_id").join(t.sites.select("site_id", "region"), "site_id")
    return sc.leave_one_out(rows, "region", feats, [r[0] for r in t.region.select("r_name").collect()])


@query("rank_metrics", sql("""SELECT site_id, p AS positives, n, CASE WHEN p > 0 AND p < n THEN (rank2 / 2e0 - p * (p + 1) / 2e0) / (p * (n - p)) END AS auc,
    CASE WHEN p > 0 THEN ap9 / 1000000000e0 / p END AS ap, CASE WHEN p > 0 THEN ap9 / 1000000000e0 / p / (p / n) END AS lift FROM (
  SELECT site_id, sum(pos)::BIGINT AS p, sum(n)::BIGINT AS n, sum(pos * (below * 2 + n + 1))::BIGINT AS rank2, sum(CAST(floor(pos * (tp / seen) * 1000000000e0) AS BIGINT))::BIGINT AS ap9 FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY site_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
      (sum(pos) OVER d)::BIGINT AS tp, (sum(n) OVER d)::BIGINT AS seen
    FROM (SELECT site_id, score, sum(label)::BIGINT AS pos, count(*)::BIGINT AS n FROM cand_labels GROUP BY ALL) g
    WINDOW d AS (PARTITION BY site_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) h GROUP BY ALL) m"""))
def rank_metrics(t):
    """AUC, average precision and lift of the candidate score against reference trees."""
    return sc.rank_metrics(sc.label_points(t.candidates, "cand_id", t.reference_trees))


@query("gate", sql("""SELECT c.site_id, c.cand_id, s.pass_share, CASE WHEN s.pass_share >= 0.01e0 AND c.score < 0.015e0 THEN -1e0 ELSE c.score END AS gated FROM candidates c
  JOIN (SELECT site_id, count(*) FILTER (score >= 0.015e0) / count(*) AS pass_share FROM candidates GROUP BY ALL) s USING (site_id)"""))
def gate(t):
    """Rejection gate on the candidate score."""
    return sc.gate(t.candidates)


PAIRS = ", ".join(f"{{'d': d_{g}, 'g': {lit(g)}}}" for g, _ in fx.DISTANCE_GROUPS)
cte("ref_near2", f"SELECT site_id, ref_id, list_slice(list_sort(list_filter([{PAIRS}], lambda s: s.d < 60e0)), 1, 2) AS two FROM ref_matrix")


@query("lift_rationale", sql("SELECT site_id, ref_id, array_to_string(list_transform(two, lambda s: s.g), ',') AS nearest_two, two[1].d AS first_m FROM ref_near2"))
def lift_rationale(t):
    """The two nearest context objects of every reference tree."""
    return sc.lift_rationale(px.distance_matrix(t.reference_trees, px.grouped_edges(t.edges, t.outline), "ref_id"), "ref_id")


cte("cand_ranked", """SELECT c.*, d.canopy_radius_m AS r, row_number() OVER (PARTITION BY site_id, c.planting_type ORDER BY score DESC, cand_id) AS rank FROM candidates c JOIN d_types d ON d.planting_type = c.planting_type""")
cte("cand_before", f"""SELECT a.site_id, a.planting_type, a.rank, a.cand_id, list(b.rank) FILTER (b.rank IS NOT NULL) AS earlier FROM cand_ranked a LEFT JOIN cand_ranked b
    ON b.site_id = a.site_id AND b.planting_type = a.planting_type AND b.rank < a.rank AND {dist('a.x', 'a.y', 'b.x', 'b.y')} < a.r + b.r - 0.000001e0 GROUP BY ALL""")
GREEDY_FOLD = """greedy_fold(site_id, planting_type, n, kept) USING KEY (site_id, planting_type) AS (
    SELECT DISTINCT site_id, planting_type, 0::BIGINT, []::BIGINT[] FROM cand_before
    UNION SELECT f.site_id, f.planting_type, f.n + 1, CASE WHEN list_has_any(f.kept, coalesce(b.earlier, []::BIGINT[])) THEN f.kept ELSE list_append(f.kept, b.rank) END
    FROM greedy_fold f JOIN cand_before b ON b.site_id = f.site_id AND b.planting_type = f.planting_type AND b.rank = f.n + 1)"""


@query("greedy_select", sql("SELECT b.site_id, b.cand_id FROM greedy_fold f JOIN cand_before b ON b.site_id = f.site_id AND b.planting_type = f.planting_type AND list_contains(f.kept, b.rank)", GREEDY_FOLD))
def greedy_select(t):
    """Greedy thinning of all candidates by score and canopy."""
    return se.greedy_select(t.candidates)


@query("density_cap", sql("""SELECT c.site_id, c.planting_type, c.cand_id, c.rank::BIGINT AS rank FROM cand_ranked c JOIN site_area a USING (site_id)
  WHERE c.rank <= greatest(1e0, round_even(CASE c.planting_type WHEN 'tree' THEN 25e0 ELSE 250e0 END * a.area_m2 / 10000e0, 0))"""))
def density_cap(t):
    """Best candidates within the density budget."""
    return se.density_cap(t.candidates, me.site_area(t.outline))


@query("row_plus_group", sql("""SELECT site_id, item_id, 'row' AS part FROM items WHERE group_id LIKE '%-row-%' UNION ALL
  SELECT site_id, item_id, 'group' FROM (SELECT *, row_number() OVER (PARTITION BY site_id, planting_type ORDER BY score DESC, item_id) AS rank FROM items WHERE group_id LIKE '%-group-%') q
  JOIN site_area a USING (site_id) WHERE rank <= greatest(1e0, round_even(CASE planting_type WHEN 'tree' THEN 25e0 ELSE 250e0 END * a.area_m2 / 10000e0, 0))"""))
def row_plus_group(t):
    """Rows are kept whole; the density budget applies to groups only."""
    rows = t.items.filter("group_id like '%-row-%'").select("site_id", "item_id", F.lit("row").alias("part"))
    groups = t.items.filter("group_id like '%-group-%'").withColumnRenamed("item_id", "cand_id")
    kept = se.density_cap(groups, me.site_area(t.outline)).select("site_id", F.col("cand_id").alias("item_id"), F.lit("group").alias("part"))
    return rows.unionByName(kept)


@query("far_enough", sql(f"""SELECT c.site_id, c.cand_id FROM candidates c WHERE c.planting_type = 'tree' AND NOT EXISTS (SELECT 1 FROM trees t LEFT JOIN d_interval s ON s.name = t.species
  WHERE t.site_id = c.site_id AND {dist('c.x', 'c.y', 't.x', 't.y')} < greatest(5e0, coalesce(s.interval_m, 0e0)) + 0.001e0)"""))
def far_enough(t):
    """Tree candidates that keep the interval to placed trees."""
    return se.far_enough(t.candidates, t.items)


cte("tree_names", "SELECT name AS species, crown_m FROM d_species WHERE species_type = 'tree'")
cte("species_reach", resolve_sql("(SELECT e.*, 'tree' AS planting_type, n.species FROM c_edges e CROSS JOIN tree_names n)", "site_id, x1, y1, x2, y2, species"))


@query("row_species", sql(f"""SELECT site_id, arg_max(species, (a, fit, species)) AS species, arg_max(fit, (a, fit, species))::BIGINT AS fit, max(a) AS crown_area FROM (
    SELECT t.site_id, n.species, t.total - coalesce(k.closed, 0) AS fit, (t.total - coalesce(k.closed, 0)) * n.crown_m * n.crown_m AS a
    FROM (SELECT site_id, count(*) AS total FROM candidates WHERE planting_type = 'tree' GROUP BY ALL) t CROSS JOIN tree_names n
    LEFT JOIN (SELECT site_id, species, count(DISTINCT cand_id) AS closed FROM (SELECT c.site_id, c.cand_id, e.species FROM candidates c JOIN species_reach e ON e.site_id = c.site_id
        AND c.x >= least(e.x1, e.x2) - e.required_m AND c.x <= greatest(e.x1, e.x2) + e.required_m AND c.y >= least(e.y1, e.y2) - e.required_m AND c.y <= greatest(e.y1, e.y2) + e.required_m
        WHERE c.planting_type = 'tree' AND {seg('c.x', 'c.y')} + 0.001e0 < e.required_m) z GROUP BY ALL) k ON k.site_id = t.site_id AND k.species = n.species) q GROUP BY ALL"""))
def row_species(t):
    """Species with the largest crown area that fits at each site."""
    return se.row_species(t.candidates, t.edges)


cte("all_named", "SELECT name AS species, species_type AS planting_type FROM d_species")


@query("diversify_species")
def diversify_species(t):
    """Interchangeable species per 60 m block (rows only; checked by a property test)."""
    return se.diversify(t.items)


@query("mark_in_paving", sql(f"""SELECT t.site_id, t.item_id, h.item_id IS NOT NULL AS in_paving FROM trees t LEFT JOIN (SELECT DISTINCT site_id, item_id FROM (
    SELECT p.site_id, p.item_id, e.gid FROM trees p JOIN (SELECT * FROM edges WHERE object_type = 'sidewalk' AND geom_kind = 'polygon') e USING (site_id) GROUP BY ALL
    HAVING count(*) FILTER ({cross('p.x', 'p.y')}) % 2 = 1) z) h USING (site_id, item_id)"""))
def mark_in_paving(t):
    """Trees that stand in sidewalk paving."""
    return se.mark_in_paving(t.items, t.edges)


@query("plan_items")
def plan_items(t):
    """A whole plan for every site (rows only; a test checks that it violates nothing)."""
    return se.plan_items(t.candidates, t.edges, t.outline, me.site_area(t.outline))
