"""Plan-level jobs: versions, statistics, recipes, evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions import dims
from sitefit.operators.buckets import SITE, as_edges, inside_site, near_pairs, nearest
from sitefit.operators.measures import crowns, scheme
from sitefit.session import cut

MATCH_TOLERANCE_M = 0.5


def match_versions(old: DataFrame, new: DataFrame, tolerance: float = MATCH_TOLERANCE_M) -> DataFrame:
    """(site, new_id, old_id) of placements that stayed.

    New items in id order take the nearest free old item of their type. Done in rounds: an item commits to its
    nearest free partner when no earlier undecided item could claim that partner.
    """
    c = F.col
    points = new.filter("planting_type <> 'lawn'").select(SITE, "planting_type", c("item_id").alias("new_id"), "x", "y")
    targets = as_edges(old.filter("planting_type <> 'lawn'"), "planting_type", c("item_id").alias("old_id"))
    links = cut(near_pairs(points, targets, tolerance, 2.0, keys=("planting_type",)).select(SITE, "new_id", "old_id", "dist"))
    done = None
    while True:
        best = links.groupBy(SITE, "new_id").agg(F.min(F.struct("dist", "old_id")).alias("b")).select(SITE, "new_id", c("b.old_id").alias("old_id"))
        first = links.groupBy(SITE, "old_id").agg(F.min("new_id").alias("new_id"))
        won = cut(best.join(first, [SITE, "old_id", "new_id"]))
        if won.isEmpty():
            break
        done = won if done is None else done.unionByName(won)
        links = cut(links.join(won.select(SITE, "new_id"), [SITE, "new_id"], "left_anti").join(won.select(SITE, "old_id"), [SITE, "old_id"], "left_anti"))
    return done if done is not None else links.select(SITE, "old_id", "new_id")


def plan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and unchanged point placements."""
    pairs = match_versions(old, new)
    point = F.col("planting_type") != "lawn"
    same = pairs.select(SITE, F.lit("unchanged").alias("change"), "new_id", "old_id")
    none = F.lit(None).cast("long")
    added = new.filter(point).select(SITE, F.col("item_id").alias("new_id")).join(pairs, [SITE, "new_id"], "left_anti").select(
        SITE, F.lit("added").alias("change"), "new_id", none.alias("old_id"))
    removed = old.filter(point).select(SITE, F.col("item_id").alias("old_id")).join(pairs, [SITE, "old_id"], "left_anti").select(
        SITE, F.lit("removed").alias("change"), none.alias("new_id"), "old_id")
    return same.unionByName(added).unionByName(removed)


DESIGNED = ("Рядовая посадка", "Групповая посадка деревьев", "Солитер")


def plan_stats(items: DataFrame) -> DataFrame:
    c = F.col
    tree = c("planting_type") == "tree"
    named = (c("planting_type") != "lawn") & (c("species") != "default")
    designed = c("rationale").contains(DESIGNED[0]) | c("rationale").contains(DESIGNED[1]) | c("rationale").contains(DESIGNED[2])
    tenth = F.round(c("crown_m") * 10).cast("long")
    side = c("side_c") if "side_c" in items.columns else F.lit(0)
    per = crowns(items).groupBy(SITE, "species").agg(
        F.sum(tree.cast("long")).alias("trees"), F.sum((c("planting_type") == "shrub").cast("long")).alias("shrubs"),
        F.sum(F.when(c("planting_type") == "lawn", side * side).otherwise(0)).alias("lawn_c"),
        F.sum(F.when(tree, tenth * tenth).otherwise(0)).alias("crown_t"), F.sum((tree & designed).cast("long")).alias("designed"),
        F.sum(named.cast("long")).alias("named"))
    total = per.groupBy(SITE).agg(
        F.sum("trees").alias("trees"), F.sum("shrubs").alias("shrubs"), (F.sum("lawn_c") / F.lit(10000.0)).alias("lawn_m2"),
        F.sum((c("named") > 0).cast("long")).alias("species_count"), (F.coalesce(F.sum("crown_t"), F.lit(0)) * F.lit(math.pi) / 400.0).alias("canopy_m2"),
        F.sum("designed").alias("designed"), F.sum("named").alias("planted"), F.max("named").alias("top"))
    return total.select(SITE, "trees", "shrubs", "lawn_m2", "species_count", "canopy_m2",
                        F.when(c("trees") > 0, c("designed") / c("trees")).alias("designed_share"),
                        F.when(c("planted") > 0, c("top") / c("planted")).alias("top_species_share"))


def similar_items(items: DataFrame, mask: DataFrame) -> DataFrame:
    """For every placement: how many share its row or group, species, crown class; and the violating and edited ones."""
    c = F.col
    rows = crowns(items).withColumn("scheme", scheme(c("rationale"))).select(
        SITE, "item_id", "planting_type", "species", "crown", "group_id", "scheme", "is_manual_edit")
    count = F.count(F.lit(1)).alias("n")
    groups = rows.filter(c("group_id").isNotNull()).groupBy(SITE, "group_id").agg(count).filter("n > 1")
    by_row = rows.filter(c("scheme").isin("row", "group", "curtain")).join(groups, [SITE, "group_id"])
    kinds = rows.filter("species <> 'default'").groupBy(SITE, "planting_type", "species").agg(count).filter("n > 1")
    by_species = rows.join(kinds, [SITE, "planting_type", "species"])
    classes = rows.filter(c("crown").isNotNull()).groupBy(SITE, "crown").agg(count).filter("n > 1")
    by_crown = rows.join(classes, [SITE, "crown"])
    bad = mask.filter("violates").groupBy(SITE).agg(count)
    manual = rows.filter("is_manual_edit").groupBy(SITE).agg(count)
    parts = [(by_row, "row"), (by_species, "species"), (by_crown, "crown"), (rows.join(bad, SITE), "violations"), (rows.join(manual, SITE), "manual")]
    out = None
    for df, key in parts:
        part = df.select(SITE, "item_id", F.lit(key).alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def estimate(plans: DataFrame, items: DataFrame, usable: DataFrame) -> DataFrame:
    """Expected count range per (request, planting type): scaled from the current plan, else from usable area."""
    c = F.col
    counts = items.groupBy(SITE, "planting_type").agg(F.count(F.lit(1)).alias("base"), (F.sum(c("side_c") * c("side_c")) / F.lit(10000.0)).alias("lawn_m2"))
    anchor = plans.filter(c("is_current") & c("materialized")).select(
        SITE, c("tree_spacing_m").alias("a_tree"), c("shrub_spacing_m").alias("a_shrub"), c("tree_rows").alias("a_rows"), c("trees_in_paving").alias("a_paving"))
    rows = (plans.withColumn("planting_type", F.explode(F.split("planting_types", ","))).join(anchor, SITE, "left")
            .join(counts, [SITE, "planting_type"], "left").join(usable.select(SITE, c("area_m2").alias("usable_m2")), SITE))
    has = c("a_rows").isNotNull() & (F.coalesce("base", F.lit(0)) > 0)
    pitch = lambda s: F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(4.0))
    double = lambda r: F.when(r >= 2, 0.71).otherwise(1.0)
    hedge = lambda s: F.coalesce(s, F.lit(fx.IN_ROW_SHRUB_PITCH_M))
    tree = F.when(has, c("base") * (F.pow(pitch(c("a_tree")) / pitch(c("tree_spacing_m")), F.lit(0.75)) * double(c("tree_rows")) / double(c("a_rows")))).otherwise(
        c("usable_m2") / F.lit(1.09 * 16.0) * F.pow(F.lit(4.0) / pitch(c("tree_spacing_m")), F.lit(0.75)) * double(c("tree_rows")))
    shrub = F.when(has, c("base") * (hedge(c("a_shrub")) / hedge(c("shrub_spacing_m")))).otherwise(c("usable_m2") * F.lit(1 / 3) / hedge(c("shrub_spacing_m")))
    lawn = F.when(has, c("lawn_m2")).otherwise(c("usable_m2") * 0.93)
    kind = c("planting_type")
    value = F.when(kind == "tree", tree).when(kind == "shrub", shrub).otherwise(lawn)
    spread = F.when(kind == "lawn", 0.08).when(~has, 0.45).when((kind == "tree") & (c("a_paving") != c("trees_in_paving")), 0.2).otherwise(0.12)
    rows = rows.withColumn("value", value).withColumn("spread", spread)
    return rows.select("plan_id", "planting_type", F.greatest(F.lit(0.0), F.rint(c("value") * (1.0 - c("spread")))).cast("long").alias("low"),
                       F.rint(c("value") * (1.0 + c("spread"))).cast("long").alias("high"), F.when(kind == "lawn", "m2").otherwise("items").alias("unit"),
                       F.when(has, "plan").otherwise("area").alias("basis"))


def plan_facts(items: DataFrame) -> DataFrame:
    """Counts by type, by type and scheme, by type and species — one pass with grouping sets."""
    c = F.col
    rows = items.withColumn("scheme", scheme(c("rationale"))).withColumn("in_paving", c("rationale").contains(fx.IN_PAVING_PREFIX))
    sets = [[c(SITE), c("planting_type")], [c(SITE), c("planting_type"), c("scheme")], [c(SITE), c("planting_type"), c("species")]]
    return rows.groupingSets(sets, SITE, "planting_type", "scheme", "species").agg(
        F.count(F.lit(1)).alias("items"), F.sum(c("is_manual_edit").cast("long")).alias("manual"), F.sum(c("in_paving").cast("long")).alias("in_paving"),
        (F.sum(c("side_c") * c("side_c")) / F.lit(10000.0)).alias("lawn_m2"))


def export_summary(verdict: DataFrame, checks: DataFrame, most: int = 5) -> DataFrame:
    """Totals per site and, per unverified citation, its count with the lowest item ids."""
    c = F.col
    total = verdict.groupBy(SITE).agg(F.count(F.lit(1)).alias("items"), F.sum((~c("compliant")).cast("long")).alias("violations"))
    rows = verdict.select(SITE, "item_id", c("binding").alias("object_type")).join(checks, [SITE, "item_id", "object_type"]).filter(~c("verified"))
    numbered = rows.select(SITE, "citation", "item_id")
    counts = numbered.groupBy(SITE, "citation").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W
    low = numbered.withColumn("r", F.row_number().over(W.partitionBy(SITE, "citation").orderBy("item_id"))).filter(c("r") <= most)
    ids = low.groupBy(SITE, "citation").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda v: v.cast("string")), ",").alias("ids"))
    return total.join(counts.join(ids, [SITE, "citation"]), SITE, "left")


def export_layers(features: DataFrame, chosen: list[str]) -> DataFrame:
    """Features of the chosen legend groups only; an empty choice is refused."""
    from sitefit.operators.measures import legend_key

    if not chosen:
        raise ValueError("no layer chosen for export")
    return features.withColumn("grp", legend_key()).filter(F.col("grp").isin(chosen)).select(SITE, "gid", "grp")


def ours_and_reference(trees: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nearest distance from each reference tree to ours and from each of ours to the reference."""
    one = F.lit("t").alias("kind")
    a = nearest(reference.select(SITE, "ref_id", "x", "y"), as_edges(trees, one), "ref_id", "kind", near=6.0)
    b = nearest(trees.select(SITE, "item_id", "x", "y"), as_edges(reference, one), "item_id", "kind", near=6.0)
    return a, b


def match_metrics(trees: DataFrame, reference: DataFrame, radius: float = 3.0) -> DataFrame:
    """Recall, precision, F1 and the median nearest distance per site."""
    c = F.col
    a, b = ours_and_reference(trees, reference)
    hit = lambda: F.sum((c("dist") <= radius).cast("long")) / F.count(F.lit(1))
    ra = a.groupBy(SITE).agg(hit().alias("recall"), (F.percentile(F.floor(c("dist") * 1e4), 0.5) / 1e4).alias("median_nn_m"))
    rb = b.groupBy(SITE).agg(hit().alias("precision"))
    f1 = F.when(c("recall") + c("precision") > 0, c("recall") * 2.0 * c("precision") / (c("recall") + c("precision"))).otherwise(0.0)
    return ra.join(rb, SITE).select(SITE, "recall", "precision", f1.alias("f1"), "median_nn_m")


def site_evaluation(items: DataFrame, reference: DataFrame, verdict: DataFrame, legal: DataFrame, outline: DataFrame, area: DataFrame) -> DataFrame:
    """Per-site quality: density, compliance, row share, legal share of the reference, metrics against legal and against all."""
    c = F.col
    trees = items.filter("planting_type = 'tree'")
    own = trees.groupBy(SITE).agg(F.count(F.lit(1)).alias("trees"), F.sum(c("rationale").contains(fx.ROW_PREFIX).cast("long")).alias("rows"))
    good = verdict.filter("planting_type = 'tree'").groupBy(SITE).agg((F.sum(c("compliant").cast("long")) / F.count(F.lit(1))).alias("compliance"))
    held = inside_site(reference, outline, "ref_id")
    near_edge = near_pairs(reference.select(SITE, "ref_id", "x", "y"), outline.select(SITE, "x1", "y1", "x2", "y2"), 1.0, 8.0).select(SITE, "ref_id")
    within = held.unionByName(near_edge).distinct()
    ref_in = reference.join(within, [SITE, "ref_id"], "left_semi")
    ref_legal = ref_in.join(legal.filter("legal"), [SITE, "ref_id"], "left_semi")
    counts = reference.groupBy(SITE).agg(F.count(F.lit(1)).alias("ref_trees")).join(
        ref_in.groupBy(SITE).agg(F.count(F.lit(1)).alias("ref_in")), SITE, "left").join(
        ref_legal.groupBy(SITE).agg(F.count(F.lit(1)).alias("ref_legal")), SITE, "left").fillna(0, ["ref_in", "ref_legal"])
    vs_legal = match_metrics(trees, ref_legal).drop("median_nn_m")
    vs_all = match_metrics(trees, ref_in).drop("median_nn_m").withColumnsRenamed({"recall": "recall_all", "precision": "precision_all", "f1": "f1_all"})
    rows = own.join(good, SITE, "left").join(counts, SITE).join(vs_legal, SITE, "left").join(vs_all, SITE, "left").join(area, SITE)
    return rows.select(SITE, "trees", (c("trees") / (c("area_m2") / 10000.0)).alias("trees_per_ha"), "compliance", (c("rows") / c("trees")).alias("row_share"),
                       "ref_trees", "ref_in", "ref_legal", F.when(c("ref_in") > 0, c("ref_legal") / c("ref_in")).alias("legal_share"),
                       F.when(c("ref_legal") > 0, c("trees") / c("ref_legal")).alias("count_ratio"), "recall", "precision", "f1", "recall_all", "precision_all", "f1_all")


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    c = F.col
    scored = evaluated.filter(c("legal_share").isNotNull())
    mean = lambda n: (F.sum(F.floor(c(n) * 1e9).cast("long")) / F.count(n) / 1e9).alias(f"mean_{n}")
    return scored.agg(F.count(F.lit(1)).alias("sites"), mean("recall"), mean("precision"), mean("f1"), mean("legal_share"), mean("f1_all"),
                      F.sum("trees").alias("trees_total"), F.min("compliance").alias("min_compliance"))


def worst_blockers(legal: DataFrame) -> DataFrame:
    return legal.filter(F.col("blocker").isNotNull()).groupBy(SITE, "blocker").agg(F.count(F.lit(1)).alias("trees"))


RECIPE = ("scoring_mode", "tree_spacing_m", "shrub_spacing_m", "tree_rows", "trees_in_paving")


def _types():
    return F.array_join(F.array_sort(F.split("planting_types", ",")), ",")


def recipe_reuse(plans: DataFrame) -> DataFrame:
    """For every request, the current unedited plan of its site with the identical recipe."""
    c = F.col
    have = plans.filter(c("is_current") & ~c("has_manual_edits")).select(
        c(SITE).alias("s"), c("plan_id").alias("reuse_id"), _types().alias("have_types"), *[c(r).alias(f"h_{r}") for r in RECIPE])
    ask = plans.withColumn("types", _types())
    same = (ask[SITE] == have["s"]) & (ask["types"] == have["have_types"])
    for r in RECIPE:
        same = same & ask[r].eqNullSafe(have[f"h_{r}"])
    return ask.join(have, same).select("plan_id", SITE, "reuse_id")


def stale_plans(plans: DataFrame) -> DataFrame:
    return plans.filter(~F.col("is_current") & F.col("materialized") & ~F.col("has_manual_edits")).select("plan_id", SITE)


def recipe_defaults(plans: DataFrame) -> DataFrame:
    """Recipe shown for a plan: the stored one, else the remembered previous one, else the site's current; with its preset."""
    c = F.col
    remembered = plans.select((c("plan_id") + 1).alias("plan_id"), c(SITE).alias("r_site"), c("tree_spacing_m").alias("r_tree"))
    current = plans.filter("is_current").select(SITE, c("tree_spacing_m").alias("c_tree"))
    rows = plans.join(remembered, "plan_id", "left").join(current, SITE, "left")
    r_tree = F.when(c("r_site") == c(SITE), c("r_tree"))
    plain = c("tree_spacing_m").isNull() & c("shrub_spacing_m").isNull()
    preset = (F.when(plain & (c("tree_rows") == 1) & ~c("trees_in_paving"), "norms").when(plain & (c("tree_rows") == 1) & c("trees_in_paving"), "dense")
              .when(plain & (c("tree_rows") == 2) & ~c("trees_in_paving"), "alley"))
    return rows.select("plan_id", F.coalesce("tree_spacing_m", r_tree, "c_tree").alias("tree_spacing_m"),
                       F.when(c("tree_spacing_m").isNotNull(), "server").when(r_tree.isNotNull(), "remembered").when(c("c_tree").isNotNull(), "current").alias("origin"),
                       preset.alias("preset"))


def plan_history(plans: DataFrame, items: DataFrame) -> DataFrame:
    """Plans of a site, newest first, with the item count of the current one."""
    from sitefit.operators.buckets import ranked

    c = F.col
    counts = items.groupBy(SITE).agg(F.count(F.lit(1)).alias("n"))
    day = -F.floor(F.unix_seconds(c("created_at").cast("timestamp")) / 86400).cast("long")
    rows = ranked(plans, [SITE], day, [c("created_at").desc(), c("plan_id")], "position")
    return rows.join(counts, SITE, "left").select(SITE, "position", "plan_id", "scoring_mode", "is_current",
                                                  F.when(c("is_current") & c("materialized"), c("n")).otherwise(F.lit(0)).cast("long").alias("items"))


def settings_delta(plans: DataFrame) -> DataFrame:
    """Recipe fields that change from one plan of a site to the next."""
    from sitefit.functions.geom import short

    c = F.col
    fields = {"planting_types": _types(), "tree_spacing_m": short(c("tree_spacing_m")), "shrub_spacing_m": short(c("shrub_spacing_m")),
              "tree_rows": c("tree_rows").cast("string"), "trees_in_paving": c("trees_in_paving").cast("string"), "scoring_mode": c("scoring_mode")}
    long = plans.select("plan_id", SITE, *[v.alias(k) for k, v in fields.items()]).unpivot(["plan_id", SITE], list(fields), "field", "after")
    prev = long.select((c("plan_id") + 1).alias("plan_id"), SITE, "field", c("after").alias("before"))
    return long.join(prev, ["plan_id", SITE, "field"]).filter(~c("after").eqNullSafe(c("before"))).select("plan_id", "field", "before", "after")


def principal_axis(items: DataFrame) -> DataFrame:
    """Main direction of each site's placements and their extent along it; sums are exact integers of centimetres."""
    c = F.col
    long = lambda e: F.sum(e.cast("decimal(38,0)")).cast("double")
    m = items.groupBy(SITE).agg(F.count(F.lit(1)).alias("n"), long(c("xc")).alias("sx"), long(c("yc")).alias("sy"),
                                long(c("xc") * c("xc")).alias("sxx"), long(c("yc") * c("yc")).alias("syy"), long(c("xc") * c("yc")).alias("sxy"))
    cxx = c("sxx") / c("n") - (c("sx") / c("n")) * (c("sx") / c("n"))
    cyy = c("syy") / c("n") - (c("sy") / c("n")) * (c("sy") / c("n"))
    cxy = c("sxy") / c("n") - (c("sx") / c("n")) * (c("sy") / c("n"))
    m = m.withColumn("angle", F.atan2(cxy * 2.0, cxx - cyy) * 0.5).withColumn("mx", c("sx") / c("n") / 100.0).withColumn("my", c("sy") / c("n") / 100.0)
    along = (c("x") - c("mx")) * F.cos("angle") + (c("y") - c("my")) * F.sin("angle")
    rows = items.join(m.select(SITE, "angle", "mx", "my"), SITE).withColumn("along", along)
    return rows.groupBy(SITE).agg(F.first("angle").alias("angle"), F.min("along").alias("low"), F.max("along").alias("high"))


def species_selection(items: DataFrame, target: str, name: str) -> DataFrame:
    from sitefit.functions.text import species_key

    q = " ".join(name.lower().replace("ё", "е").split())
    return items.filter((F.col("planting_type") == target) & species_key(F.col("species")).contains(q)).select(SITE, "item_id", "species")


def version_compare(old: DataFrame, new: DataFrame, old_bad: DataFrame, new_bad: DataFrame) -> DataFrame:
    """Two versions side by side: trees, shrubs, violations of each, and the diff counts."""
    c = F.col
    parts = None
    for df, bad, v in ((old, old_bad, "old"), (new, new_bad, "new")):
        rows = df.join(bad.filter("violates").select(SITE, "item_id", F.lit(1).alias("bad")), [SITE, "item_id"], "left").select(
            SITE, F.lit(v).alias("version"), "planting_type", "bad")
        parts = rows if parts is None else parts.unionByName(rows)
    stats = parts.groupBy(SITE).pivot("version", ["old", "new"]).agg(
        F.sum((c("planting_type") == "tree").cast("long")).alias("trees"), F.sum((c("planting_type") == "shrub").cast("long")).alias("shrubs"),
        F.count("bad").alias("violations"))
    diff = plan_diff(old, new).groupBy(SITE).pivot("change", ["added", "removed", "unchanged"]).count()
    return stats.join(diff, SITE).fillna(0)
