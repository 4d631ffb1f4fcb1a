"""Rulebook jobs over site tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions import dims
from sitefit.functions.geom import rounded
from sitefit.functions.rules import group_pitch, with_resolution
from sitefit.operators.buckets import SITE

FREE_TYPES = ("existing_greenery", "existing_lawn", "zoning")


def site_types(features: DataFrame) -> DataFrame:
    return features.filter(~F.col("object_type").isin(list(FREE_TYPES))).select(SITE, "object_type").distinct()


def types_by_planting(features: DataFrame, items: DataFrame) -> DataFrame:
    return site_types(features).join(items.select(SITE, "planting_type").distinct(), SITE)


def types_by_species(features: DataFrame, items: DataFrame) -> DataFrame:
    return site_types(features).join(items.select(SITE, "planting_type", "species").distinct(), SITE)


def requested_types(plans: DataFrame) -> DataFrame:
    return plans.withColumn("planting_type", F.explode(F.split("planting_types", ",")))


def plan_spacing(plans: DataFrame) -> DataFrame:
    c = F.col
    rows = requested_types(plans).join(F.broadcast(dims.type_norms(plans.sparkSession)), "planting_type")
    own = F.when(c("planting_type") == "tree", c("tree_spacing_m")).when(c("planting_type") == "shrub", c("shrub_spacing_m"))
    return rows.select("plan_id", "planting_type", F.coalesce(own, c("min_distance_m")).alias("min_distance_m"),
                       F.coalesce(own / 2.0, c("canopy_radius_m")).alias("canopy_radius_m"))


def species_spacing(plans: DataFrame) -> DataFrame:
    c = F.col
    named = dims.species_interval(plans.sparkSession).select(c("name").alias("species"), c("species_type").alias("planting_type"), c("interval_m").alias("crown_interval"))
    rows = requested_types(plans).join(F.broadcast(named), "planting_type")
    tree = c("planting_type") == "tree"
    interval = F.when(tree, F.greatest(c("crown_interval"), F.coalesce("tree_spacing_m", "crown_interval"))).otherwise(
        F.coalesce(c("shrub_spacing_m"), F.lit(3.0)))
    radius = F.when(tree | c("shrub_spacing_m").isNotNull(), interval / 2.0).otherwise(F.lit(1.5))
    return rows.select("plan_id", "species", "planting_type", interval.alias("interval_m"), radius.alias("canopy_radius_m"))


def margins_and_zoning(features: DataFrame) -> DataFrame:
    spark = features.sparkSession
    zones = features.filter(F.col("object_type") == "zoning").withColumn("category", F.coalesce("zoning", F.lit("unknown")))
    score = dims.dim(spark, fx.ZONING_SUITABILITY, "category,suitability")
    norms = F.array(*[F.struct(F.lit(r[0]).alias("planting_type"), F.lit(r[4]).alias("margin_m")) for r in fx.TYPE_NORMS])
    return (zones.join(F.broadcast(score), "category", "left").withColumn("n", F.explode(norms))
            .select(SITE, "gid", "category", F.coalesce("suitability", F.lit(0.5)).alias("suitability"), "n.planting_type", "n.margin_m"))


def equivalence(named: DataFrame) -> DataFrame:
    """(planting_type, species) with the key of everything the species changes in the rules."""
    c = F.col
    types = F.explode(F.array(*[F.lit(r[0]) for r in fx.SETBACKS]))
    rows = with_resolution(named.withColumn("object_type", types))
    milli = lambda v: F.floor(v * 1000.0 + 0.5).cast("long").cast("string")
    vector = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("object_type", milli(c("required_m")).alias("v")))), lambda s: s["v"]), ",")
    keys = rows.groupBy("planting_type", "species").agg(vector.alias("vector"))
    facts = dims.species_interval(named.sparkSession).join(
        F.broadcast(dims.species(named.sparkSession).select("name", "density")), "name").select(c("name").alias("species"), "interval_m", "density")
    tree, shrub = c("planting_type") == "tree", c("planting_type") == "shrub"
    key = F.concat_ws("|", "vector", F.coalesce(F.when(tree, milli(c("interval_m"))), F.lit("-")),
                      F.coalesce(F.when(shrub, milli(group_pitch(c("density")))), F.lit("-")))
    return keys.join(F.broadcast(facts), "species").select("planting_type", "species", key.alias("class_key"))


def species_classes(items: DataFrame) -> DataFrame:
    used = items.filter("planting_type <> 'lawn'").groupBy("planting_type", "species").agg(F.count(F.lit(1)).alias("items"))
    keyed = equivalence(used.select("planting_type", "species")).join(used, ["planting_type", "species"])
    size = keyed.groupBy("planting_type", "class_key").agg(F.min("species").alias("class_first"), F.count(F.lit(1)).alias("class_size"))
    return keyed.join(size, ["planting_type", "class_key"]).drop("class_key")


def species_palette(plans: DataFrame, size: int = 3) -> DataFrame:
    """The species of a type are a fixed list, ordered by draw in the row of a plan and type; a plan that comes n times has each n times."""
    c = F.col
    named = dims.species(plans.sparkSession).select(c("name").alias("species"), c("species_type").alias("planting_type"))
    named = named.groupBy("planting_type").agg(F.collect_list("species").alias("names"))
    asked = requested_types(plans).groupBy("plan_id", "planting_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(named), "planting_type")
    draw = lambda s: F.md5(F.concat_ws(":", c("plan_id").cast("string"), "planting_type", s))
    drawn = F.array_sort(F.transform("names", lambda s: F.struct(draw(s).alias("draw"), s.alias("species"))))
    first = F.slice(F.flatten(F.transform(drawn, lambda s: F.array_repeat(s["species"], F.least(c("n"), F.lit(size)).cast("int")))), 1, size)
    rows = asked.select("plan_id", "planting_type", F.posexplode(first).alias("pos", "species"))
    return rows.select("plan_id", "planting_type", "species", (c("pos") + 1).cast("long").alias("rank"))


def recipe_norms(plans: DataFrame) -> DataFrame:
    paving = plans.select("plan_id", "trees_in_paving")
    types = F.explode(F.array(*[F.lit(r[0]) for r in fx.SETBACKS]))
    rows = plan_spacing(plans).join(paving, "plan_id").withColumn("object_type", types).withColumn("species", F.lit(None).cast("string"))
    return with_resolution(rows, paving=F.col("trees_in_paving")).select(
        "plan_id", "planting_type", "object_type", "required_m", "source_id", "min_distance_m")


def palette_cycle(items: DataFrame, plans: DataFrame) -> DataFrame:
    """Palette of the site's third plan over the site's groups in id order."""
    c = F.col
    groups = items.filter(c("group_id").isNotNull()).select(SITE, "group_id", "planting_type").distinct()
    groups = groups.withColumn("idx", F.row_number().over(W.partitionBy(SITE, "planting_type").orderBy("group_id")).cast("long") - 1)
    chosen = plans.filter(c("plan_id") == c(SITE) * 600 + 2)
    listed = F.array_sort(F.collect_list(F.struct("rank", "species")))
    palette = (species_palette(chosen).join(chosen.select("plan_id", SITE), "plan_id").groupBy(SITE, "planting_type").agg(listed.alias("palette")))
    rows = groups.join(palette, [SITE, "planting_type"])
    own = F.element_at("palette", (F.pmod(c("idx"), F.size("palette")) + 1).cast("int"))["species"]
    rows = rows.withColumn("group_species", own)
    others = F.filter("palette", lambda s: s["species"] != c("group_species"))
    return rows.select(SITE, "group_id", "idx", "group_species",
                       F.coalesce(F.get(others, 0)["species"], c("group_species")).alias("scatter_species"))
