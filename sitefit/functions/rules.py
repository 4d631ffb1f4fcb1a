"""Rulebook resolution: which distance applies, and which clause says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions import dims
from sitefit.functions.geom import fixed2, short


def crown_multiplier(crown_m: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1.0), crown_m / F.lit(fx.CROWN_REFERENCE_M)), F.lit(1.0))


def with_setback(df: DataFrame) -> DataFrame:
    """Adds the table distance, its source and its row; an unknown object type takes the largest known value."""
    df = df.withColumn("rule_key", dims.rule_key())
    return df.join(F.broadcast(dims.setbacks(df.sparkSession)), ["rule_key", "planting_type"], "left")


RESOLVED = ("table_m", "crown", "crown_m", "crown_multiplier", "required_m", "source_id", "table_row", "species_rule",
            "act", "clause", "citation", "verified")
PAVED = "sidewalk#paving"
_resolved: dict[str, DataFrame] = {}


def _cascade(df: DataFrame) -> DataFrame:
    """Competing corrections over (rule_key, planting_type, species): the largest wins and becomes the cited source."""
    c = F.col
    tree = c("planting_type") == "tree"
    known = c("crown_m").isNotNull()
    scaled = tree & known & c("table_source").isin(list(fx.CROWN_SCALED_SOURCES))
    df = df.withColumn("crown_multiplier", F.when(scaled, crown_multiplier(c("crown_m"))).otherwise(F.lit(1.0)))
    power = tree & (c("rule_key") == "power_line_corridor")
    radius = F.coalesce(c("crown_m"), F.lit(fx.CROWN_REFERENCE_M)) / 2.0
    crown_word = F.when(known, "радиус кроны ").otherwise("радиус опорной кроны ")
    df = df.withColumn("base_m", F.when(power, c("table_m") + radius).otherwise(c("table_m") * c("crown_multiplier")))
    df = df.withColumn("base_rule", F.when(power, F.concat(
        F.lit("до кроны "), short(c("table_m")), F.lit(" м + "), crown_word, short(radius), F.lit(" м"))).when(
        c("crown_multiplier") > 1.0, F.concat(
            F.lit("крона "), short(c("crown_m")), F.lit(" м больше "), F.lit(f"{fx.CROWN_REFERENCE_M:g}"),
            F.lit(" м — табличный отступ увеличен в "), fixed2(c("crown_multiplier")), F.lit(" раза"))).otherwise(""))

    heat = tree & (c("rule_key") == "heat_network") & (c("heat_min_m") > c("base_m"))
    shade = tree & (c("rule_key") == "building") & c("shades") & (F.lit(fx.SHADE_BUILDING_M) > c("base_m"))
    pave = tree & (c("rule_key") == PAVED)
    df = df.withColumn("case", F.when(pave, "pave").when(heat, "heat").when(shade, "shade").otherwise("base"))
    named = F.concat(F.lit("порода «"), c("name"), F.lit("»"))
    case = lambda pave, heat, shade, base: (F.when(c("case") == "pave", pave).when(c("case") == "heat", heat)
                                            .when(c("case") == "shade", shade).otherwise(base))
    return (
        df.withColumn("required_m", case(F.greatest(c("table_m"), F.lit(fx.TREE_PIT_RADIUS_M)), c("heat_min_m"), F.lit(fx.SHADE_BUILDING_M), c("base_m")))
        .withColumn("source_id", case(F.lit("ppm_743_9_8"), F.lit("mgsn_1_02_02_4_2_8"), F.lit("ppm_743_t3_6_1_note3"), c("table_source")))
        .withColumn("table_row", case(
            F.lit(fx.PAVING_ROW), F.concat(named, F.lit(" названа в перечне отступов от теплотрасс")),
            F.concat(F.lit("«деревья с широкой кроной ..., затеняющие жилые помещения, должны сажаться не ближе 10 м от здания»; "), named), c("table_text")))
        .withColumn("species_rule", case(
            F.lit(""), F.concat(F.lit("поимённый минимум для породы «"), c("name"), F.lit("»")), F.lit(fx.SHADE_RULE), c("base_rule")))
        .withColumn("crown_multiplier", F.when(c("case") == "pave", F.lit(1.0)).otherwise(c("crown_multiplier")))
    )


def citation(act: Column, clause: Column, verified: Column) -> Column:
    head = F.when((clause != "") & (clause != "—"), F.concat(act, F.lit(" — "), clause)).otherwise(act)
    return F.when(verified, head).otherwise(F.concat(head, F.lit(fx.UNVERIFIED_NOTE)))


def cite(df: DataFrame) -> DataFrame:
    """Adds act, clause, citation and verification; an object type without a clause is said to be unmapped."""
    src = dims.sources(df.sparkSession).select(
        "source_id", "act", "clause", "verified", citation(F.col("act"), F.col("clause"), F.col("verified")).alias("citation"))
    out = df.join(F.broadcast(src), "source_id", "left")
    missing = F.col("act").isNull()
    return (
        out.withColumn("source_id", F.when(missing, fx.UNMAPPED_SOURCE).otherwise(F.col("source_id")))
        .withColumn("table_row", F.when(missing, "").otherwise(F.col("table_row")))
        .withColumn("citation", F.when(missing, fx.UNMAPPED_CITATION).otherwise(F.col("citation")))
        .withColumn("clause", F.when(missing, "—").otherwise(F.col("clause")))
        .withColumn("verified", F.coalesce(F.col("verified"), F.lit(False)))
        .withColumn("act", F.coalesce(F.col("act"), F.lit(fx.UNMAPPED_ACT)))
    )


def resolution(spark) -> DataFrame:
    """The whole resolved rulebook: (rule_key, planting_type, name) -> requirement and citation.

    At most 17 object keys x 3 planting types x 15 species names, whatever the data; it is worked out once per
    application and joined by broadcast.
    """
    app = spark.sparkContext.applicationId
    if app not in _resolved:
        rows = dims.setback_rows()
        rows += [(PAVED, *r[1:]) for r in rows if r[0] == "sidewalk"]
        names = [s[0] for s in fx.SPECIES] + [""]
        table = dims.dim(spark, rows, "rule_key,planting_type,table_m,table_source,table_text")
        table = table.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
        table = table.join(F.broadcast(dims.species(spark)), "name", "left")
        columns = ("rule_key", "planting_type", "name", "raw_source") + RESOLVED
        done = cite(_cascade(table).withColumn("raw_source", F.col("source_id"))).select(*columns)
        _resolved[app] = dims.dim(spark, [tuple(r) for r in done.collect()], ",".join(columns))
    return _resolved[app]


def with_resolution(df: DataFrame, paving: Column | bool = False) -> DataFrame:
    """Adds the resolved requirement and its citation to rows of (object_type, planting_type, species)."""
    c = F.col
    spark = df.sparkSession
    key = dims.rule_key()
    if paving is not False:
        paving = F.lit(True) if paving is True else paving
        key = F.when(paving & (c("object_type") == "sidewalk") & (c("planting_type") == "tree"), PAVED).otherwise(key)
    name = F.when(c("species").isin([s[0] for s in fx.SPECIES]), c("species")).otherwise(F.lit(""))
    return (df.withColumn("rule_key", key).withColumn("name", name)
            .join(F.broadcast(resolution(spark)), ["rule_key", "planting_type", "name"], "left").drop("rule_key", "name"))


def group_pitch(density: Column) -> Column:
    """Hexagonal packing distance for a planting density."""
    return F.when(density > 0, F.sqrt(F.lit(2.0) / (F.sqrt(F.lit(3.0)) * density))).otherwise(F.lit(fx.IN_GROUP_PITCH_M))
