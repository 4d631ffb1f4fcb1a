"""Measures and lookups of features and placements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions import dims
from sitefit.functions.text import species_key
from sitefit.operators.buckets import SITE


def species_lookup(names: DataFrame, name: str = "name") -> DataFrame:
    s = dims.species(names.sparkSession).select(F.col("name").alias("species"), "crown", species_key(F.col("name")).alias("_key"))
    return names.withColumn("_key", species_key(F.col(name))).join(F.broadcast(s), "_key", "left").drop("_key")


def _invasive_keys(spark) -> DataFrame:
    rows = [(n, r[0], r[2]) for r in fx.INVASIVE for n in (r[0], r[1])]
    return dims.dim(spark, rows, "written,listed,grp").withColumn("_key", species_key(F.col("written"))).drop("written").dropDuplicates(["_key"])


def invasive(names: DataFrame) -> DataFrame:
    return (names.withColumn("_key", species_key(F.col("name"))).join(F.broadcast(_invasive_keys(names.sparkSession)), "_key", "left")
            .select("k", "listed", "grp"))


def invasive_assortment(items: DataFrame) -> DataFrame:
    offered = items.select("planting_type", "species").distinct().withColumn("_key", species_key(F.col("species")))
    hit = offered.join(F.broadcast(_invasive_keys(items.sparkSession)), "_key", "left")
    return hit.groupBy("planting_type").agg(F.count(F.lit(1)).alias("offered"), F.count("listed").alias("listed"))


def edge_length() -> Column:
    c = F.col
    return F.sqrt((c("x2") - c("x1")) * (c("x2") - c("x1")) + (c("y2") - c("y1")) * (c("y2") - c("y1")))


def polygon_measures(edges: DataFrame) -> DataFrame:
    """Area by exact integer shoelace, perimeter in whole micrometres so that the sum does not depend on row order."""
    c = F.col
    areas = edges.filter(c("geom_kind") == "polygon")
    return areas.groupBy(SITE, "gid", "object_type").agg(
        (F.abs(F.sum(c("xc1") * c("yc2") - c("xc2") * c("yc1"))) / F.lit(20000.0)).alias("area_m2"),
        (F.sum(F.floor(edge_length() * 1e6).cast("long")) / F.lit(1e6)).alias("perimeter_m"))


def site_area(outline: DataFrame) -> DataFrame:
    c = F.col
    rings = outline.groupBy(SITE, "ring").agg(F.abs(F.sum(c("xc1") * c("yc2") - c("xc2") * c("yc1"))).alias("a"))
    return rings.groupBy(SITE).agg((F.sum(F.when(c("ring") == 0, c("a")).otherwise(-c("a"))) / F.lit(20000.0)).alias("area_m2"))


def compactness(features: DataFrame, edges: DataFrame) -> DataFrame:
    c = F.col
    shape = polygon_measures(edges).drop("object_type")
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(4.0) * F.lit(math.pi) * c("area_m2") / (c("perimeter_m") * c("perimeter_m"))))
    rows = features.filter(c("geom_kind") != "line").join(shape, [SITE, "gid"], "left")
    flat = F.coalesce(c("perimeter_m"), F.lit(0.0)) == 0
    return rows.select(SITE, "gid", F.when(c("geom_kind") == "point", 1.0).when(flat, 0.0).otherwise(value).alias("compactness"))


def local_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * 111320.0 * F.cos(F.radians(lat)), lat * 110540.0


_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_ALPHA = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16, 13 * _N ** 2 / 48 - 3 * _N ** 3 / 5, 61 * _N ** 3 / 240)
_BETA = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96, _N ** 2 / 48 + _N ** 3 / 15, 17 * _N ** 3 / 480)
_DELTA = (2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3, 7 * _N ** 2 / 3 - 8 * _N ** 3 / 5, 56 * _N ** 3 / 15)
_E = 2 * math.sqrt(_N) / (1 + _N)


def _central(zone: int) -> float:
    return zone * 6.0 - 183.0


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series (northern hemisphere)."""
    dl, sin = F.radians(lon - _central(zone)), F.sin(F.radians(lat))
    tau = F.sinh(F.atanh(sin) - F.lit(_E) * F.atanh(F.lit(_E) * sin))
    xi, eta = F.atan2(tau, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + tau * tau))
    east, north = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(xi * (2.0 * k)) * F.sinh(eta * (2.0 * k))
        north = north + F.lit(a) * F.sin(xi * (2.0 * k)) * F.cosh(eta * (2.0 * k))
    return F.lit(500000.0) + F.lit(0.9996 * _R) * east, F.lit(0.9996 * _R) * north


def from_utm(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    xi0, eta0 = north / F.lit(0.9996 * _R), (east - 500000.0) / F.lit(0.9996 * _R)
    xi, eta = xi0, eta0
    for k, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(xi0 * (2.0 * k)) * F.cosh(eta0 * (2.0 * k))
        eta = eta - F.lit(b) * F.cos(xi0 * (2.0 * k)) * F.sinh(eta0 * (2.0 * k))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, d in enumerate(_DELTA, 1):
        lat = lat + F.lit(d) * F.sin(chi * (2.0 * k))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + _central(zone), F.degrees(lat)


def is_geographic(edges: DataFrame, key: str) -> DataFrame:
    inside = (F.min("x1") >= -180) & (F.max("x2") <= 180) & (F.min("y1") >= -90) & (F.max("y2") <= 90)
    return edges.groupBy(key).agg(inside.alias("is_geographic"))


def scheme(rationale: Column) -> Column:
    prefixes = ((fx.ROW_PREFIX, "row"), (fx.TREE_GROUP_PREFIX, "group"), (fx.SOLITAIRE_PREFIX, "solitaire"), (fx.SHRUB_GROUP_PREFIX, "curtain"))
    return F.coalesce(*[F.when(rationale.contains(p), s) for p, s in prefixes], F.lit("scatter"))


def crowns(items: DataFrame) -> DataFrame:
    c = F.col
    rows = dims.with_species(items)
    return rows.withColumn("crown", F.when(c("planting_type") == "tree", c("crown"))).withColumn("crown_m", F.when(c("planting_type") != "lawn", c("crown_m")))


def legend_key() -> Column:
    c = F.col
    return (F.when(c("kind") == "utility", "utility")
            .when(c("object_type") == "zoning", F.concat(F.lit("zoning:"), F.coalesce("zoning", F.lit("unknown")))).otherwise(c("object_type")))


def legend(features: DataFrame) -> DataFrame:
    c = F.col
    spark = features.sparkSession
    rows = features.withColumn("grp", legend_key()).groupBy(SITE, "grp").agg(F.count(F.lit(1)).alias("features"))
    rows = rows.join(F.broadcast(dims.dim(spark, fx.LEGEND_LABELS, "grp,label")), "grp", "left").join(
        F.broadcast(dims.dim(spark, fx.PAINT_RANK, "grp,rank")), "grp", "left")
    rank = F.when(c("grp").startswith("zoning:"), fx.ZONING_PAINT_RANK).otherwise(F.coalesce("rank", F.lit(fx.DEFAULT_PAINT_RANK)))
    return rows.select(SITE, "grp", "features", F.coalesce("label", "grp").alias("label"), rank.cast("long").alias("rank"))


def hash01(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def to_pixels(points: DataFrame, outline: DataFrame, longest: int) -> DataFrame:
    c = F.col
    box = outline.groupBy(SITE).agg(F.min("x1").alias("x0"), F.max("x1").alias("xm"), F.min("y1").alias("y0"), F.max("y1").alias("ym"))
    scale = F.lit(float(longest)) / F.greatest(F.greatest(c("xm") - c("x0"), F.lit(1e-6)), F.greatest(c("ym") - c("y0"), F.lit(1e-6)))
    rows = points.join(box.withColumn("scale", scale), SITE)
    return rows.withColumn("px", (c("x") - c("x0")) * c("scale")).withColumn("py", (c("ym") - c("y")) * c("scale"))
