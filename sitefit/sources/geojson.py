"""Real GeoJSON: files of collections or of one feature a line, geometries of every kind and depth, damaged files reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.operators.buckets import measured
from sitefit.operators.measures import to_utm

FEATURE = "type string, properties variant, geometry variant"
#: How deep a kind's positions lie in its coordinates.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def read_files(spark: SparkSession, paths: str | list[str], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Features (file, ord, properties, geometry) of all files, and a report (file, features, damaged) by file.

    A file is one FeatureCollection or Feature, or with ``lines`` a Feature a line. What is no JSON is kept as the damage of its
    file and stops nothing else. ``ord`` counts features within a file (with ``lines`` it is null: lines have no order of their own).
    """
    c = F.col
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damage").option("multiLine", not lines)
    schema = f"{FEATURE}, damage string" if lines else f"{FEATURE}, features array<struct<type:string,properties:variant,geometry:variant>>, damage string"
    raw = reader.schema(schema).json(paths).select("*", F.col("_metadata.file_path").alias("file"))
    whole = F.struct("type", "properties", "geometry")
    listed = F.when(c("type") == "Feature", F.array(whole))
    if not lines:
        listed = listed.otherwise(F.coalesce("features", F.array().cast(f"array<struct<{FEATURE}>>")))
    rows = raw.select("file", F.posexplode(listed).alias("ord", "f"))
    features = rows.select("file", (F.lit(None) if lines else c("ord")).cast("long").alias("ord"), "f.properties", "f.geometry")
    given = F.size(F.coalesce("features", F.array())) if not lines else F.lit(0)
    report = raw.groupBy("file").agg(F.sum(F.when(c("type") == "Feature", 1).otherwise(F.greatest(given, F.lit(0)))).alias("features"), F.count("damage").alias("damaged"))
    return features, report


def from_texts(texts: DataFrame) -> DataFrame:
    """Features of a column ``feature`` of GeoJSON texts; the other columns stay, a text that is no JSON has no geometry."""
    rows = texts.withColumn("_f", F.from_json("feature", FEATURE))
    return rows.select(*[n for n in texts.columns if n != "feature"], "_f.properties", "_f.geometry")


def parts_of(geometry: Column) -> Column:
    """Coordinates of one plain geometry as parts of rings of positions; null for other kinds."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    at = lambda depth: F.try_variant_get(geometry, "$.coordinates", "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    lifted = {
        "Point": F.array(F.array(F.array(at(0)))), "MultiPoint": F.transform(at(1), lambda p: F.array(F.array(p))), "LineString": F.array(F.array(at(1))),
        "MultiLineString": F.transform(at(2), lambda p: F.array(p)), "Polygon": F.array(at(2)), "MultiPolygon": at(3),
    }
    return F.coalesce(*[F.when((kind == name) & at(DEPTH[name]).isNotNull(), value) for name, value in lifted.items()])


def flattened(features: DataFrame) -> DataFrame:
    """Geometry collections, also nested ones, replaced by their members (``member`` tells them apart)."""
    c = F.col
    rows, done = features.withColumn("member", F.lit("")), None
    while True:
        collection = F.coalesce(F.try_variant_get(c("geometry"), "$.type", "string"), F.lit("")) == "GeometryCollection"
        plain = rows.filter(~collection)
        done = plain if done is None else done.unionByName(plain)
        rows = rows.filter(collection)
        if rows.isEmpty():
            return done
        inner = F.posexplode(F.try_variant_get(c("geometry"), "$.geometries", "array<variant>")).alias("i", "g")
        rows = rows.select(*[n for n in rows.columns if n != "geometry"], inner).withColumn("member", F.concat("member", F.lit("/"), c("i").cast("string"))).withColumnRenamed("g", "geometry").drop("i")


def typed(features: DataFrame, type_field: str, type_map: dict[str, str]) -> DataFrame:
    """Features with ``kind`` (utility or zone), ``object_type``, ``attrs``, ``geom_type`` and ``parts``; the other columns stay.

    The raw type goes through the map; a missing, null or NaN type is ``unknown``. Properties that are null or NaN are absent.
    Features without geometry or without positions are dropped. A geometry collection gives a row a member.
    """
    c = F.col
    props = F.coalesce(F.try_variant_get(c("properties"), "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = flattened(features).withColumn("_p", F.map_filter(props, lambda k, v: v.isNotNull() & (F.lower(v) != "nan")))
    # made once a row: a filter on a plain column would work the coordinates out a second time
    rows = measured(rows, "parts", F.filter(parts_of(c("geometry")), lambda p: F.exists(p, lambda r: F.exists(r, lambda xy: F.size(xy) >= 2))))
    rows = rows.filter(F.size("parts") > 0)
    raw = F.coalesce(c("_p")[type_field], F.lit("unknown"))
    mapped = F.create_map(*[F.lit(v) for kv in type_map.items() for v in kv])[raw] if type_map else F.lit(None).cast("string")
    rows = rows.withColumn("object_type", F.coalesce(mapped, raw)).withColumn("geom_type", F.try_variant_get(c("geometry"), "$.type", "string"))
    kind = F.when(c("object_type").isin(list(fx.UTILITY_TYPES)), "utility").otherwise("zone")
    return rows.withColumn("kind", kind).withColumn("attrs", F.map_filter("_p", lambda k, v: k != type_field)).drop("_p", "properties", "geometry")


def edge_count(parts: Column) -> Column:
    """How many edges `edges_of` makes of the parts of a feature."""
    of_ring = lambda r: F.when(F.size(r) > 0, F.greatest(F.size(r) - 1, F.lit(1))).otherwise(0).cast("long")
    total = lambda sum_, n: sum_ + n
    return F.aggregate(F.flatten(F.transform(parts, lambda p: F.transform(p, of_ring))), F.lit(0).cast("long"), total)


def edges_of(features: DataFrame, *keys: str) -> DataFrame:
    """Two-point edges (keys, part, ring, seq, x1 .. y2) of typed features; a lone position is an edge of no length.

    Rings end where they begin, as GeoJSON has them, so every pair of neighbouring positions is an edge.
    """
    c = F.col
    rings = features.select(*keys, F.posexplode("parts").alias("part", "rings")).select(*keys, "part", F.posexplode("rings").alias("ring", "at"))
    last = F.size("at") - 1
    pairs = F.when(last == 0, F.array(F.struct(F.lit(0).alias("seq"), c("at")[0].alias("a"), c("at")[0].alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.struct(i.alias("seq"), c("at")[i].alias("a"), c("at")[i + 1].alias("b"))))
    rows = rings.filter(last >= 0).select(*keys, "part", "ring", F.explode(pairs).alias("e"))
    return rows.select(*keys, "part", "ring", "e.seq", c("e.a")[0].alias("x1"), c("e.a")[1].alias("y1"), c("e.b")[0].alias("x2"), c("e.b")[1].alias("y2"))


def in_metres(edges: DataFrame) -> DataFrame:
    """Edges of files whose bounds are degrees as metres of the UTM zone of the file's middle, northern half; ``zone`` is null elsewhere.

    GeoJSON says degrees when it says nothing, but plain metres are common too, so only the numbers decide: a file counts as
    degrees if all of it lies within 180 degrees of longitude and 90 of latitude.
    """
    c = F.col
    bounds = edges.groupBy("file").agg(F.min(F.least("x1", "x2")).alias("lo"), F.max(F.greatest("x1", "x2")).alias("hi"), F.min(F.least("y1", "y2")).alias("so"), F.max(F.greatest("y1", "y2")).alias("no"))
    degrees = (c("lo") >= -180) & (c("hi") <= 180) & (c("so") >= -90) & (c("no") <= 90)
    zones = bounds.select("file", F.when(degrees, F.least(F.floor(((c("lo") + c("hi")) / 2 + 180) / 6), F.lit(59)) + 1).cast("int").alias("zone"))
    rows = edges.join(zones, "file")
    for a, b in (("x1", "y1"), ("x2", "y2")):
        east, north = to_utm(c(a), c(b), c("zone"))
        rows = rows.withColumn("_e", F.when(c("zone").isNull(), c(a)).otherwise(east)).withColumn(b, F.when(c("zone").isNull(), c(b)).otherwise(north)).withColumn(a, c("_e")).drop("_e")
    return rows
