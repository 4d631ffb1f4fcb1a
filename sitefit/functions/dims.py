"""Rulebook dimension tables as constant relations.

Their size is fixed by the rulebook (a few hundred rows at most), so joining them with a broadcast is
safe whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefit import fixed as fx

OTHER = "__other__"


def dim(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A constant relation; column types follow the Python values."""
    def text(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, int):
            return f"{v}L"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    names = columns.split(",")
    kinds = {float: "double", bool: "boolean", int: "bigint", str: "string"}
    types = [next((kinds[type(r[i])] for r in rows if r[i] is not None), "string") for i in range(len(names))]
    body = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"cast({n} as {t}) as {n}" for n, t in zip(names, types))
    return spark.sql(f"select {casts} from values {body} as v({', '.join(names)})")


def setback_rows():
    """object_type, planting_type, table_m, source_id, row_text — unknown types fall back to the largest value."""
    cited = {r[0]: {"tree": (r[1], r[2]), "shrub": (r[3], r[4]), "lawn": ("practice", r[5])} for r in fx.SETBACK_SOURCES}
    rows = [(r[0], p, r[1 + i], *cited[r[0]][p]) for r in fx.SETBACKS for i, p in enumerate(fx.PLANTING_TYPES)]
    rows += [(OTHER, p, max(r[1 + i] for r in fx.SETBACKS), "", "") for i, p in enumerate(fx.PLANTING_TYPES)]
    return rows


def setbacks(spark) -> DataFrame:
    return dim(spark, setback_rows(), "rule_key,planting_type,table_m,table_source,table_text")


def sources(spark) -> DataFrame:
    return dim(spark, fx.SOURCES, "source_id,act,clause,title,verified")


def species(spark) -> DataFrame:
    return dim(spark, fx.SPECIES, "name,species_type,crown,crown_m,heat_min_m,shades,density")


def type_norms(spark) -> DataFrame:
    return dim(spark, fx.TYPE_NORMS, "planting_type,min_distance_m,canopy_radius_m,min_area_m2,margin_m")


def crown_spacing(spark) -> DataFrame:
    return dim(spark, fx.CROWN_SPACING, "crown,interval_m")


def labels(spark) -> DataFrame:
    return dim(spark, fx.OBJECT_LABELS, "object_type,label")


def rule_key(object_type: str = "object_type"):
    known = [r[0] for r in fx.SETBACKS]
    return F.when(F.col(object_type).isin(known), F.col(object_type)).otherwise(F.lit(OTHER))


def with_species(df: DataFrame, name: str = "species") -> DataFrame:
    """Species attributes by exact catalogue name; unknown names keep nulls."""
    s = species(df.sparkSession).withColumnRenamed("name", name)
    return df.join(F.broadcast(s), name, "left")


def species_interval(spark) -> DataFrame:
    """name -> crown class and trunk interval."""
    s = species(spark).select("name", "crown", "crown_m", "species_type")
    return s.join(F.broadcast(crown_spacing(spark)), "crown", "left")
