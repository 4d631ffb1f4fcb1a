"""Jobs over tables of messages and written names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit.functions import dims
from sitefit.functions import text as tx
from sitefit.functions.intents import INTENT_RULES


def intents(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("intent", tx.first_rule(F.col("clause"), INTENT_RULES))


def match_names(names: DataFrame) -> DataFrame:
    """Catalogue names whose genus stem matches; joined on the first three letters of stems."""
    c = F.col
    spark = names.sparkSession
    joined = lambda col: F.array_join(tx.words(col), " ")
    known = dims.species(spark).select(c("name").alias("species"), joined(c("name")).alias("full"), F.posexplode(tx.words(c("name"))).alias("cpos", "w"))
    known = known.select("species", "full", "cpos", tx.stem(c("w")).alias("cstem")).filter(F.length("cstem") >= 3).withColumn("head", F.substring("cstem", 1, 3))
    asked = names.select("k", joined(c("name")).alias("wanted"), F.posexplode(tx.words(c("name"))).alias("pos", "w"))
    asked = asked.select("k", "wanted", "pos", tx.stem(c("w")).alias("stem")).filter(F.length("stem") >= 3).withColumn("head", F.substring("stem", 1, 3))
    hits = asked.join(F.broadcast(known), "head").filter(c("stem").startswith(c("cstem")) | c("cstem").startswith(c("stem")))
    scored = hits.groupBy("k", "species").agg(F.countDistinct("pos").alias("score"), F.bool_or(c("cpos") == 0).alias("genus"),
                                              F.bool_or(c("wanted") == c("full")).cast("int").alias("exact")).filter("genus")
    w = W.partitionBy("k")
    rows = scored.withColumn("any_exact", F.max("exact").over(w)).filter(c("exact") == c("any_exact"))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(c("exact").desc(), c("score").desc(), c("species"))).cast("long")).select("k", "species", "rank", "score")


def guard(commands: DataFrame) -> DataFrame:
    """Reason why each destructive command is dropped, or ``kept``."""
    c = F.col
    w = W.partitionBy("conv_id", "turn")
    rows = commands.filter(c("intent").isNotNull()).withColumn("picks", F.max(c("intent") == "select").over(w)).withColumn("clears", F.max(c("intent") == "deselect").over(w))
    reason = (F.when(c("picks"), "after_select").when(c("selected") <= 0, "nothing_selected").when(c("clears"), "with_deselect").when(c("asked"), "asked").otherwise("kept"))
    return rows.filter(c("intent") == "delete").select("conv_id", "turn", "no", reason.alias("reason"))
