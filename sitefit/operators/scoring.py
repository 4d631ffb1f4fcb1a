"""Scores of candidates and the learned scorers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.functions import dims
from sitefit.operators.area import capped_room, least_room
from sitefit.operators.buckets import SITE, as_edges, inside, near_pairs
from sitefit.operators.measures import hash01
from sitefit.operators.proximity import zoning_found

FEATURES = [n for n, _ in fx.SCORE_WEIGHTS]


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def score_features(candidates: DataFrame, edges: DataFrame, features: DataFrame) -> DataFrame:
    """Five features in [0, 1] per candidate point; rows that share an id stay as many as they are."""
    c = F.col
    room = least_room(candidates, edges, "tree", "cand_id")
    zone = zoning_found(candidates, edges, features, "cand_id")
    green = edges.filter(c("object_type") == "existing_greenery")
    near = near_pairs(candidates.select(SITE, "cand_id", "x", "y"), green.select(SITE, "x1", "y1", "x2", "y2"), fx.REFERENCE_GAP_M, 24.0).select(SITE, "cand_id", "dist")
    held = inside(candidates, green.filter("geom_kind = 'polygon'"), "cand_id").select(SITE, "cand_id", F.lit(0.0).alias("dist"))
    gap = near.unionByName(held).groupBy(SITE, "cand_id").agg(F.min("dist").alias("gap"))
    suit = dims.dim(candidates.sparkSession, fx.ZONING_SUITABILITY, "zoning,suitability")
    radius = F.coalesce(*[F.when(c("planting_type") == r[0], F.lit(r[2])) for r in fx.TYPE_NORMS])
    rows = (candidates.select(SITE, "cand_id", "planting_type").join(room, [SITE, "cand_id"], "left").join(zone, [SITE, "cand_id"], "left").join(gap, [SITE, "cand_id"], "left")
            .withColumn("zoning", F.coalesce("zoning", F.lit("unknown"))).join(F.broadcast(suit), "zoning", "left"))
    return rows.select(SITE, "cand_id", "planting_type", clamp(capped_room() / fx.REFERENCE_CLEARANCE_M).alias("extra_clearance_ratio"),
                       clamp(radius * radius / fx.REFERENCE_AREA_M2).alias("size_score"), F.lit(1.0).alias("compactness"),
                       F.coalesce("suitability", F.lit(0.5)).alias("zoning_suitability"),
                       clamp(F.coalesce("gap", F.lit(fx.REFERENCE_GAP_M)) / fx.REFERENCE_GAP_M).alias("existing_greenery_gap_score"))


def heuristic(features: DataFrame) -> DataFrame:
    """Weighted score and the first largest contribution."""
    parts = [F.col(n) * w for n, w in fx.SCORE_WEIGHTS]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    top = F.array_max(F.array(*[F.struct(p.alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (p, n) in enumerate(zip(parts, FEATURES))]))["n"]
    return features.withColumn("score", total).withColumn("top_factor", top)


def weak_labels(scored: DataFrame, noise: float = 0.08, threshold: float = 0.55) -> DataFrame:
    """Noisy labels: the score plus a hash-drawn Gaussian, against a threshold."""
    key = F.col("cand_id").cast("string")
    u1, u2 = hash01(F.concat(key, F.lit(":a"))), hash01(F.concat(key, F.lit(":b")))
    gauss = F.sqrt(F.log(F.lit(1.0) - u1) * -2.0) * F.cos(u2 * (2 * math.pi))
    return scored.withColumn("label", (F.floor((F.col("score") + gauss * noise) * 1e6 + 0.5) / 1e6 >= threshold).cast("long"))


def fit_weak(labelled: DataFrame):
    """Standardised logistic regression on the weak labels; a hash split keeps a fifth for the accuracy."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    u = hash01(F.concat(F.col("cand_id").cast("string"), F.lit(":split")))
    train, test = labelled.filter(u < 0.8), labelled.filter(u >= 0.8)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                             LogisticRegression(labelCol="label", maxIter=30)]).fit(train)
    return model, model.transform(test)


def predict(model, features: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(features).select(SITE, "cand_id", vector_to_array("probability")[1].alias("p"))


def label_points(points: DataFrame, point_id: str, reference: DataFrame, radius: float = fx.LABEL_RADIUS_M) -> DataFrame:
    """1 where a reference tree stands within the radius."""
    hit = near_pairs(points.select(SITE, point_id, "x", "y"), as_edges(reference), radius, 8.0).select(SITE, point_id).distinct().withColumn("label", F.lit(1).cast("long"))
    return points.join(hit, [SITE, point_id], "left").fillna(0, ["label"])


def group_weights(samples: DataFrame) -> DataFrame:
    """Every site carries the same total weight."""
    c = F.col
    per = samples.groupBy(SITE).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("sites"))
    return per.crossJoin(F.broadcast(total)).select(SITE, "n", (c("all") / (c("n") * c("sites"))).alias("weight"))


def rank_metrics(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rank-sum ROC-AUC and average precision per site, from counts per distinct score value."""
    c = F.col
    g = scored.groupBy(SITE, c(score).alias("s")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    up = W.partitionBy(SITE).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(SITE).orderBy(c("s").desc()).rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))
    part = F.floor(c("pos") * (c("tp") / c("seen")) * 1e9).cast("long")
    m = g.groupBy(SITE).agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(c("pos") * (c("below") * 2 + c("n") + 1)).alias("rank2"), F.sum(part).alias("ap9"))
    auc = (c("rank2") / 2.0 - c("p") * (c("p") + 1) / 2.0) / (c("p") * (c("n") - c("p")))
    ok = (c("p") > 0) & (c("p") < c("n"))
    rate = c("p") / c("n")
    ap = c("ap9") / 1e9 / c("p")
    return m.select(SITE, c("p").alias("positives"), "n", F.when(ok, auc).alias("auc"), F.when(c("p") > 0, ap).alias("ap"), F.when(c("p") > 0, ap / rate).alias("lift"))


def gate(scored: DataFrame, gate_at: float = fx.GATE, least: float = fx.MIN_GATE_SHARE) -> DataFrame:
    """Scores below the gate are rejected (-1); the gate is off at a site where it would pass almost nothing."""
    c = F.col
    share = scored.groupBy(SITE).agg((F.sum((c("score") >= gate_at).cast("long")) / F.count(F.lit(1))).alias("pass_share"))
    on = c("pass_share") >= least
    return scored.join(share, SITE).select(SITE, "cand_id", "pass_share", F.when(on & (c("score") < gate_at), F.lit(-1.0)).otherwise(c("score")).alias("gated"))


def lift_rationale(matrix: DataFrame, point_id: str) -> DataFrame:
    """The two nearest context groups of every point, below the cap."""
    groups = [g for g, _ in fx.DISTANCE_GROUPS]
    near = F.filter(F.array(*[F.struct(F.col(f"d_{g}").alias("d"), F.lit(g).alias("g")) for g in groups]), lambda s: s["d"] < fx.MAX_DISTANCE_M)
    two = F.slice(F.array_sort(near), 1, 2)
    return matrix.select(SITE, point_id, F.array_join(F.transform(two, lambda s: s["g"]), ",").alias("nearest_two"), F.get(two, 0)["d"].alias("first_m"))


def leave_one_out(samples: DataFrame, fold: str, features: list[str], folds: list, trees: int = 5) -> DataFrame:
    """Boosted trees fitted without one fold at a time; out-of-fold probabilities."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from sitefit.session import cut

    rows = cut(VectorAssembler(inputCols=features, outputCol="features").transform(samples))
    out = None
    for value in folds:
        model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=4, seed=0).fit(rows.filter(F.col(fold) != value))
        part = model.transform(rows.filter(F.col(fold) == value)).select(SITE, "ref_id", "label", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out
