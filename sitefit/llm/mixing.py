"""Mixing domains to target weights by soft membership.

A classifier fitted on a labelled table (doc_id, domain) predicts each document's posterior over domains. Every document then gets a
nonnegative rate r(d), and the expected tokens of a domain are the sum of r(d) * tokens(d) * posterior(d, domain). The rates
minimise the squared distance of these totals from the targets by projected gradient descent, starting at 1. Distances are
whitened by the (small) matrix of products between domains, so that the curvature is at most one in every direction and a step of
one never makes the distance greater: it moves each rate against the gradient and clips it to [0, most]. Rates are measured by the square
root of a document's tokens, so that a step moves short and long documents alike. Only one number a domain (the residual) leaves the
cluster in a step; a rate is a fold over the last residuals, and every FOLDED steps it is written down.

The weights fix the targets' ratios, not the total. The descent first asks for the largest total that no domain alone forbids; with
soft posteriors rates up to `most` may not reach it jointly. When the distance stalls while rates stand at `most`, goal and rates
are lowered together and the descent goes on from there. It ends when the totals are within CLOSE of the goal, when it stalls with no rate
at `most` (the posteriors allow no better ratios at any total), or after STEPS steps; `goal` and `reached` tell what came of it.

DataFrame functions and the JVM classifier of pyspark.ml only.

Scale: texts are read once, for posteriors and token counts, which are written to the shared folder; each step is a scan of
those few numbers a document with one tiny aggregate. The classifier is fitted on at most FIT_ROWS labelled rows. Domains
are few (at most MOST_DOMAINS, else an error): their totals and the classifier live on the driver.

Nulls, empty and odd input: a null or empty text has no tokens; its rate is 1, as it weighs nothing. Labels with a null id or domain are not
read. Rows with a null id get rates as all others. Repeated rows are separate rows with equal rates. Other columns stay
as they are. Without labels, or with one domain, every posterior is certain; if no labelled
document is there with a text, all are even. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefit.llm.base import once
from sitefit.session import cut

#: Labelled rows that the classifier is fitted on, domains, hashed features: at most.
FIT_ROWS, MOST_DOMAINS, BUCKETS = 4000, 200, 1 << 12
#: Most steps of the descent, the distance (a share of the goal) that ends it, and steps after which rates are written down.
STEPS, CLOSE, FOLDED = 80, 1e-3, 10
#: The ratio of two steps' distances that counts as a stall, and what goal and rates are then multiplied by.
STALLED, LOWERED = 0.95, 0.9


def word_list(text: Column) -> Column:
    """Lower-cased words of a text, between the blanks 0x20 and 0x09-0x0D; none for null or blank texts."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for blank in "\t\n\v\f\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def _vectors(rows: DataFrame, words: str, out: str) -> DataFrame:
    counted = HashingTF(inputCol=words, outputCol="counts_", numFeatures=BUCKETS).transform(rows)
    return Normalizer(inputCol="counts_", outputCol=out, p=2.0).transform(counted).drop("counts_")


def posteriors(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list[str]]:
    """(doc_id, tokens, posterior) of every row, and the domains in the order of the posterior's numbers.

    `labels` has doc_id and domain. What the model is fitted on is chosen by a hash of the id, at most about `fit_rows`.
    """
    c = F.col
    marks = labels.filter("doc_id is not null and domain is not null").groupBy(c("doc_id").cast("long").alias("doc_id")).agg(F.min(c("domain").cast("string")).alias("domain"))
    domains = [r["domain"] for r in marks.select("domain").distinct().orderBy("domain").limit(MOST_DOMAINS + 1).collect()]
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    texts = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")

    def split(texts: DataFrame) -> DataFrame:
        return texts.withColumn("words_", word_list(c("text"))).drop("text").withColumn("tokens", F.size("words_").cast("long"))

    rows = split(texts)
    if len(domains) < 2:
        return rows.select("doc_id", "tokens", F.array(F.lit(1.0)).alias("posterior")), domains or ["all"]
    n = marks.count()
    share = int(1_000_003 * min(1.0, fit_rows / n))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share).limit(2 * fit_rows)
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), c("domain")).cast("double") - 1
    fitted = cut(_vectors(split(texts.join(F.broadcast(chosen), "doc_id")).filter("tokens > 0"), "words_", "features").select("features", place.alias("label")))
    if fitted.isEmpty():
        even = F.array(*[F.lit(1.0 / len(domains))] * len(domains))
        return rows.select("doc_id", "tokens", even.alias("posterior")), domains
    model = LogisticRegression(maxIter=30, regParam=1e-3, family="multinomial").fit(fitted)
    model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("chance_")
    # the model's numbers are worked out once a row: a lambda would do it again for every domain
    found = once(model.transform(_vectors(rows, "words_", "features")).select("doc_id", "tokens", "chance_"), numbers_=vector_to_array("chance_"))
    # a domain that the sample missed has no number of its own in the model
    chance = c("numbers_")
    return found.select("doc_id", "tokens", F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda k: F.coalesce(F.get(chance, k), F.lit(0.0))).alias("posterior")), domains


def _rate(history: list[list[float]], most: float) -> Column:
    """The column `base` after steps, each a factor and the whitened residuals: it moves the rate against its gradient and clips it."""
    c = F.col
    if not history:
        return c("base")
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])

    def one(rate: Column, step: Column) -> Column:
        slope = F.aggregate(F.zip_with(c("posterior"), F.slice(step, 2, len(history[0]) - 1), lambda p, r: p * r), F.lit(0.0), lambda a, b: a + b)
        return F.least(F.greatest(rate * step[0] - slope, F.lit(0.0)), F.lit(float(most)))

    return F.when(c("tokens") > 0, F.aggregate(steps, c("base"), one)).otherwise(c("base"))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, power: float = 0.8, most: float = 1.0) -> DataFrame:
    """(doc_id, tokens, rate, posterior, domain, goal, reached): a rate in [0, most] for every row.

    `targets` maps domains to weights (they are made to add up to one); by default a domain's weight is its expected share of
    tokens to the `power`. `goal` and `reached` are the wanted and the expected tokens of the row's domain, as shares of all tokens before mixing.
    """
    c = F.col
    found, domains = posteriors(docs, labels)
    found = cut(found)
    each = [F.sum(c("tokens") * c("posterior")[k]).alias(f"t{k}") for k in range(len(domains))]
    sums = found.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), *each).first()
    total = float(sums["tokens"] or 0)
    if not total:
        return found.select("doc_id", "tokens", F.lit(float(min(1.0, most))).alias("rate"), "posterior", F.lit(domains[0]).alias("domain"), F.lit(0.0).alias("goal"), F.lit(0.0).alias("reached"))
    have = [float(sums[f"t{k}"] or 0) / total for k in range(len(domains))]
    wanted = [float(targets.get(d, 0)) for d in domains] if targets else [h**power for h in have]
    wanted = [w / sum(wanted) for w in wanted]
    size = min([most * h / w for h, w in zip(have, wanted, strict=True) if w > 0] + [most])
    goal = size * np.array(wanted)

    # tokens as shares of their mean keep the numbers near one
    k = len(domains)
    rows = found.withColumns({"share": c("tokens") * F.lit(sums["n"] / total), "base": F.lit(float(min(1.0, most)))})
    grams = [F.sum(c("share") * c("posterior")[i] * c("posterior")[j]) for i in range(k) for j in range(k)]
    whiten = np.linalg.pinv(np.array([float(x or 0) for x in rows.agg(*grams).first()]).reshape(k, k), rcond=1e-9, hermitian=True) * sums["n"]
    history: list[list[float]] = []
    far = float("inf")
    for step in range(STEPS + 1):
        moved = rows.withColumn("rate", _rate(history, most))
        *now, top = moved.agg(*[F.sum(c("rate") * c("tokens") * c("posterior")[i]) for i in range(k)], F.max("rate")).first()
        reached = np.array([float(x or 0) / total for x in now])
        residual = reached - goal
        near = float(np.sqrt(max(residual @ whiten @ residual, 0.0) / max(goal @ whiten @ goal, 1e-300)))
        stalled = near > STALLED * far
        if float(np.linalg.norm(residual)) < CLOSE * float(np.linalg.norm(goal)) or step == STEPS or (stalled and top < most * (1 - 1e-9)):
            break
        factor = LOWERED if stalled else 1.0
        far, goal = (float("inf") if stalled else near), factor * goal
        history.append([factor, *(whiten @ (factor * residual)).tolist()])
        if len(history) == FOLDED:
            rows, history = cut(rows.withColumn("base", _rate(history, most))), []
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    of_best = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), best)
    return rows.select("doc_id", "tokens", _rate(history, most).alias("rate"), "posterior", of_best(domains).alias("domain"), of_best(goal.tolist()).alias("goal"),
                       of_best(reached.tolist()).alias("reached"))


def thinned(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, power: float = 0.8) -> DataFrame:
    """`docs` sampled by their rates (at most 1): a row stays if a hash of its id falls below its rate. Rows with a null id stay."""
    c = F.col
    found = rates(docs.select("doc_id", "text"), labels, targets, power, 1.0)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    kept = found.filter(c("doc_id").isNotNull() & (chance < c("rate"))).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null"))
