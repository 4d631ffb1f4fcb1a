"""Set algorithms in rounds: independent set, matching, components. The driver only sees counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefit.operators.buckets import SITE
from sitefit.session import cut, discard, new_table, stored


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(site, node, label) with the least node id of each connected part: neighbour minimum, then pointer jumping."""
    c = F.col
    both = cut(links.select(SITE, "u", "v").unionByName(links.select(SITE, c("v").alias("u"), c("u").alias("v"))).distinct())
    labels = cut(nodes.select(SITE, "node", c("node").alias("label")))
    while True:
        seen = both.join(labels.select(SITE, c("node").alias("v"), "label"), [SITE, "v"]).groupBy(SITE, c("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(seen, [SITE, "node"], "left").select(SITE, "node", c("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # the root of a node inherits the least label any of its members saw
        roots = hooked.groupBy(SITE, "old").agg(F.min("label").alias("best"))
        moved = hooked.join(roots, [SITE, "old"]).select(SITE, "node", "old", F.least("label", "best").alias("label"))
        jump = moved.select(SITE, c("node").alias("label"), c("label").alias("up"))
        fresh = cut(moved.join(jump, [SITE, "label"]).select(SITE, "node", "old", c("up").alias("label")))
        if fresh.filter("label <> old").isEmpty():
            return fresh.select(SITE, "node", "label")
        labels = fresh.select(SITE, "node", "label")


def first_independent(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Nodes a sequential greedy pass in ``ord`` order would accept.

    ``nodes``: (site, id, ord struct); ``conflicts``: (site, id, other) in both directions. Every round accepts the
    nodes that come before all their undecided neighbours and drops those neighbours; the result equals the
    one-by-one pass.
    """
    c = F.col
    order = nodes.select(SITE, "id", "ord")
    ranked = conflicts.join(order, [SITE, "id"]).join(order.select(SITE, c("id").alias("other"), c("ord").alias("other_ord")), [SITE, "other"])
    # keep each pair once, from the later node to the earlier one
    return nodes.select(SITE, "id").join(beaten(ranked.filter(c("other_ord") < c("ord"))), [SITE, "id"], "left_anti")


def beaten(waits: DataFrame) -> DataFrame:
    """(site, id) that a sequential greedy pass refuses. ``waits``: (site, id, other), each conflict once, from the later node to the earlier.

    A node that waits for none is accepted and is in no table: rounds go over the open pairs only, which get fewer from round to round.
    """
    c = F.col
    spark, path = waits.sparkSession, new_table(waits.sparkSession)
    left = stored(waits.select(SITE, "id", "other"), path)
    out = None
    while not left.isEmpty():
        later = left.select(SITE, c("id").alias("other")).distinct()
        lost = stored(left.join(later, [SITE, "other"], "left_anti").select(SITE, "id").distinct())
        out = lost if out is None else out.unionByName(lost)
        old, path = path, new_table(spark)
        left = stored(left.join(lost, [SITE, "id"], "left_anti").join(lost.select(SITE, c("id").alias("other")), [SITE, "other"], "left_anti"), path)
        discard(spark, old)
    return left.select(SITE, "id") if out is None else out


def shortest_matching(links: DataFrame) -> DataFrame:
    """Greedy matching, least (gap, a, b) first, each end used once: rounds of locally least links."""
    c = F.col
    rows = cut(links.select(SITE, "gap", "a", "b").withColumn("k", F.struct("gap", "a", "b")))
    taken = None
    while True:
        ends = rows.select(SITE, c("a").alias("end"), "k").unionByName(rows.select(SITE, c("b").alias("end"), "k"))
        least = ends.groupBy(SITE, "end").agg(F.min("k").alias("least"))
        won = rows.join(least.select(SITE, c("end").alias("a"), c("least").alias("la")), [SITE, "a"]).join(
            least.select(SITE, c("end").alias("b"), c("least").alias("lb")), [SITE, "b"]).filter((c("la") == c("k")) & (c("lb") == c("k")))
        won = cut(won.select(SITE, "gap", "a", "b"))
        if won.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(SITE, c("a").alias("end")).unionByName(won.select(SITE, c("b").alias("end")))
        rows = cut(rows.join(used.select(SITE, c("end").alias("a")), [SITE, "a"], "left_anti").join(used.select(SITE, c("end").alias("b")), [SITE, "b"], "left_anti"))
    return taken if taken is not None else rows.drop("k")
