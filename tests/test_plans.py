"""Properties: a generated plan passes the tool's own checks; repairs are legal; groups keep their distance."""

import math

from pyspark.sql import functions as F

from sitefit.catalog import load
from sitefit.operators import compliance as co
from sitefit.operators import measures as me
from sitefit.operators import planting as pl
from sitefit.operators import select as se
from sitefit.operators.area import site_frame
from sitefit.operators.buckets import ranked
from sitefit.plans import fixes as fi

QUERIES, _ = load()


def test_plan_violates_nothing(tables):
    plan = se.plan_items(tables.candidates, tables.edges, tables.outline, me.site_area(tables.outline)).withColumn("side_c", F.lit(0))
    assert plan.count() > 0
    assert co.setback_checks(plan, tables.edges).filter(~F.col("satisfied")).count() == 0
    assert co.neighbour_checks(plan).filter(~F.col("satisfied")).count() == 0


def test_cascade_keeps_intervals(tables):
    plan = pl.crown_cascade(tables.candidates, tables.edges, tables.outline).withColumn("side_c", F.lit(0)).withColumn("item_id", F.col("cand_id")).withColumn("planting_type", F.lit("tree"))
    assert co.neighbour_checks(plan).filter(~F.col("satisfied")).count() == 0
    assert co.setback_checks(plan, tables.edges).filter(~F.col("satisfied")).count() == 0


def test_group_centres_are_apart(tables):
    rows = pl.group_positions(site_frame(tables.outline), tables.outline, "groups").collect()
    assert rows
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            assert a.site_id != b.site_id or math.dist((a.x, a.y), (b.x, b.y)) >= pl.GROUP_PITCH_M


def test_moves_equal_one_by_one(tables):
    bad = co.violation_mask(tables.items, co.setback_checks(tables.items, tables.edges)).filter("violates and planting_type <> 'lawn' and site_id = 0")
    ids = sorted(r.item_id for r in bad.select("item_id").collect())[:6]
    movers = tables.items.filter(F.col("item_id").isin(ids))
    got = {r.item_id: (r.x, r.y) for r in fi.apply_moves(movers, tables.items, tables.edges, tables.outline).collect()}
    now, want = tables.items.select("site_id", "item_id", "planting_type", "species", "xc", "yc", "x", "y"), {}
    for i in ids:
        found = fi.nearest_spot(fi.legal_spots(now.filter(F.col("item_id") == i), now, tables.edges, tables.outline)).collect()
        want[i] = (found[0].x, found[0].y) if found else (None, None)
        if found:
            x, y = want[i]
            me_ = F.col("item_id") == i
            now = (now.withColumn("x", F.when(me_, x).otherwise(F.col("x"))).withColumn("y", F.when(me_, y).otherwise(F.col("y")))
                   .withColumn("xc", F.when(me_, round(x * 100)).otherwise(F.col("xc"))).withColumn("yc", F.when(me_, round(y * 100)).otherwise(F.col("yc"))))
    assert got == want


def test_replaced_species_are_equivalent(tables):
    from sitefit.operators.rulebook import equivalence

    rows = se.diversify(tables.items)
    key = equivalence(tables.items.filter("planting_type <> 'lawn'").select("planting_type", "species").distinct())
    a = rows.join(key, ["planting_type", "species"])
    b = key.selectExpr("planting_type", "species as new_species", "class_key as new_key")
    joined = a.join(b, ["planting_type", "new_species"])
    assert joined.filter("class_key <> new_key").count() == 0


def test_rank_without_group_sort(spark):
    rows = [(0, i, (i * 37 % 101) / 100.0) for i in range(300)]
    df = spark.createDataFrame(rows, "site_id long, cand_id long, score double")
    got = [r.cand_id for r in se.score_rank(df, ["site_id"]).orderBy("rank").collect()]
    assert got == [i for _, i, _ in sorted(rows, key=lambda r: (-r[2], r[1]))]


def test_results_do_not_depend_on_partitions(spark, tables):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = sorted(map(tuple, co.neighbour_checks(tables.items).select("item_id", "actual_m", "satisfied").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    two = sorted(map(tuple, co.neighbour_checks(tables.items).select("item_id", "actual_m", "satisfied").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == two
