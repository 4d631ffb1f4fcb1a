"""Windows of legal spots."""

from conftest import SMALL
from pyspark.sql import functions as F

from sitefit.catalog import load, q_edits
from sitefit.plans import fixes as fi


def test_window_reaches_sixty_metres(spark):
    rows = load()[0]["allowed_window"](spark, SMALL).collect()
    assert 140 ** 2 < max(r.farthest for r in rows) <= 150 ** 2 and max(r.spots for r in rows) > 41 * 41


def test_counted_spots_are_the_legal_ones(tables):
    movers = q_edits._violating(tables).cache()
    want = fi.legal_spots(movers, tables.items, tables.edges, tables.outline, 800, 40).groupBy("site_id", "item_id").agg(F.count("*").alias("n"), F.max("d2").alias("d"))
    got = fi.spot_counts(fi.surroundings(movers, tables.edges, tables.outline, 800), tables.items, 800, 40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
