"""Keyed edit state over several micro-batches against the batch fold."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from sitefit.plans.edits import edit_fold, edited_items
from sitefit.streaming import live

EDITS = "seq long, ts timestamp, item_id long, op string, dxc long, dyc long, new_type string, new_species string"
ITEMS = "site_id long, item_id long, planting_type string, xc long, yc long, species string, is_manual_edit boolean"
START = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, i, ("tree", "shrub", "lawn")[i % 3], 100 * i, 50 * i, "default", False) for i in range(12)], ITEMS)


def edit(rng, seq, minutes):
    return (seq, START + dt.timedelta(minutes=minutes), rng.randrange(14), rng.choice(["move", "move", "retype", "patch", "delete", "restore"]), rng.randrange(-9, 9), rng.randrange(-9, 9), rng.choice(["tree", "shrub", "lawn"]), rng.choice("abc"))


def streamed(spark, tmp_path, batches, items, delay):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(1.1)  # files are taken in the order of their times
    log = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    live.keep_states(live.item_states(log, items, delay), str(tmp_path / "states"))
    return spark.read.parquet(str(tmp_path / "states"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edits_out_of_order_equal_the_batch_fold(spark, tmp_path, items):
    rng = random.Random(1)
    log = [edit(rng, k, 3 * k) for k in range(120)]
    batches = [log[:40], log[40:80], log[80:]]
    for k in (0, 1):  # within the delay, some edits come a batch later
        late = [e for e in batches[k][-12:] if e[0] % 2]
        batches[k] = [e for e in batches[k] if e not in late]
        batches[k + 1] = late + batches[k + 1]
    states = streamed(spark, tmp_path, batches, items, "2 hours")
    assert states.select("batch").distinct().count() >= 3
    assert rows(live.plan_state(spark, str(tmp_path / "states"), items)) == rows(edit_fold(spark.createDataFrame(log, EDITS), items))


def test_edits_behind_the_watermark_are_dropped(spark, tmp_path, items):
    move = lambda seq, minutes, d: (seq, START + dt.timedelta(minutes=minutes), 1, "move", d, 0, "tree", "a")
    batches = [[move(1, 0, 1), move(2, 600, 10)], [move(3, 601, 100)], [move(4, 1, 1000), move(5, 602, 10000)]]
    streamed(spark, tmp_path, batches, items, "10 minutes")
    found = live.plan_state(spark, str(tmp_path / "states"), items).filter("item_id = 1").first()
    assert found.x == (100 + 1 + 10 + 100 + 10000) / 100 and found.edits == 4


def test_edited_items_leave_deleted_ones_out(spark, items):
    state = spark.createDataFrame([(1, 5, 0, "tree", "x", None, True, 2), (2, 0, 0, None, None, "delete", False, 1)], f"item_id long, {live.STATE}")
    now = {r.item_id: r for r in edited_items(items.withColumn("x", F.col("xc") / 100.0).withColumn("y", F.col("yc") / 100.0), state).collect()}
    assert 2 not in now and len(now) == 11
    assert (now[1].x, now[1].planting_type, now[1].species, now[1].is_manual_edit) == (1.05, "tree", "x", True)
