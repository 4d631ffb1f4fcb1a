"""First come, first served in turns over strips equals one pass over all points."""

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sitefit.catalog import load
from sitefit.operators import firsts


def near():
    return lambda dx, dy, r, s: np.sqrt(dx * dx + dy * dy) < r + s


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    points = [(rng.randrange(2), rng.randrange(2), k, rng.uniform(0, 60), rng.uniform(-90, 90), rng.choice([0.5, 1.5]), float(rng.randrange(9)), rng.randrange(3)) for k in range(1500)]
    df = spark.createDataFrame(points, "site_id long, kind long, id long, x double, y double, r double, k1 double, k2 long").withColumn("sy", F.col("y"))
    got = sorted(r.id for r in firsts.first_come(df, 3.0, near()).collect())
    kept = []
    for p in sorted(points, key=lambda p: (p[6], p[7], p[2])):
        if all(p[:2] != q[:2] or ((p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) ** 0.5 >= p[5] + q[5] for q in kept):
            kept.append(p)
    assert got == sorted(p[2] for p in kept)


def test_points_without_a_place_meet_nothing(spark):
    rows = [(None, 0, 1, 1.0, 1.0), (None, 0, 2, 1.0, 1.0), (0, 0, 3, None, 1.0), (0, 0, 4, 1.0, None), (0, 0, 5, 1.0, 1.0), (0, 0, 6, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "site_id long, kind long, id long, x double, y double").withColumn("sy", F.col("y"))
    df = df.withColumn("r", F.lit(1.0)).withColumn("k1", F.lit(0.0)).withColumn("k2", F.col("id"))
    assert sorted(r.id for r in firsts.first_come(df, 3.0, near()).collect()) == [1, 2, 3, 4, 5]


def test_group_centres_are_chosen_without_a_table_of_pairs(spark, monkeypatch):
    from sitefit.operators import iterate, planting

    pairs = []
    for module in (iterate, planting):
        for name in ("first_independent", "near_pairs"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda *a, name=name, **k: pairs.append(name))
    assert load()[0]["group_positions"](spark, SMALL).count() > 0 and not pairs


def test_functions_of_workers_travel_with_their_job(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from sitefit.operators import ground

    path = tmp_path / "functions"
    path.write_bytes(cloudpickle.dumps((firsts.settle, ground.Strip, ground.held_points)))
    code = "import pickle, sys; pickle.load(open(sys.argv[1], 'rb')); assert not any(m.startswith('sitefit') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, check=True)


def test_selection_and_plans_make_no_pairs(spark, monkeypatch):
    from sitefit.operators import buckets, planting, select

    met = []
    plain = buckets.near_pairs
    for module in (select, planting):
        monkeypatch.setattr(module, "near_pairs", lambda *a, **k: met.append(a) or plain(*a, **k))
    assert load()[0]["type_plan"](spark, SMALL).count() > 0 and not met
    assert not hasattr(planting, "blocker_cells")
