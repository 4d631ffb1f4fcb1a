"""Sizes that once were cut off: deep blocks, long rows, large sites; and the shared folder."""

import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefit import session
from sitefit.operators import planting, territory
from sitefit.plans.edits import chain_order
from sitefit.sources.ingest import expand_blocks


def test_blocks_of_any_depth_and_cycles(spark):
    rows = [(k, k - 1 if k else None, 1, 2) for k in range(3000)] + [(5000, 5001, 1, 1), (5001, 5000, 1, 1), (6000, 5999, 1, 1)]
    found = {r["k"]: (r["dx"], r["dy"], r["depth"]) for r in expand_blocks(spark.createDataFrame(rows, "k long, parent long, dx long, dy long")).collect()}
    assert len(found) == len(rows) and all(found[k] == (k + 1, 2 * (k + 1), k) for k in range(3000))
    assert found[5000] == found[5001] == found[6000] == (None, None, None)


def test_long_rows_are_walked_whole(spark):
    rng = np.random.default_rng(4)
    x, y = (np.arange(5001) * 137 + rng.integers(0, 300, 5001)).tolist(), rng.integers(0, 900, 5001).tolist()
    rows = [(0, "tree-row-1", i, x[i], y[i]) for i in range(5001)] + [(0, "tree-row-2", 10_000 + i, x[i] // 50, y[i]) for i in range(300)]
    found = chain_order(spark.createDataFrame(rows, "site_id long, group_id string, item_id long, xc long, yc long")).collect()
    assert len(found) == len(rows)
    for name in ("tree-row-1", "tree-row-2"):
        at = {r[2]: (r[3], r[4]) for r in rows if r[1] == name}
        order = [r["item_id"] for r in sorted((r for r in found if r["group_id"] == name), key=lambda r: r["pos"])]
        assert sorted(order) == sorted(at)
        ids = np.array(sorted(at))
        px, py = (np.array([at[i][k] for i in ids.tolist()]) for k in (0, 1))
        free = np.ones(len(ids), bool)
        for a, b in zip(order, order[1:], strict=False):
            k = int(np.searchsorted(ids, a))
            free[k] = False
            d = np.where(free, (px - px[k]) ** 2 + (py - py[k]) ** 2, np.iinfo(np.int64).max)
            assert ids[int(np.argmin(d))] == b


def test_large_sites_are_sampled(spark):
    frame = spark.createDataFrame([(1, 1e7, 0.0, 0.0, 1000.0, 1000.0), (2, 100.0, 0.0, 0.0, 10.0, 10.0)], "site_id long, area_m2 double, x0 double, y0 double, xm double, ym double")
    counts = {r["site_id"]: r["samples"] for r in planting.dart_counts(frame, 4.0).collect()}
    assert counts[1] > planting.MAX_RAW_SAMPLES
    got = planting.darts(frame, 4.0, "s").groupBy("site_id").agg(F.count("*").alias("n"), F.countDistinct("dart_id").alias("d")).collect()
    assert {r["site_id"]: (r["n"], r["d"]) for r in got} == {k: (n, n) for k, n in counts.items()}


def test_overlapping_pieces_are_united_and_nested_ones_cut_out(spark):
    def area(*boxes):
        rows = [(1, k, *box) for k, box in enumerate(boxes)]
        cells = territory.contour_cells(spark.createDataFrame(rows, "site_id long, piece long, x0 long, y0 long, xm long, ym long"))
        return territory.combine(cells).first()["area_m2"]

    assert area((0, 0, 10, 10), (5, 0, 15, 10)) == 150
    assert area((0, 0, 20, 20), (5, 5, 15, 15)) == 300
    assert area((5, 5, 15, 15), (0, 0, 20, 20), (8, 8, 10, 10)) == 304


def test_a_cluster_needs_a_shared_folder():
    context = types.SimpleNamespace(applicationId="none", master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_folder(types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *_: None)))
