"""Roomiest spots and patches against one-by-one picking."""

import random

from sitefit.operators.area import patch_of, roomiest


def test_roomiest_equals_picking_one_by_one(spark):
    rng = random.Random(6)
    cells = {i * 1000000 + j: (i * 2.0 + 1, j * 2.0 + 1, rng.randrange(12) / 2.0) for i in range(26) for j in range(22) if rng.random() < 0.8}
    patch = {k: int(cells[k][0] > 24) for k in cells}
    df = spark.createDataFrame([(5, k, k // 1000000, k % 1000000, x, y) for k, (x, y, _) in cells.items()], "site_id long, cell_id long, ix long, iy long, x double, y double")
    room = spark.createDataFrame([(5, k, m) for k, (_, _, m) in cells.items()], "site_id long, cell_id long, clearance_m double")
    keys = spark.createDataFrame([(5, k, p) for k, p in patch.items()], "site_id long, cell_id long, patch_id int")
    want = []
    for p in (0, 1):
        left, round_ = {k for k in cells if patch[k] == p and cells[k][2] >= 1.0}, 0
        while left:
            best = min(left, key=lambda k: (-cells[k][2], k))
            want.append((5, p, round_, best, cells[best][2]))
            left = {k for k in left if (cells[k][0] - cells[best][0]) ** 2 + (cells[k][1] - cells[best][1]) ** 2 > 49.0}
            round_ += 1
    assert sorted(tuple(r) for r in roomiest(df, room, keys, 7.0, 1.0).collect()) == sorted(want)
    assert roomiest(df, room, keys, 7.0, 99.0).isEmpty()

    label = {k: k for k in cells}
    for _ in range(60):
        for k in cells:
            for other in (k - 1000000, k + 1000000, k - 1, k + 1):
                if other in cells:
                    label[k] = min(label[k], label[other])
    got = {r.cell_id: r.patch_id for r in patch_of(df).collect()}
    groups = {}
    for k, p in got.items():
        groups.setdefault(p, set()).add(label[k])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(label.values()))
