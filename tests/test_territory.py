"""Contours as runs of cells, against cell sets."""

import random

from sitefit.operators import territory

COLUMNS = "site_id long, piece long, x0 long, y0 long, xm long, ym long"


def test_runs_hold_every_cell_once_and_are_few(spark):
    rows = [(1, 1, -70, -3, 200, 5), (1, 2, 5, 5, 6, 6), (1, 3, 64, 0, 128, 2), (2, 1, 0, 0, 0, 9)]
    runs = territory.contour_cells(spark.createDataFrame(rows, COLUMNS)).collect()
    cells = [(r.site_id, r.piece, x, r.iy) for r in runs for x in range(r.a, r.b + 1)]
    assert len(cells) == len(set(cells))
    assert set(cells) == {(s, p, x, y) for s, p, x0, y0, xm, ym in rows for x in range(x0, xm) for y in range(y0, ym)}
    assert len(runs) == 8 * 6 + 1 + 2


def test_duplicates_and_fold_equal_those_of_cell_sets(spark):
    draw, rows = random.Random(5), []
    for site in range(6):
        for piece in range(7):
            x0, y0 = draw.randrange(-90, 90), draw.randrange(0, 6)
            rows.append((site, piece, x0, y0, x0 + draw.randrange(1, 150), y0 + draw.randrange(1, 12)))
        rows.append((site, 7, *rows[-1][2:]))
    sets = {(s, p): {(x, y) for x in range(x0, xm) for y in range(y0, ym)} for s, p, x0, y0, xm, ym in rows}
    cells = territory.contour_cells(spark.createDataFrame(rows, COLUMNS))
    groups = {(r.site_id, r.piece): r.group_piece for r in territory.near_duplicates(cells).collect()}
    areas = {r.site_id: r.area_m2 for r in territory.combine(cells).collect()}
    for site in range(6):
        own = {p: cell for (s, p), cell in sets.items() if s == site}
        least = {p: min(q for q in own if q == p or min(len(own[p] & own[q]) / len(own[p]), len(own[p] & own[q]) / len(own[q])) > 0.99) for p in own}
        assert {p: groups[site, p] for p in own} == least and least[7] == 6
        fold: set = set()
        order = sorted(own, key=lambda p: (-len(own[p]), p))
        for k, p in enumerate(order):
            depth = sum(100 * len(own[p] & own[q]) > 99 * len(own[p]) for q in order[:k])
            fold = fold - own[p] if depth % 2 else fold | own[p]
        assert areas.get(site, 0) == len(fold)
