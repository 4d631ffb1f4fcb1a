"""The planar map against a sequential walk in exact fractions."""

import random
from fractions import Fraction
from math import atan2, floor

import pytest

from sitefit.operators.lists import ranked_lists, running
from sitefit.operators.planar import footprints, planar_map, polygons, road_loops

LINE = "site_id long, object_type string, x1 double, y1 double, x2 double, y2 double"


def cuts_of(segments):
    """Each segment's nodes, with exact crossings."""
    side = lambda a, b, d: (b[0] - a[0]) * (d[1] - a[1]) - (b[1] - a[1]) * (d[0] - a[0])
    between = lambda a, b, d: side(a, b, d) == 0 and min(a[0], b[0]) <= d[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= d[1] <= max(a[1], b[1])
    nodes = {s: {s[0], s[1]} for s in segments}
    for s in segments:
        for t in segments:
            if s == t:
                continue
            (p, q), (r, v) = s, t
            nodes[s] |= {d for d in t if between(p, q, d)}
            a, b, d, e = side(p, q, r), side(p, q, v), side(r, v, p), side(r, v, q)
            if a * b < 0 and d * e < 0:
                f = Fraction(d, d - e)
                nodes[s].add((p[0] + (q[0] - p[0]) * f, p[1] + (q[1] - p[1]) * f))
    return nodes


def walked(lines, grid=1.0):
    """Rings (area, points), and pieces that close nothing, by pruning and walking one by one."""
    snap = lambda v: floor(v / grid + 0.5)
    segments = {tuple(sorted([(snap(a), snap(b)), (snap(c), snap(d))])) for a, b, c, d in lines}
    segments = {s for s in segments if s[0] != s[1]}
    pieces = set()
    for (p, q), found in cuts_of(segments).items():
        along = sorted(found, key=lambda d: (d[0] - p[0]) * (q[0] - p[0]) + (d[1] - p[1]) * (q[1] - p[1]))
        pieces |= {tuple(sorted(x)) for x in zip(along, along[1:], strict=False)}
    fine = lambda d: tuple(floor(v * 100 + Fraction(1, 2)) for v in d)
    pieces = {tuple(sorted([fine(a), fine(b)])) for a, b in pieces}
    pieces = {(a, b) for a, b in pieces if a != b}

    def faces(edges):
        out = {}
        for a, b in edges:
            out.setdefault(a, []).append(b)
            out.setdefault(b, []).append(a)
        for a, found in out.items():
            found.sort(key=lambda b: atan2(b[1] - a[1], b[0] - a[0]))
        seen, cycles = set(), []
        for start in [(a, b) for a in out for b in out[a]]:
            cycle, (a, b) = [], start
            while (a, b) not in seen:
                seen.add((a, b))
                cycle.append((a, b))
                turn = out[b]
                a, b = b, turn[turn.index(a) - 1]
            if cycle:
                cycles.append(cycle)
        return cycles

    left, dangles = set(pieces), set()
    while True:  # prune one end after another
        degree = {}
        for e in left:
            for d in e:
                degree[d] = degree.get(d, 0) + 1
        ends = {e for e in left if degree[e[0]] == 1 or degree[e[1]] == 1}
        if not ends:
            break
        left -= ends
        dangles |= ends
    side = {h: i for i, cycle in enumerate(faces(left)) for h in cycle}
    cuts = {(a, b) for a, b in left if side[a, b] == side[b, a]}
    rings = []
    for cycle in faces(left - cuts):
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in cycle)
        if area > 0:
            rings.append((area, len(cycle), min(a for a, _ in cycle)))
    return sorted(rings), dangles, cuts


def found(spark, lines, grid=1.0):
    out = planar_map(spark.createDataFrame([(3, "kerb", *map(float, r)) for r in lines], LINE), grid)
    shells = out.rings.filter("ring = shell").collect()
    by = {}
    for r in shells:
        by.setdefault(r.ring, []).append(r)
    rings = sorted((sum(r.x1 * r.y2 - r.x2 * r.y1 for r in own), len(own), min((r.x1, r.y1) for r in own)) for own in by.values())
    for own in by.values():  # in order, closed
        own.sort(key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(len(own)))
        assert all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(own, own[1:] + own[:1], strict=True))
    kinds = {"dangle": set(), "cut": set()}
    for r in out.leftovers.collect():
        kinds[r.kind].add(((r.x1, r.y1), (r.x2, r.y2)))
    return rings, kinds["dangle"], kinds["cut"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_networks_equal_a_sequential_walk(spark, seed):
    rng = random.Random(seed)
    lines = [[rng.randrange(40) for _ in range(4)] for _ in range(22)]
    lines += [(5, 0, 5, 30), (5, 10, 5, 40), (0, 20, 30, 20), (10, 20, 40, 20), (10, 20, 40, 20)]  # overlaps and a copy
    assert found(spark, lines) == walked(lines)


def test_cuts_dangles_and_a_lone_tree(spark):
    square = lambda x, y, s: [(x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y)]
    lines = square(0, 0, 10) + square(30, 0, 10) + [(10, 5, 20, 5), (20, 5, 30, 5), (20, 5, 20, 9), (40, 10, 50, 20), (100, 100, 110, 100), (110, 100, 110, 105)]
    rings, dangles, cuts = found(spark, lines)
    assert (rings, dangles, cuts) == walked(lines)
    assert len(rings) == 2 and len(cuts) == 2 and len(dangles) == 4


def test_holes_belong_to_the_smallest_shell(spark):
    square = lambda x, s: [(x, x, x + s, x), (x + s, x, x + s, x + s), (x + s, x + s, x, x + s), (x, x + s, x, x)]
    lines = square(0, 100) + square(10, 60) + square(20, 10) + square(40, 5)
    df = spark.createDataFrame([(0, "building", *map(float, r)) for r in lines], LINE)
    assert sorted((r.area_m2, r.holes) for r in polygons(planar_map(df, 0.05)).collect()) == [(25.0, 0), (100.0, 0), (3475.0, 2), (6400.0, 1)]


EDGE = "site_id long, object_type string, gid long, geom_kind string, seq int, x1 double, y1 double, x2 double, y2 double"


def run(gid, points, kind="line"):
    return [(0, "building", gid, kind, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(points, points[1:], strict=False))]


def test_footprints(spark):
    """An outline and its closing line, an almost closed one, an open one, a stub, a polygon as drawn."""
    rows = run(1, [(0, 0), (10, 0), (10, 10), (0, 10)]) + run(2, [(0, 10), (0, 0)]) + run(3, [(20, 0), (25, 0), (25, 5), (20, 5), (20.01, 0.01)])
    rows += run(4, [(40, 0), (50, 0), (50, 10), (40, 10)]) + run(5, [(70, 70), (75, 70)]) + run(6, [(80, 0), (90, 0), (90, 10), (80, 0)], "polygon")
    out = footprints(spark.createDataFrame(rows, EDGE), 0.05, 0.3).collect()
    area = {}
    for r in out:
        if r.source == "closed":
            area[r.gid] = area.get(r.gid, 0) + r.x1 * r.y2 - r.x2 * r.y1
    assert sorted(round(a / 2, 6) for a in area.values()) == [25.0, 100.0]
    assert sum(r.source == "drawn" for r in out) == 3
    assert sum(r.source == "leftover" and r.inflate_m == 0.3 for r in out) == 4
    assert not footprints(spark.createDataFrame(rows, EDGE), 2.0, 0.0).filter("source = 'leftover'").count()


def test_road_loops_are_added(spark):
    rows = run(1, [(0, 0), (10, 0)]) + run(2, [(10, 0), (10, 10)]) + run(3, [(10, 10), (0, 10)]) + run(4, [(0, 10), (0, 0)]) + run(5, [(10, 10), (60, 60)])
    out = road_loops(spark.createDataFrame(rows, EDGE)).collect()
    assert sum(not r.reconstructed_loop for r in out) == 5
    assert sum(r.x1 * r.y2 - r.x2 * r.y1 for r in out if r.reconstructed_loop) / 2 == pytest.approx(100.0)


def test_nothing_in_nothing_out(spark):
    out = planar_map(spark.createDataFrame([(0, "kerb", 1.0, 1.0, 1.0, 1.0), (0, "kerb", None, 1.0, 1.0, 1.0)], LINE), 0.1)
    assert out.rings.isEmpty() and out.leftovers.isEmpty()


def test_ranked_lists_and_running_sums(spark):
    rng = random.Random(4)
    ids = list(range(300))
    rng.shuffle(ids)
    rows, want = [], {}
    for size, closed in ((1, False), (1, True), (2, True), (37, False), (64, True), (100, False), (95, True)):
        own, ids = ids[:size], ids[size:]
        start = own.index(min(own)) if closed else 0
        for i, x in enumerate(own):
            rows.append((0, x, own[i - 1] if i or closed else None))
            want[x] = (own[start], (i - start) % size)
    got = ranked_lists(spark.createDataFrame(rows, "site_id long, id long, prev long"))
    assert {r.id: (r.label, r.pos) for r in got.collect()} == want
    from pyspark.sql import functions as F

    from sitefit.operators import lists
    lists.STRETCH, old = 8, lists.STRETCH
    sums = {r.id: r.total for r in running(got, ["site_id", "label"], F.col("id"), "total").collect()}
    lists.STRETCH = old
    assert sums == {x: sum(y for y, (m, p) in want.items() if m == label and p < pos) for x, (label, pos) in want.items()}
