"""Exact top-k and vector codes against brute force, on odd tables too."""

import hashlib
import math
import random

import numpy as np
import pytest

from sitefit.llm import exact_topk, vector_codes
from sitefit.llm.exact_topk import top_k
from sitefit.llm.vector_codes import codes, hilbert_keys, nearest, shortlists

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score long, copy int"


def fine(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def whole(rows, scale):
    held = 1 << 26
    return [(i, [max(-held, min(held, math.floor(scale * float(np.float32(x))))) for x in v], label) for i, v, label in fine(rows)]


def brute_top(rows, k=5, scale=256, every=50):
    rows, out = whole(rows, scale), []
    for q, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), math.inf if j is None else j) for p, (j, w, _) in enumerate(rows) if p != q)
            out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def brute_codes(rows, scale=1024):
    rows = whole(rows, scale)
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 4) * 4
    rows = [(i, v + [0] * (width - len(v)), label) for i, v, label in rows]
    d = width // 4
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[r[1][k * d : k * d + d] for r in start] for k in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda r, k: min((far(r[1][k * d : k * d + d], e), i) for i, e in enumerate(books[k]))
    for _ in range(4):
        for k in range(4):
            own = {}
            for r in rows:
                own.setdefault(place(r, k)[1], []).append(r[1][k * d : k * d + d])
            for i, points in own.items():
                books[k][i] = [sum(x) // len(points) for x in zip(*points, strict=True)]
    out = [(i, [place(r, k) for k in range(4)], label) for r in rows for i, label in [(r[0], r[2])]]
    total = {}
    for _, p, label in out:
        total[label] = total.get(label, 0) + sum(x for x, _ in p)
    sha = hashlib.sha256(",".join(str(x) for k in range(4) for e in books[k] for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for _, e in p), sum(x for x, _ in p), total[label], sha) for i, p, label in out], key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def listed(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(5)
    some = lambda n: [rng.gauss(0, 0.3) for _ in range(n)]
    hot = some(8)
    rows = [(i, some(8), i % 3) for i in range(1, 330)] + [(i, hot, None) for i in range(330, 520)]
    rows += [(50, hot, 1), (50, hot, 1), (100, some(8), 2), (100, some(8), 2), (None, hot, 0), (None, some(8), None), (-50, some(8), 5), (0, some(8), 5)]
    rows += [(600, None, 1), (650, [], 1), (700, [0.1, None] * 4, 1), (750, [math.nan] * 8, 1), (800, [math.inf] * 8, 1), (850, some(3), 1), (900, some(11), 1), (950, [3e9, -3e9] + [0.5] * 6, 1), (1000, [0.0] * 8, 1)]
    return rows


def test_top_k_equals_brute_force(spark, odd_vectors):
    assert listed(top_k(frame(spark, odd_vectors))) == brute_top(odd_vectors)


def test_top_k_with_many_groups_and_blocks(spark, odd_vectors, monkeypatch):
    for name, value in (("GROUP_ROWS", 64), ("QUERY_ROWS", 2), ("READ", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(exact_topk, name, value)
    assert listed(top_k(frame(spark, odd_vectors), k=3, every=25)) == brute_top(odd_vectors, k=3, every=25)


def test_top_k_of_few_and_no_rows(spark):
    assert listed(top_k(frame(spark, []))) == []
    few = [(50, [1.0, 2.0], 1), (51, [0.5, 0.5], 1)]
    assert listed(top_k(frame(spark, few))) == brute_top(few)
    assert listed(top_k(frame(spark, few[:1]))) == []


def test_codes_equal_brute_force(spark, odd_vectors):
    assert listed(codes(frame(spark, odd_vectors))) == brute_codes(odd_vectors)


def test_codes_of_few_and_no_rows(spark):
    assert listed(codes(frame(spark, []))) == []
    few = [(5, [1.0, 2.0], 1), (3, [0.5, 0.5], 1), (3, [0.5, 0.5], None), (None, [], None)]
    assert listed(codes(frame(spark, few))) == brute_codes(few)
    assert listed(codes(frame(spark, [(1, [], 1)]))) == brute_codes([(1, [], 1)])


def test_label_totals_beyond_the_broadcast(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    assert listed(codes(frame(spark, odd_vectors))) == brute_codes(odd_vectors)


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(3)
    for spread in (1, 30, 1000):
        points, entries = rng.integers(-spread, spread, (64, 5)), rng.integers(-1000, 1000, (40, 5))
        kept = np.flatnonzero(shortlists(points.min(axis=0)[None], points.max(axis=0)[None], entries)[0])
        assert np.array_equal(kept[nearest(points, entries[kept])[0]], nearest(points, entries)[0])
    assert len(kept) <= 40


def test_large_numbers_take_the_integer_kernel():
    points, entries = np.array([[1 << 26, -(1 << 26)]]), np.array([[-(1 << 26), 1 << 26], [(1 << 26) - 1, -(1 << 26)]])
    at, far = nearest(points, entries)
    assert at.tolist() == [1] and far.tolist() == [1]


def test_hilbert_keys_visit_each_cell_once_in_steps_of_one():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
