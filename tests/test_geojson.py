"""GeoJSON files of all kinds of geometry, damaged files, degrees and metres."""

import json

import pytest

from sitefit.sources.geojson import edges_of, in_metres, read_files, typed

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [1.0, 1.0]]
GEOMETRIES = {
    "Point": [7.5, 8], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[0, 0], [1, 1], [2, 0]], "MultiLineString": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]],
    "Polygon": [SQUARE, HOLE], "MultiPolygon": [[SQUARE, HOLE], [[[10, 10], [12, 10], [12, 12], [10, 10]]]],
}
EDGES = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 7, "MultiPolygon": 10}


def feature(kind, coordinates, **props):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.fixture
def folder(tmp_path):
    features = [feature(k, v, what="gas_pipe" if k == "LineString" else "pit", height=3.5 if k == "Point" else None, note="NaN") for k, v in GEOMETRIES.items()]
    nested = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0, 0], [3, 3]]}]}]}
    features += [{"type": "Feature", "properties": None, "geometry": nested}, {"type": "Feature", "properties": {}, "geometry": None}, feature("Polygon", []), feature("LineString", [])]
    (tmp_path / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "one.geojson").write_text(json.dumps(feature("Point", [5, 6], what="lamp")))
    (tmp_path / "torn.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features})[:300])
    return tmp_path


def test_every_kind_of_geometry(spark, folder):
    features, report = read_files(spark, str(folder))
    found = typed(features, "what", {"pit": "well"}).cache()
    rows = [r for r in found.collect() if r.file.endswith("all.geojson")]
    assert sorted((r.geom_type, r.member) for r in rows) == sorted([(k, "") for k in GEOMETRIES] + [("Point", "/0"), ("LineString", "/1/0")])
    by = {r.geom_type: r for r in rows if not r.member}
    assert {k: (r.kind, r.object_type) for k, r in by.items()} == {k: ("utility", "gas_pipe") if k == "LineString" else ("zone", "well") for k in GEOMETRIES}
    assert by["Point"].attrs == {"height": "3.5"} and by["Polygon"].attrs == {}
    assert all(r.object_type == "unknown" for r in rows if r.member)
    counts = {(r.ord, r.member): r["count"] for r in edges_of(found, "file", "ord", "member").filter("file LIKE '%all.geojson'").groupBy("ord", "member").count().collect()}
    assert counts == {(i, ""): EDGES[k] for i, k in enumerate(GEOMETRIES)} | {(6, "/0"): 1, (6, "/1/0"): 1}
    assert {r.file.rsplit("/", 1)[1]: (r.features, r.damaged) for r in report.collect()} == {"all.geojson": (10, 0), "one.geojson": (1, 0), "torn.geojson": (0, 1)}


def test_rings_and_parts_keep_their_places(spark, folder):
    found = typed(read_files(spark, str(folder / "all.geojson"))[0], "what", {}).filter("geom_type = 'MultiPolygon'")
    rows = sorted(tuple(r) for r in edges_of(found).collect())
    want = [(p, r, i, *map(float, (*a, *b))) for p, rings in enumerate(GEOMETRIES["MultiPolygon"]) for r, ring in enumerate(rings) for i, (a, b) in enumerate(zip(ring, ring[1:], strict=False))]
    assert rows == want


def test_lines_with_damage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(feature("Point", [i, i])) for i in range(5)) + '\n{"type": "Feat')
    features, report = read_files(spark, str(tmp_path), lines=True)
    assert features.count() == 5 and [(r.features, r.damaged) for r in report.collect()] == [(5, 1)]


def test_degrees_become_metres_and_metres_stay(spark, tmp_path):
    (tmp_path / "deg.geojson").write_text(json.dumps(feature("LineString", [[37.6, 55.75], [37.61, 55.76]])))
    (tmp_path / "m.geojson").write_text(json.dumps(feature("LineString", [[414312.85, 6180532.32], [414952.85, 6180532.32]])))
    rows = {r.file.rsplit("/", 1)[1]: r for r in in_metres(edges_of(typed(read_files(spark, str(tmp_path))[0], "what", {}), "file")).collect()}
    assert (rows["m.geojson"].zone, rows["m.geojson"].x1, rows["m.geojson"].y2) == (None, 414312.85, 6180532.32)
    assert rows["deg.geojson"].zone == 37 and abs(rows["deg.geojson"].x1 - 412120) < 500 and abs(rows["deg.geojson"].y1 - 6179000) < 1500
