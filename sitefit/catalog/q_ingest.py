"""Ingest and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_compliance  # noqa: F401
from sitefit.catalog.q_scalars import SCHEME
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cte, lit, rnd, sql
from sitefit.operators import compliance as co
from sitefit.session import scratch_folder, stored
from sitefit.sources import geojson as gj
from sitefit.sources import ingest as ig
from sitefit.sources import sinks

UTIL = ", ".join(lit(u) for u in fx.UTILITY_TYPES)


@query("geojson_features", sql(f"""SELECT f.site_id, f.gid, CASE WHEN m.object_type IN ({UTIL}) THEN 'utility' ELSE 'zone' END AS kind, m.object_type,
    CASE f.geom_kind WHEN 'point' THEN 'Point' WHEN 'line' THEN 'LineString' ELSE 'Polygon' END AS geom_type, e.n AS points, 1 + (f.zoning IS NOT NULL)::BIGINT AS attrs
  FROM features f JOIN (SELECT site_id, gid, CASE object_type WHEN 'steam_pipe' THEN 'heat_network' WHEN 'zoning' THEN 'unknown' ELSE object_type END AS object_type FROM features) m USING (site_id, gid)
  JOIN (SELECT site_id, gid, count(*)::BIGINT AS n FROM edges GROUP BY ALL) e USING (site_id, gid)"""))
def geojson_features(t):
    """Feature texts of points, lines and rings parsed back into typed features; ``points`` counts their edges."""
    # looked through for collections and then parsed: the texts are put together once
    found = gj.typed(gj.from_texts(stored(_feature_texts(t))), "what", {"steam_pipe": "heat_network"})
    return found.select("site_id", "gid", "kind", "object_type", "geom_type", gj.edge_count(F.col("parts")).alias("points"), F.size("attrs").cast("long").alias("attrs"))


def _feature_texts(t):
    """Every feature as a GeoJSON text with its coordinates nested as its kind wants them."""
    c = F.col
    at = t.edges.groupBy("site_id", "gid").agg(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias("e"))
    way = F.concat(F.transform("e", lambda p: F.array(p["x1"], p["y1"])), F.array(F.array(F.element_at("e", -1)["x2"], F.element_at("e", -1)["y2"])))
    coordinates = F.when(c("geom_kind") == "point", F.to_json(way[0])).when(c("geom_kind") == "line", F.to_json(way)).otherwise(F.to_json(F.array(way)))
    kind = F.when(c("geom_kind") == "point", "Point").when(c("geom_kind") == "line", "LineString").otherwise("Polygon")
    props = F.to_json(F.struct(F.when(c("object_type") != "zoning", c("object_type")).alias("what"), c("zoning").alias("category"), F.lit("NaN").alias("height"), c("kind").alias("source")))
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))
    return t.features.join(at, ["site_id", "gid"]).select("site_id", "gid", text.alias("feature"))


@query("feature_edges", sql("SELECT site_id, gid, seq, x1, y1, x2, y2 FROM edges WHERE geom_kind = 'polygon'"))
def feature_edges(t):
    """Ring vertices to two-point edges."""
    v = t.edges.filter("geom_kind = 'polygon'").select("site_id", "gid", "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return ig.to_edges(v, True)


@query("expand_blocks", sql("SELECT k, dx, dy, depth FROM tree", """tree AS (SELECT p_partkey::BIGINT AS k, p_partkey * 7 % 101 AS dx, p_partkey * 11 % 103 AS dy, 0::BIGINT AS depth FROM part WHERE p_partkey < 3
  UNION ALL SELECT c.p_partkey, t.dx + c.p_partkey * 7 % 101, t.dy + c.p_partkey * 11 % 103, t.depth + 1 FROM tree t JOIN part c ON c.p_partkey // 3 = t.k AND c.p_partkey >= 3)"""))
def expand_blocks(t):
    """Nested block references with accumulated offsets."""
    p = t.part.selectExpr("cast(p_partkey as bigint) as k", "case when p_partkey >= 3 then cast(p_partkey div 3 as bigint) end as parent",
                          "cast(p_partkey * 7 % 101 as bigint) as dx", "cast(p_partkey * 11 % 103 as bigint) as dy")
    return ig.expand_blocks(p)


@query("flatten_arcs", sql(f"""SELECT id, seq, {rnd('cx + r * cos(radians(a0 + sweep * (seq / n)))', 6)} AS x, {rnd('cy + r * sin(radians(a0 + sweep * (seq / n)))', 6)} AS y FROM (
    SELECT *, unnest(range(n + 1)) AS seq FROM (SELECT *, greatest(1, CAST(ceil(radians(sweep) / (acos(1e0 - least(0.2e0, r) / r) * 2e0)) AS BIGINT)) AS n FROM (
      SELECT o_orderkey AS id, (o_orderkey % 400)::DOUBLE AS cx, (o_orderkey % 300)::DOUBLE AS cy, 1e0 + o_orderkey % 20 AS r, (o_orderkey % 360)::DOUBLE AS a0, 20e0 + o_orderkey % 270 AS sweep FROM orders) a) b) c"""))
def flatten_arcs(t):
    """Arcs as polylines with a sagitta of 0.2 m."""
    arcs = t.orders.selectExpr("o_orderkey as id", "cast(o_orderkey % 400 as double) as cx", "cast(o_orderkey % 300 as double) as cy", "1e0 + o_orderkey % 20 as r",
                               "cast(o_orderkey % 360 as double) as a0", "20e0 + o_orderkey % 270 as sweep")
    return ig.flatten_arcs(arcs)


@query("infer_closed", sql("SELECT site_id, gid FROM edges WHERE geom_kind = 'polygon' AND seq = 0 AND gid % 5 <= 2 AND ((gid - 1) // 2) % 40 <> 11"))
def infer_closed(t):
    """Polylines that almost close become areas unless they cross themselves."""
    c = F.col
    ring = t.edges.filter("geom_kind = 'polygon'")
    shifted = ring.filter("seq = 0").select("site_id", "gid", F.lit(4).cast("long").alias("seq"), (c("x1") + (c("gid") % 5) * 0.02).alias("x"), c("y1").alias("y"))
    v = ring.select("site_id", "gid", "seq", c("x1").alias("x"), c("y1").alias("y")).unionByName(shifted)
    return ig.infer_closed(v)


LOOPS = """SELECT s_suppkey {div} 4 AS fill, s_suppkey AS loop, (s_suppkey * 37) % 40 AS lx, (s_suppkey * 53) % 40 AS ly, (s_suppkey * 37) % 40 + 10 + (s_suppkey * 91) % 70 AS hx,
  (s_suppkey * 53) % 40 + 10 + (s_suppkey * 67) % 70 AS hy FROM {t}"""
cte("fill_loops", LOOPS.format(div="//", t="supplier"))


@query("hatch_loops", sql("""SELECT l.fill, l.loop, CASE WHEN l.loop = o.loop THEN 'exterior' WHEN l.lx >= o.lx AND l.hx <= o.hx AND l.ly >= o.ly AND l.hy <= o.hy THEN 'hole' ELSE 'separate' END AS role
  FROM fill_loops l JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fill ORDER BY (hx - lx) * (hy - ly) DESC, loop) AS r FROM fill_loops) z WHERE r = 1) o USING (fill)"""))
def hatch_loops(t):
    """Exterior, holes and separate parts of every fill."""
    return ig.hatch_loops(t.spark.sql(LOOPS.format(div="div", t="{supplier}"), supplier=t.supplier))


@query("bundle_union", sql("""SELECT x.sheet, coalesce(n, 0)::BIGINT AS entities, coalesce(d, 0)::BIGINT AS damaged, CASE WHEN coalesce(n, 0) = 0 THEN 'lost' ELSE 'read' END AS status
  FROM (SELECT concat('sheet', r_regionkey * 5 + k) AS sheet FROM region, range(5) q(k)) x LEFT JOIN (SELECT concat('sheet', gid % 23) AS sheet, count(*) FILTER (gid % 23 % 6 <> 5 AND gid % 7 <> 3) AS n,
    count(*) FILTER (gid % 23 % 6 = 5 OR gid % 7 = 3) AS d FROM features GROUP BY ALL) f USING (sheet)"""))
def bundle_union(t):
    """Sheets written as files, some of them damaged in whole or in part, read as one; counts by sheet and the lost ones."""
    number = F.col("gid") % 23
    torn = (number % 6 == 5) | (F.col("gid") % 7 == 3)
    text = F.when(torn, F.substring("feature", 1, 40)).otherwise(F.col("feature"))
    folder = f"{scratch_folder(t.spark)}/bundle-{uuid.uuid4().hex}"
    _feature_texts(t).select(text.alias("value"), F.concat(F.lit("sheet"), number.cast("string")).alias("sheet")).repartition("sheet").write.partitionBy("sheet").text(folder)
    report = gj.read_files(t.spark, folder, lines=True)[1].withColumn("sheet", F.regexp_extract("file", "/sheet=([^/]+)/", 1))
    expected = t.region.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.concat(F.lit("sheet"), (F.col("r_regionkey") * 5 + F.col("k")).cast("string")).alias("sheet"))
    return ig.bundle_report(report, expected)


@query("pick_base_sheet", sql("""SELECT site_id, CASE WHEN max(n) FILTER (sheet = 'sheet0') >= 8 THEN 'sheet0' ELSE arg_max(sheet, (n, sheet)) END AS sheet
  FROM (SELECT site_id, sheet, count(*)::BIGINT AS n FROM layer_names GROUP BY ALL) q GROUP BY ALL"""))
def pick_base_sheet(t):
    """Base sheet of every site."""
    return ig.pick_base_sheet(t.layer_names, "sheet0", 8)


@query("write_trace", sql("SELECT site_id, item_id, object_type, required_m, is_binding, act, table_row FROM trace_rows"))
def write_trace(t):
    """Trace written as semicolon-separated text and read back."""
    k = stored(co.all_checks(t.items, t.edges))
    return sinks.trace_csv(co.trace(t.items, k, co.verdicts(t.items, k)), t.spark).select("site_id", "item_id", "object_type", "required_m", "is_binding", F.coalesce("act", F.lit("")).alias("act"), F.coalesce("table_row", F.lit("")).alias("table_row"))


@query("write_report", sql("""SELECT 'item' AS part, v.site_id, v.item_id, NULL::VARCHAR AS key, NULL::VARCHAR AS text, v.compliant, v.binding, count(k.object_type)::BIGINT AS checks
    FROM verdict_rows v LEFT JOIN check_rows k USING (site_id, item_id) GROUP BY ALL
  UNION ALL SELECT 'source', NULL, NULL, s.source_id, concat_ws(' / ', s.act, s.clause, s.title), NULL, NULL, s.n FROM (
    SELECT k.source_id, k.act, k.clause, coalesce(d.title, 'Тип объекта не сопоставлен ни с одним пунктом') AS title, count(*)::BIGINT AS n
    FROM check_rows k LEFT JOIN d_sources d ON d.source_id = k.source_id GROUP BY ALL) s
  UNION ALL SELECT 'row', NULL, NULL, concat_ws('|', source_id, object_type, planting_type) AS key, min(table_row), NULL, NULL, NULL FROM check_rows WHERE table_row <> '' GROUP BY ALL
  UNION ALL SELECT 'unverified', NULL, NULL, k.citation, NULL, NULL, NULL, count(*)::BIGINT FROM verdict_rows v JOIN check_rows k
    ON k.site_id = v.site_id AND k.item_id = v.item_id AND k.object_type = v.binding WHERE NOT k.verified GROUP BY k.citation
  UNION ALL SELECT 'total', NULL, NULL, t.key, NULL, NULL, NULL, t.n FROM (SELECT unnest(['total_items', 'compliant_items', 'violations']) AS key,
    unnest([count(*)::BIGINT, count(*) FILTER (compliant)::BIGINT, (count(*) - count(*) FILTER (compliant))::BIGINT]) AS n FROM verdict_rows) t"""))
def write_report(t):
    """The whole report written as JSON and read back: items with their checks, sources, table rows, unverified citations, totals."""
    k = stored(co.all_checks(t.items, t.edges))
    back = sinks.report_json(co.report_parts(co.verdicts(t.items, k), k), t.spark)
    return back.select("part", "site_id", "item_id", "key", "text", "compliant", "binding", F.col("n").alias("checks"))


@query("write_layers", sql("""SELECT layer, count(*)::BIGINT AS items FROM (SELECT concat('result_', planting_type) AS layer FROM items UNION ALL SELECT 'violations' FROM mask_rows WHERE violates) q GROUP BY ALL"""))
def write_layers(t):
    """One result layer per planting type, and a violations layer if there are any."""
    return sinks.result_layers(t.items, co.violation_mask(t.items, co.setback_checks(t.items, t.edges)), t.spark).groupBy("layer").agg(F.count(F.lit(1)).alias("items"))


@query("feature_collection", sql(f"""SELECT i.site_id, i.item_id, i.planting_type, i.species, CASE WHEN i.planting_type = 'tree' THEN s.crown END AS crown, {SCHEME} AS scheme, i.score
  FROM items i LEFT JOIN d_species s ON s.name = i.species"""))
def feature_collection(t):
    """Placements as GeoJSON features; properties read back from the text."""
    g = lambda k: F.get_json_object("feature", f"$.properties.{k}")
    return ig.feature_texts(t.items).select("site_id", "item_id", g("planting_type").alias("planting_type"), g("species").alias("species"), g("crown").alias("crown"),
                                            g("scheme").alias("scheme"), g("score").cast("double").alias("score"))


@query("reference_points", sql("""SELECT DISTINCT n.site_id, round(a.cx / 100e0, 2) AS x, round(a.cy / 100e0, 2) AS y FROM layer_names n JOIN area_features a ON a.k = n.k
  WHERE regexp_matches(lower(string_split(n.layer, '|')[-1]), CASE n.site_id % 2 WHEN 0 THEN 'дерев|посадка' ELSE 'дендра|дерево' END)"""))
def reference_points(t):
    """Designers' trees: inserts on layers that match the site's pattern."""
    c = F.col
    manifest = t.sites.select("site_id", F.when(c("site_id") % 2 == 0, "дерев|посадка").otherwise("дендра|дерево").alias("pattern"))
    rows = t.layer_names.join(manifest, "site_id").filter(F.expr("lower(substring_index(layer, '|', -1)) rlike pattern"))
    return rows.join(t.area_features.select("k", "cx", "cy"), "k").select("site_id", F.round(c("cx") / 100.0, 2).alias("x"), F.round(c("cy") / 100.0, 2).alias("y")).distinct()
