"""Edit log, row editing, repairs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog import q_compliance, q_scalars  # noqa: F401
from sitefit.catalog.q_rules import resolve_sql
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cross, cte, cte_over, dist, lit, seg, sql
from sitefit.operators import compliance as co
from sitefit.plans import edits as ed
from sitefit.plans import fixes as fi
from sitefit.session import stored
from sitefit.streaming import live

cte("edit_life", """SELECT e.*, i.site_id, i.planting_type, i.xc, i.yc, i.species AS base_species, coalesce(last_value(CASE WHEN op IN ('delete','restore') THEN op END IGNORE NULLS)
    OVER (PARTITION BY e.item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'restore') = 'restore' AS alive FROM edits e JOIN items i USING (item_id)""")
cte("edit_ok", """SELECT *, CASE WHEN op = 'restore' THEN NOT alive WHEN op = 'retype' THEN alive AND (planting_type = 'lawn') = (new_type = 'lawn') ELSE alive END AS ok FROM edit_life""")
FOLD = """SELECT i.site_id, i.item_id, coalesce(s.last_type, i.planting_type) AS planting_type, coalesce(s.last_species, i.species) AS species, (i.xc + coalesce(s.dxc, 0)) / 100e0 AS x,
    (i.yc + coalesce(s.dyc, 0)) / 100e0 AS y, coalesce(s.life, 'restore') = 'restore' AS alive, i.is_manual_edit OR coalesce(s.touched, FALSE) AS is_manual_edit, coalesce(s.edits, 0)::BIGINT AS edits
  FROM items i LEFT JOIN (SELECT item_id, sum(dxc) FILTER (ok AND op = 'move')::BIGINT AS dxc, sum(dyc) FILTER (ok AND op = 'move')::BIGINT AS dyc, arg_max(new_type, (ts, seq)) FILTER (ok AND op = 'retype') AS last_type,
    arg_max(new_species, (ts, seq)) FILTER (ok AND op = 'patch') AS last_species, arg_max(op, (ts, seq)) FILTER (ok AND op IN ('delete','restore')) AS life,
    bool_or(ok AND op IN ('move','retype','patch')) AS touched, count(*) FILTER (ok) AS edits FROM edit_ok GROUP BY ALL) s USING (item_id)"""


@query("edit_fold", sql(FOLD))
def edit_fold(t):
    """Current items after the whole edit log."""
    return ed.edit_fold(t.edits, t.items)


@query("edit_guards", sql(f"""SELECT batch_id, edits, unknown, present, outside, skipped, unknown + present + outside = 0 AS accepted FROM (
  SELECT e.batch_id, count(*)::BIGINT AS edits, count(*) FILTER (i.item_id IS NULL)::BIGINT AS unknown, count(*) FILTER (e.op = 'restore' AND i.item_id IS NOT NULL)::BIGINT AS present,
    count(*) FILTER (e.op = 'move' AND i.item_id IS NOT NULL AND h.seq IS NULL)::BIGINT AS outside, count(*) FILTER (e.op = 'retype' AND (i.planting_type = 'lawn') <> (e.new_type = 'lawn'))::BIGINT AS skipped
  FROM edits e LEFT JOIN items i USING (item_id) LEFT JOIN (SELECT p.seq FROM (SELECT e.seq, i.site_id, (i.xc + e.dxc) / 100e0 AS x, (i.yc + e.dyc) / 100e0 AS y FROM edits e JOIN items i USING (item_id) WHERE e.op = 'move') p
    JOIN outline e USING (site_id) GROUP BY p.seq HAVING count(*) FILTER ({cross('p.x', 'p.y')}) % 2 = 1) h ON h.seq = e.seq GROUP BY e.batch_id) q"""))
def edit_guards(t):
    """Which batches of edits are accepted."""
    return ed.edit_guards(t.edits, t.items, t.outline)


@query("edit_inverse", sql("""SELECT seq, item_id, op, (xc + coalesce(sum(CASE WHEN op = 'move' THEN dxc ELSE 0 END) OVER w, 0)::BIGINT) / 100e0 AS x, (yc + coalesce(sum(CASE WHEN op = 'move' THEN dyc ELSE 0 END) OVER w, 0)::BIGINT) / 100e0 AS y,
    coalesce(last_value(CASE WHEN op = 'retype' THEN new_type END IGNORE NULLS) OVER w, planting_type) AS planting_type, coalesce(last_value(CASE WHEN op = 'patch' THEN new_species END IGNORE NULLS) OVER w, base_species) AS species
  FROM edit_ok WHERE ok WINDOW w AS (PARTITION BY item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def edit_inverse(t):
    """Undo snapshot of every effective edit."""
    return ed.edit_inverse(t.edits, t.items)


cte("row_lists", """SELECT site_id, group_id, count(*) AS n, sum(xc)::BIGINT AS sx, sum(yc)::BIGINT AS sy, list({'id': item_id, 'x': xc, 'y': yc} ORDER BY item_id) AS members FROM items WHERE group_id LIKE '%-row-%' GROUP BY ALL""")
WALK = """walk(site_id, group_id, k, path, rest) USING KEY (site_id, group_id) AS (
    SELECT site_id, group_id, 1::BIGINT, [s], list_filter(members, lambda m: m.id <> s.id) FROM (SELECT *, list_reduce(members, lambda a, b: CASE WHEN (n * b.x - sx) * (n * b.x - sx) + (n * b.y - sy) * (n * b.y - sy)
      > (n * a.x - sx) * (n * a.x - sx) + (n * a.y - sy) * (n * a.y - sy) THEN b ELSE a END) AS s FROM row_lists) q
    UNION SELECT site_id, group_id, k + 1, list_append(path, s), list_filter(rest, lambda m: m.id <> s.id) FROM (SELECT *, list_reduce(rest, lambda a, b: CASE WHEN (b.x - path[-1].x) * (b.x - path[-1].x) + (b.y - path[-1].y) * (b.y - path[-1].y)
      < (a.x - path[-1].x) * (a.x - path[-1].x) + (a.y - path[-1].y) * (a.y - path[-1].y) THEN b ELSE a END) AS s FROM walk WHERE len(rest) > 0) q),
  chain_rows AS (SELECT site_id, group_id, path[i].id AS item_id, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM walk) q)"""


@query("chain_order", sql("SELECT site_id, group_id, item_id, pos FROM chain_rows", WALK))
def chain_order(t):
    """Members of every row in walking order."""
    return ed.chain_order(t.items)


@query("fix_gap", sql("""SELECT c.site_id, c.group_id, c.item_id, sqrt((lead(i.x) OVER w - lag(i.x) OVER w) * (lead(i.x) OVER w - lag(i.x) OVER w) + (lead(i.y) OVER w - lag(i.y) OVER w) * (lead(i.y) OVER w - lag(i.y) OVER w)) AS gap_m
  FROM chain_rows c JOIN items i USING (site_id, item_id) WINDOW w AS (PARTITION BY c.site_id, c.group_id ORDER BY pos)""", WALK))
def fix_gap(t):
    """Gap left by deleting each row member."""
    return ed.row_gaps(t.items)


cte("chain_spans", "SELECT i.site_id, i.group_id, max(s.interval_m) FILTER (i.planting_type = 'tree') AS need FROM items i LEFT JOIN d_interval s ON s.name = i.species WHERE i.group_id LIKE '%-row-%' GROUP BY ALL")


@query("respace_row", sql("""SELECT l.site_id, l.group_id, l.i, s.x + (s.nx - s.x) * ((l.at2 - s.start * 2) / (s.um * 2)) AS x, s.y + (s.ny - s.y) * ((l.at2 - s.start * 2) / (s.um * 2)) AS y FROM (
    SELECT site_id, group_id, i, total - (total // 6000000) * 6000000 + i * 12000000 AS at2 FROM (SELECT *, unnest(range(total // 6000000 + 1)) AS i FROM (
      SELECT site_id, group_id, sum(um)::BIGINT AS total FROM chain_steps GROUP BY ALL) a JOIN chain_spans USING (site_id, group_id) WHERE coalesce(need, 0e0) <= 6.000001e0 AND total >= 6000000) b) l
  JOIN chain_steps s ON s.site_id = l.site_id AND s.group_id = l.group_id AND s.um > 0 AND l.at2 >= s.start * 2 AND l.at2 < (s.start + s.um) * 2""",
  WALK + """, chain_steps AS (SELECT *, coalesce(sum(um) OVER (PARTITION BY site_id, group_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (
      SELECT c.site_id, c.group_id, c.pos, i.x, i.y, lead(i.x) OVER w AS nx, lead(i.y) OVER w AS ny,
        CAST(floor(sqrt((lead(i.x) OVER w - i.x) * (lead(i.x) OVER w - i.x) + (lead(i.y) OVER w - i.y) * (lead(i.y) OVER w - i.y)) * 1000000e0) AS BIGINT) AS um
      FROM chain_rows c JOIN items i USING (site_id, item_id) WINDOW w AS (PARTITION BY c.site_id, c.group_id ORDER BY pos)) q)"""))
def respace_row(t):
    """Rows laid out again every 6 m."""
    return ed.respace_row(t.items, 6.0)


@query("density_stops")
def density_stops(t):
    """Stops of a walk through the densest cells (rows only)."""
    return ed.density_stops(t.items)


def _violating(t):
    bad = co.violation_mask(t.items, co.setback_checks(t.items, t.edges)).filter("violates and planting_type <> 'lawn'").select("site_id", "item_id")
    return stored(t.items.join(bad, ["site_id", "item_id"], "left_semi"))


def spots_sql(movers: str, n: int, step: int, walls: str = "mover_edges", others: str = "mover_trees") -> str:
    r = n * step / 100
    return f"""SELECT s.site_id, s.item_id, s.spot, s.d2, s.sx, s.sy FROM (
      SELECT m.site_id, m.item_id, m.planting_type, m.species, m.own_m, (i + {n}) * {2 * n + 1} + j + {n} AS spot, i * i + j * j AS d2, (m.xc + i * {step}) / 100e0 AS sx, (m.yc + j * {step}) / 100e0 AS sy
      FROM {movers} m, range(-{n}, {n + 1}) a(i), range(-{n}, {n + 1}) b(j) WHERE i * i + j * j BETWEEN 1 AND {n * n}) s
    WHERE NOT EXISTS (SELECT 1 FROM {walls} e WHERE e.site_id = s.site_id AND e.item_id = s.item_id AND {seg('s.sx', 's.sy')} < e.required_m + 0.01e0)
      AND NOT EXISTS (SELECT 1 FROM {others} q WHERE q.site_id = s.site_id AND q.item_id = s.item_id AND {dist('s.sx', 's.sy', 'q.tx', 'q.ty')} < q.need + 0.005e0)
      AND (SELECT count(*) FILTER ({cross('s.sx', 's.sy')}) % 2 = 1 FROM outline e WHERE e.site_id = s.site_id)"""


cte("movers", "SELECT i.*, s.interval_m AS own_m FROM items i JOIN mask_rows m USING (site_id, item_id) LEFT JOIN d_interval s ON s.name = i.species WHERE m.violates AND i.planting_type <> 'lawn'")
cte("mover_edges", resolve_sql(f"(SELECT m.site_id, m.item_id, m.planting_type, m.species, e.object_type, e.x1, e.y1, e.x2, e.y2, {seg('m.x', 'm.y')} AS d FROM movers m JOIN c_edges e USING (site_id) WHERE {seg('m.x', 'm.y')} <= 31e0)",
                               "site_id, item_id, x1, y1, x2, y2, d"))
cte("mover_trees", f"SELECT m.site_id, m.item_id, t.x AS tx, t.y AS ty, coalesce(greatest(m.own_m, s.interval_m), 0e0) AS need FROM movers m JOIN trees t ON t.site_id = m.site_id AND t.item_id <> m.item_id AND {dist('m.x', 'm.y', 't.x', 't.y')} <= 20e0 LEFT JOIN d_interval s ON s.name = t.species WHERE m.planting_type = 'tree'")
cte("move_rows", f"SELECT site_id, item_id, arg_min(sx, (d2, spot)) AS x, arg_min(sy, (d2, spot)) AS y, sqrt(min(d2)::DOUBLE) * 0.1e0 AS shift_m FROM ({spots_sql('movers', 30, 10)}) q GROUP BY ALL")


@query("fix_move", sql("SELECT * FROM move_rows"))
def fix_move(t):
    """Nearest legal place within 3 m of every violating plant."""
    return fi.nearest_spot(fi.legal_spots(_violating(t), t.items, t.edges, t.outline))


cte("shrub_rows", "SELECT d.site_id, d.item_id, d.object_type, d.actual_m, 'shrub' AS planting_type, 'default' AS species FROM item_distances d JOIN trees t USING (site_id, item_id)")
cte("shrub_fit", f"SELECT site_id, item_id, bool_and(actual_m + 0.001e0 >= required_m) AS fits FROM ({resolve_sql('shrub_rows', 'site_id, item_id, object_type, actual_m')}) q GROUP BY ALL")


@query("fix_retype", sql("SELECT * FROM shrub_fit"))
def fix_retype(t):
    """Trees that could be a shrub where they stand."""
    return fi.shrub_fits(t.items, t.edges)


@query("fix_options", sql("""SELECT site_id, item_id, kind, value_m, o = min(o) OVER w AND count(*) OVER w > 1 AS recommended FROM (
    SELECT m.site_id, m.item_id, 1 AS o, 'move' AS kind, r.shift_m AS value_m FROM movers m JOIN move_rows r USING (site_id, item_id)
    UNION ALL SELECT m.site_id, m.item_id, 2, 'retype', NULL FROM movers m JOIN shrub_fit f USING (site_id, item_id) WHERE f.fits
    UNION ALL SELECT m.site_id, m.item_id, 3, 'delete', g.gap_m FROM movers m LEFT JOIN gap_rows g USING (site_id, item_id)) q WINDOW w AS (PARTITION BY site_id, item_id)""",
  WALK + """, gap_rows AS (SELECT c.site_id, c.item_id, sqrt((lead(i.x) OVER w - lag(i.x) OVER w) * (lead(i.x) OVER w - lag(i.x) OVER w) + (lead(i.y) OVER w - lag(i.y) OVER w) * (lead(i.y) OVER w - lag(i.y) OVER w)) AS gap_m
    FROM chain_rows c JOIN items i USING (site_id, item_id) WINDOW w AS (PARTITION BY c.site_id, c.group_id ORDER BY pos))"""))
def fix_options(t):
    """Repair options of every violating plant."""
    v = _violating(t)
    return fi.fix_options(v, fi.nearest_spot(fi.legal_spots(v, t.items, t.edges, t.outline)), fi.shrub_fits(t.items, t.edges), ed.row_gaps(t.items))


@query("apply_fixes")
def apply_fixes(t):
    """All violating plants moved one after another, in rounds (rows only; tested against a sequential pass)."""
    return fi.apply_moves(_violating(t), t.items, t.edges, t.outline).select("site_id", "item_id", "moved", "x", "y")


@query("nearest_allowed", sql(f"SELECT site_id, item_id, arg_min(sx, (d2, spot)) AS x, arg_min(sy, (d2, spot)) AS y, sqrt(min(d2)::DOUBLE) * 0.4e0 AS shift_m FROM ({spots_sql('movers', 20, 40)}) q GROUP BY ALL"))
def nearest_allowed(t):
    """Nearest legal place within 8 m, on a 0.4 m grid."""
    return fi.nearest_spot(fi.legal_spots(_violating(t), t.items, t.edges, t.outline, 800, 40), 40)


cte("window_edges", resolve_sql(f"(SELECT m.site_id, m.item_id, m.planting_type, m.species, e.object_type, e.x1, e.y1, e.x2, e.y2, {seg('m.x', 'm.y')} AS d FROM movers m JOIN c_edges e USING (site_id) WHERE {seg('m.x', 'm.y')} <= 81e0)",
                               "site_id, item_id, x1, y1, x2, y2, d"))
cte("window_trees", f"SELECT m.site_id, m.item_id, t.x AS tx, t.y AS ty, coalesce(greatest(m.own_m, s.interval_m), 0e0) AS need FROM movers m JOIN trees t ON t.site_id = m.site_id AND t.item_id <> m.item_id AND {dist('m.x', 'm.y', 't.x', 't.y')} <= 69e0 LEFT JOIN d_interval s ON s.name = t.species WHERE m.planting_type = 'tree'")


@query("allowed_window", sql(f"SELECT site_id, item_id, count(*)::BIGINT AS spots, max(d2) AS farthest FROM ({spots_sql('movers', 150, 40, 'window_edges', 'window_trees')}) q GROUP BY ALL"))
def allowed_window(t):
    """Size of the legal area within 60 m of every violating plant, on a 0.4 m grid."""
    return fi.spot_counts(fi.surroundings(_violating(t), t.edges, t.outline, 6000), t.items, 6000, 40)


def _edit_stream(t):
    from sitefit.sources.bindings import SPARK, edits

    events = live.event_stream(t.spark, t.folder, "events")
    return live.item_states(t.spark.sql(edits(SPARK).replace("from events", "from {events}"), events=events), t.items)


@query("stream_edits", sql(FOLD))
def stream_edits(t):
    """The edit log as a stream with keyed state; after draining, the plan state equals the batch fold."""
    path = live.new_folder(t.spark, "edit-states")
    live.keep_states(_edit_stream(t), path)
    return live.plan_state(t.spark, path, t.items)


cte("folded_items", FOLD)
cte("edited", "SELECT i.* REPLACE (f.planting_type AS planting_type, f.species AS species, f.x AS x, f.y AS y, f.is_manual_edit AS is_manual_edit) FROM items i JOIN folded_items f USING (site_id, item_id) WHERE f.alive")
_E = cte_over(("setback_rows", "neighbour_rows", "trees"), "items", "edited", "edited")
cte("edited_scope", f"""SELECT site_id, item_id FROM edited JOIN touched USING (site_id, item_id) UNION
  SELECT a.site_id, a.item_id FROM {_E['trees']} a JOIN (SELECT * FROM trees UNION ALL SELECT * FROM {_E['trees']}) b ON a.site_id = b.site_id AND {dist('a.x', 'a.y', 'b.x', 'b.y')} <= 8e0
    JOIN touched t ON t.site_id = b.site_id AND t.item_id = b.item_id""")


@query("stream_revalidate", sql(f"""SELECT s.site_id, s.item_id, coalesce(a.n, 0)::BIGINT AS setback_violations, coalesce(b.n, 0)::BIGINT AS spacing_violations FROM edited_scope s
  LEFT JOIN (SELECT site_id, item_id, count(*) AS n FROM {_E['setback_rows']} JOIN touched USING (site_id, item_id) WHERE NOT satisfied GROUP BY ALL) a USING (site_id, item_id)
  LEFT JOIN (SELECT site_id, item_id, count(*) AS n FROM {_E['neighbour_rows']} WHERE NOT satisfied GROUP BY ALL) b USING (site_id, item_id)"""))
def stream_revalidate(t):
    """Items of each micro-batch re-checked in the plan as edited so far, with the trees around their old and new places."""
    path = live.new_folder(t.spark, "verdicts")
    live.keep_verdicts(_edit_stream(t), t.items, t.edges, path)
    return live.open_verdicts(t.spark, path)


@query("stream_progress", sql("SELECT user_id % 10 AS plan_key, event_type, count(*)::BIGINT AS count FROM events GROUP BY ALL"))
def stream_progress(t):
    """Running counts per plan and type, after draining."""
    path = live.new_folder(t.spark, "progress")
    events = live.event_stream(t.spark, t.folder, "events").withColumn("plan_key", F.col("user_id") % 10)
    live.progress(events, path)
    return t.spark.read.parquet(f"{path}/state")
