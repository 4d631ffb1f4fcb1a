"""Site tables derived from the star-schema input tables.

The input tables carry no geometry, so every site table is integer arithmetic on their keys followed
by one division. A site is a block of consecutive keys: the number of sites grows with the data and
the content of one site does not. Each binding is a SELECT text in a dialect (``SPARK`` for the engine,
``DUCK`` for the check), so both sides read the same inputs; no operator logic lives here.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from sitefit import fixed as fx
from sitefit.session import scratch_folder

ORDERS_PER_SITE, PARTS_PER_SITE, CUSTOMERS_PER_SITE, SUPPLIERS_PER_SITE = 600, 80, 60, 4
LINE_TYPES = (
    "heat_network", "water_pipe", "sewer", "gas_pipe", "cable_line", "power_line_corridor", "road",
    "sidewalk_kerb", "tram_track", "retaining_wall", "slope_toe", "steam_pipe",
)
POLYGON_TYPES = ("building", "road", "sidewalk", "existing_greenery", "zoning", "school_kindergarten", "existing_lawn")
UTILITIES = fx.UTILITY_TYPES + ("steam_pipe",)
ZONING = ("residential", "recreational", "public", "industrial", "transport")
TREE_NAMES = tuple(s[0] for s in fx.SPECIES if s[1] == "tree") + ("default", "Ива белая", "Рябина обыкновенная")
SHRUB_NAMES = tuple(s[0] for s in fx.SPECIES if s[1] == "shrub")
EXTRA_NAMES = ("Дерен белый", "Acer negundo", "клён  ясенелистный", "ЛИПА МЕЛКОЛИСТНАЯ", "Клен остролистный",
               " берёза повислая", "Rosa rugosa", "дуб", "Сирень  обыкновенная", "")
LAYER_NAMES = tuple(m[0] for m in fx.LAYER_MAP) + (
    "Посадка_Дерево", "АД_борт_трот_БР100.30.15", "ДВ_ГП_П_Борт_БР100.30.15", "БР 1000 300 150", "_ГЗН-АБ ПЧ",
    "ПЧ_АБ", "АБ-ТР", "Тип 1 (рем. щма)", "!Project_road kerb - ГП1", "!Project_road dimension 500",
    "Границы благоустройства", "Граница заказа", "Дендра_сохранить", "Дендра_выноски_сохранить", "Колодцы",
    "Фонари", "Опоры контакНОЙ сети", "Опоры контактной сети", "Школа №5", "Подпорная стенка", "Откосы",
    "Лестницы набережных", "Тротуар (проект)", "Устройство_уширений_местные", "Текст", "0", "Defpoints",
    "Трамвайные пути", "ТС проект", "Ливневая канализация", "Граница растительности и грунта", "Светофоры",
)
PHRASES = (
    "Удали выделенные деревья", "сделай кусты пореже, шаг 2,5 м", "Сколкьо деревьев в плане?", "Покажи нарушеия!",
    "выдели все липы и покажи их", "Привет, помоги", "удали деревья, у которых нарушения", "можно удалить выделенные?",
    "Спасибо", "сгенерируй план заново", "не удаляй кусты", "покажи 3-д вид", "отмени последнее действие",
    "сними выделение", "отключи нормы", "деревья в два ряда; газон убери",
)


@dataclass(frozen=True)
class Dialect:
    name: str

    def div(self, a: str, b: int | str) -> str:
        return f"(({a}) div {b})" if self.name == "spark" else f"(({a}) // {b})"

    def pick(self, values, index: str) -> str:
        items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
        if self.name == "spark":
            return f"element_at(array({items}), cast({index} as int) + 1)"
        return f"([{items}])[cast({index} as int) + 1]"

    def text(self, expr: str) -> str:
        return f"cast({expr} as string)" if self.name == "spark" else f"cast({expr} as varchar)"

    def rows(self, keys: list[str], structs: list[dict[str, str]], source: str) -> str:
        """One output row per struct for every source row."""
        if self.name == "spark":
            packed = ", ".join("struct(" + ", ".join(f"{e} as {n}" for n, e in s.items()) + ")" for s in structs)
            return f"select {', '.join(keys)}, inline(array({packed})) from {source}"
        packed = ", ".join("{" + ", ".join(f"'{n}': {e}" for n, e in s.items()) + "}" for s in structs)
        names = ", ".join(k.split(" as ")[-1] for k in keys)
        return f"select {names}, unnest(u, max_depth := 1) from (select {', '.join(keys)}, unnest([{packed}]) as u from {source})"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def m(expr: str) -> str:
    """Centimetres to metres."""
    return f"({expr}) / 100e0"


def sites(d: Dialect) -> str:
    site = d.div("o_orderkey", ORDERS_PER_SITE)
    return f"""
      select site_id, 40000 + (site_id % 5) * 1000 as wc, 30000 as hc, n_name as district, r_name as region
      from (select distinct {site} as site_id from orders) s
      join nation on n_nationkey = site_id % 25 join region on r_regionkey = n_regionkey"""


def outline(d: Dialect) -> str:
    """L-shaped site outline with one square hole; ring 0 is the exterior."""
    ring0 = [("0", "0"), ("wc", "0"), ("wc", "hc - 14000"), ("wc - 15000", "hc - 14000"), ("wc - 15000", "hc"), ("0", "hc")]
    ring1 = [("9000 + (site_id % 7) * 100", "6000"), ("9000 + (site_id % 7) * 100", "9000"),
             ("12000 + (site_id % 7) * 100", "9000"), ("12000 + (site_id % 7) * 100", "6000")]
    structs = []
    for ring, points in enumerate((ring0, ring1)):
        for seq, (a, b) in enumerate(zip(points, points[1:] + points[:1])):
            structs.append({"ring": f"cast({ring} as bigint)", "seq": f"cast({seq} as bigint)",
                            **{n: f"cast({e} as bigint)" for n, e in zip(("xc1", "yc1", "xc2", "yc2"), (*a, *b))}})
    inner = d.rows(["site_id"], structs, "sites")
    return f"""select site_id, ring, seq, xc1, yc1, xc2, yc2, {m('xc1')} as x1, {m('yc1')} as y1,
      {m('xc2')} as x2, {m('yc2')} as y2 from ({inner}) o"""


def line_features(d: Dialect) -> str:
    site = d.div("o_orderkey", ORDERS_PER_SITE)
    return f"""
      select site_id, k * 2 as gid, {d.pick(LINE_TYPES, '(k % (6 + site_id % 7))')} as object_type, 'line' as geom_kind,
        k, xc1, yc1, xc1 + (k * 31) % 2401 - 1200 as xc2, yc1 + (k * 17) % 1601 - 800 as yc2
      from (select o_orderkey as k, {site} as site_id, (o_orderkey * 7919) % 40000 as xc1,
              (o_orderkey * 104729) % 30000 as yc1 from orders) o"""


def area_features(d: Dialect) -> str:
    site = d.div("p_partkey", PARTS_PER_SITE)
    point_type = f"{d.pick(('lighting_pole', 'existing_greenery'), '(' + d.div('k', 8) + ' % 2)')}"
    return f"""
      select site_id, k * 2 + 1 as gid, k,
        case when k % 8 < 7 then {d.pick(POLYGON_TYPES + ('',), '(k % 8)')} else {point_type} end as object_type,
        case when k % 8 < 7 then 'polygon' else 'point' end as geom_kind,
        case when k % 8 = 4 then {d.pick(ZONING, '(' + d.div('k', 8) + ' % 5)')} end as zoning, cx, cy,
        case when k % 8 = 4 then 4 else 1 end * (300 + (k * 13) % 900) as hw,
        case when k % 8 = 4 then 4 else 1 end * (200 + (k * 29) % 700) as hh, (k * 7) % 301 - 150 as sh
      from (select cast(p_partkey as bigint) as k, {site} as site_id, (p_partkey * 7507) % 36000 + 2000 as cx,
              (p_partkey * 9241) % 26000 + 2000 as cy from part) p"""


def features(d: Dialect) -> str:
    util = ", ".join(f"'{t}'" for t in UTILITIES)
    kind = f"case when object_type in ({util}) then 'utility' else 'zone' end"
    return f"""
      select site_id, gid, {kind} as kind, object_type, geom_kind, cast(null as {'string' if d.name == 'spark' else 'varchar'}) as zoning from line_features
      union all select site_id, gid, {kind} as kind, object_type, geom_kind, zoning from area_features"""


def edges(d: Dialect) -> str:
    """All geometry as two-point edges; a point is a zero-length edge, a ring closes on itself."""
    a, b = ("cx - hw", "cy - hh"), ("cx + hw", "cy - hh")
    c, e = ("cx + hw + sh", "cy + hh"), ("cx - hw + sh", "cy + hh")
    bow = "k % 40 = 11"
    b2 = tuple(f"case when {bow} then {q} else {p} end" for p, q in zip(b, c))
    c2 = tuple(f"case when {bow} then {p} else {q} end" for p, q in zip(b, c))
    ring = [a, b2, c2, e]
    structs = [{"seq": f"cast({i} as bigint)", **{n: f"cast({x} as bigint)" for n, x in zip(("xc1", "yc1", "xc2", "yc2"), (*p, *q))}}
               for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    poly = d.rows(["site_id", "gid", "object_type", "geom_kind"], structs, "(select * from area_features where geom_kind = 'polygon') g")
    return f"""
      select site_id, gid, object_type, geom_kind, seq, xc1, yc1, xc2, yc2, {m('xc1')} as x1, {m('yc1')} as y1,
        {m('xc2')} as x2, {m('yc2')} as y2
      from (select site_id, gid, object_type, geom_kind, cast(0 as bigint) as seq, xc1, yc1, xc2, yc2 from line_features
            union all select site_id, gid, object_type, geom_kind, seq, xc1, yc1, xc2, yc2 from ({poly}) q
            union all select site_id, gid, object_type, geom_kind, cast(0 as bigint) as seq, cx as xc1, cy as yc1, cx as xc2, cy as yc2
                      from area_features where geom_kind = 'point') e"""


def items(d: Dialect) -> str:
    """Placements of a plan: six blocks of ten per site, four of them rows."""
    site, block = d.div("c_custkey", CUSTOMERS_PER_SITE), d.div("c_custkey", 10)
    notes = (fx.TREE_GROUP_PREFIX, fx.SOLITAIRE_PREFIX, "Эвристический скоринг: место выбрано по оценке.",
             fx.IN_PAVING_PREFIX + " " + fx.ROW_PREFIX)
    null_text = f"cast(null as {'string' if d.name == 'spark' else 'varchar'})"
    return f"""
      select site_id, k as item_id, planting_type, xc, yc, {m('xc')} as x, {m('yc')} as y,
        case planting_type when 'tree' then {d.pick(TREE_NAMES, '(k % 8)')}
                           when 'shrub' then {d.pick(SHRUB_NAMES, '(k % 9)')} else 'default' end as species,
        ((k * 37) % 1000) / 1000e0 as score,
        case when bb <= 3 then '{fx.ROW_PREFIX}' when bb = 4 then {d.pick(notes, '(k % 4)')}
             else '{fx.SHRUB_GROUP_PREFIX}' end as rationale,
        k % 7 = 0 as is_manual_edit,
        case when bb <= 3 then concat(planting_type, '-row-', {d.text('b')}, '-0')
             when bb = 5 and planting_type = 'shrub' then concat('shrub-group-', {d.text('b')}) else {null_text} end as group_id,
        case when planting_type = 'lawn' then 200 + k % 500 else 0 end as side_c
      from (select k, site_id, b, bb,
              case when bb <= 2 or bb = 4 then 'tree' when bb = 3 or k % 2 = 0 then 'shrub' else 'lawn' end as planting_type,
              case when bb <= 3 then (b * 23757) % 30000 + 2000 + ((k * 7) % 10) * (450 + (b % 3) * 150) + (k * 37) % 21 - 10
                   else (k * 6007) % 40000 end as xc,
              case when bb <= 3 then (b * 6421) % 24000 + 3000 + ((k * 7) % 10) * ((b % 5 - 2) * 60) + (k * 41) % 21 - 10
                   else (k * 9973) % 30000 end as yc
            from (select c_custkey as k, {site} as site_id, {block} as b, {block} % 6 as bb from customer) c) i"""


def items_b(d: Dialect) -> str:
    """A later version of the same plan: nudged, thinned, with some additions."""
    nudged = f"""select site_id, item_id, planting_type, species, xc + (item_id * 11) % 101 - 50 as xc, yc + (item_id * 19) % 101 - 50 as yc,
        rationale, score from items where item_id % 13 <> 0"""
    added = f"""select site_id, item_id + 1000000000000 as item_id, planting_type, species, xc + 20 as xc, yc + 700 as yc, rationale, score
        from items where item_id % 17 = 0"""
    return f"""select site_id, item_id, planting_type, species, xc, yc, {m('xc')} as x, {m('yc')} as y, rationale, score
      from ({nudged} union all {added}) v"""


def reference_trees(d: Dialect) -> str:
    site, ssite = d.div("c_custkey", CUSTOMERS_PER_SITE), d.div("s_suppkey", SUPPLIERS_PER_SITE)
    return f"""
      select site_id, ref_id, {m('xc')} as x, {m('yc')} as y from (
        select site_id, item_id * 2 as ref_id, xc + (item_id * 13) % 1201 - 600 as xc, yc + (item_id * 29) % 801 - 400 as yc from items
        union all select {ssite} as site_id, s_suppkey * 2 + 1 as ref_id, (s_suppkey * 7001) % 40000 as xc,
          (s_suppkey * 4001) % 30000 as yc from supplier) r"""


def candidates(d: Dialect) -> str:
    """Raw candidate points with a score; ``cand_id`` is the input order."""
    site = d.div("l_orderkey", ORDERS_PER_SITE)
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    return f"""
      select {site} as site_id,
        l_orderkey * 10000000 + l_linenumber * 1000000 + (l_partkey * 7 + l_suppkey * 1000003 + {cents}) % 1000000 as cand_id,
        case when l_returnflag = 'R' then 'shrub' else 'tree' end as planting_type,
        {m('(l_orderkey * 7919 + l_partkey * 31 + l_linenumber * 1009) % 40000')} as x,
        {m('(l_orderkey * 104729 + l_suppkey * 173 + l_partkey * 7) % 30000')} as y,
        ({cents} % 1000) / 1000e0 as score
      from lineitem"""


def edits(d: Dialect) -> str:
    return f"""
      select event_id as seq, ts, user_id * 10 + event_id % 10 as item_id, {d.div('event_id', 8)} as batch_id,
        case event_type when 'view' then 'move' when 'click' then 'patch' when 'purchase' then 'retype'
                        when 'signup' then 'restore' else 'delete' end as op,
        ((event_id * 31) % 401 - 200) / 100e0 as dx, ((event_id * 17) % 401 - 200) / 100e0 as dy,
        (event_id * 31) % 401 - 200 as dxc, (event_id * 17) % 401 - 200 as dyc,
        {d.pick(fx.PLANTING_TYPES, '(event_id % 3)')} as new_type,
        {d.pick(TREE_NAMES, '(event_id % 8)')} as new_species
      from events"""


def plans(d: Dialect) -> str:
    site = d.div("o_orderkey", ORDERS_PER_SITE)
    types = ("tree", "tree,shrub", "tree,shrub,lawn", "shrub,tree", "lawn")
    return f"""
      select o_orderkey as plan_id, {site} as site_id, o_orderdate as created_at,
        case when o_orderstatus = 'P' then 'ml' else 'heuristic' end as scoring_mode,
        {d.pick(types, '(o_orderkey % 5)')} as planting_types,
        case when o_orderkey % 3 > 0 then cast(o_custkey % 6 + 4 as double) end as tree_spacing_m,
        case when o_orderkey % 4 > 1 then cast(o_custkey % 3 + 1 as double) / 2e0 end as shrub_spacing_m,
        cast(1 + o_orderkey % 2 as bigint) as tree_rows, o_orderkey % 7 = 0 as trees_in_paving,
        o_orderkey % {ORDERS_PER_SITE} = {ORDERS_PER_SITE - 1} as is_current, o_orderkey % 3 <> 1 as materialized,
        o_orderkey % 11 = 0 as has_manual_edits
      from orders"""


def layer_names(d: Dialect) -> str:
    """Layer names of drawing sheets: a vocabulary decorated with reference prefixes and letter case."""
    base = d.pick(LAYER_NAMES, f"(k % {len(LAYER_NAMES)})")
    return f"""
      select k, {d.div('k', PARTS_PER_SITE)} as site_id, concat('sheet', {d.text('k % 11')}) as sheet,
        case when k % 3 = 0 then concat('xref', {d.text('k % 7')}, '|', name) when k % 5 = 0 then upper(name) else name end as layer
      from (select cast(p_partkey as bigint) as k, {base} as name from part) p"""


def species_names(d: Dialect) -> str:
    names = TREE_NAMES + SHRUB_NAMES + tuple(i[0] for i in fx.INVASIVE) + EXTRA_NAMES
    base = d.pick(names, f"(k % {len(names)})")
    return f"""
      select k, case when k % 4 = 1 then upper(name) when k % 4 = 2 then concat('  ', replace(name, ' ', '  ')) else name end as name
      from (select cast(p_partkey as bigint) as k, {base} as name from part) p"""


def utterances(d: Dialect) -> str:
    """Messages: the conversation turns as they are, followed by a phrase chosen by key."""
    phrase = d.pick(PHRASES, f"((conv_id * 3 + turn) % {len(PHRASES)})")
    return f"select conv_id, turn, role, concat(text, chr(10), {phrase}) as text from conversations"


BINDINGS = {
    "sites": (sites, ("orders", "nation", "region"), ()),
    "outline": (outline, (), ("sites",)),
    "line_features": (line_features, ("orders",), ()),
    "area_features": (area_features, ("part",), ()),
    "features": (features, (), ("line_features", "area_features")),
    "edges": (edges, (), ("line_features", "area_features")),
    "items": (items, ("customer",), ()),
    "items_b": (items_b, (), ("items",)),
    "reference_trees": (reference_trees, ("supplier",), ("items",)),
    "candidates": (candidates, ("lineitem",), ()),
    "edits": (edits, ("events",), ()),
    "plans": (plans, ("orders",), ()),
    "layer_names": (layer_names, ("part",), ()),
    "species_names": (species_names, ("part",), ()),
    "utterances": (utterances, ("conversations",), ()),
}


# Bindings worth deriving once per application: several queries read them, some of them many times in one plan.
STORED = ("sites", "outline", "area_features", "features", "edges", "items", "items_b", "reference_trees", "candidates", "edits", "plans")
_written: dict[tuple, str] = {}


class Tables:
    """Lazily bound site tables of one input folder.

    A stored binding is written once as a table in the shared scratch folder and read back from there, so
    every later plan starts from a plain columnar scan.
    """

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder, self._frames = spark, folder, {}

    def raw(self, name: str):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in BINDINGS:
            return self.raw(name)
        if name not in self._frames:
            self._frames[name] = self._stored(name) if name in STORED else self._bound(name)
        return self._frames[name]

    def _bound(self, name: str):
        make, inputs, parents = BINDINGS[name]
        views = {t: self.raw(t) for t in inputs} | {p: getattr(self, p) for p in parents}
        text = make(SPARK).replace("{", "{{").replace("}", "}}")
        for n in sorted(views, key=len, reverse=True):
            text = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **views)

    def _stored(self, name: str):
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _written:
            bound = self._bound(name)
            cores = self.spark.sparkContext.defaultParallelism
            if bound.rdd.getNumPartitions() < cores:
                bound = bound.repartition(cores)
            path = f"{scratch_folder(self.spark)}/{hashlib.md5(repr(key).encode()).hexdigest()}/{name}"
            bound.write.mode("overwrite").parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])
