"""More queries of the engine's own operators with their SQL: column functions, rules, rooms, floors, doors and routes over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import georef, graph, indoor, lookup, polyline, quality, route, spatial
from ..sources import maps
from . import views as V
from .catalog import _long, query

_MX, _MY = repr(S.MX), repr(S.MY)

# column functions -------------------------------------------------------------------------------------------------


@query(f"""WITH {V.SUPPLIER_SITES}, p AS (SELECT id, x, y, nation, x / {_MX} AS lon, y / {_MY} AS lat FROM ss)
SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat, round(lon * {_MX}, 6) AS back, round(sqrt(x * x + (y - 100) * (y - 100)), 6) AS apart,
 round(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE x / sqrt(x * x + y * y) END, 9) AS ux, round(((degrees(atan2(x - 5000, y - 5000)) + 360) % 360), 6) AS heading,
 round(x + sin(radians(nation * 15.0)) * -5, 6) AS behind_x, round(y + cos(radians(nation * 15.0)) * -5, 6) AS behind_y FROM p""")
def vector_functions(spark, d):
    s = V.supplier_sites(spark, d).withColumn("p", F.struct("x", "y")).withColumn("g", F.struct((F.col("x") / S.MX).alias("lon"), (F.col("y") / S.MY).alias("lat")))
    far = F.struct(F.lit(0.0).alias("lon"), F.lit(100.0 / S.MY).alias("lat"))
    unit = S.unit(S.subtract(S.add(F.col("p"), F.col("p")), S.scaled(F.col("p"), 1.0)))
    behind = S.offset(F.col("p"), F.col("nation") * 15.0, -5.0)
    ll = S.to_lonlat("p")
    return s.select("id", ll["lon"].alias("lon"), ll["lat"].alias("lat"), F.round(S.to_metric("g")["x"], 6).alias("back"), F.round(S.metres("g", far), 6).alias("apart"),
                    F.round(unit["x"], 9).alias("ux"), F.round(S.bearing(F.col("x") - 5000, F.col("y") - 5000), 6).alias("heading"), F.round(behind["x"], 6).alias("behind_x"), F.round(behind["y"], 6).alias("behind_y"))


@query(f"""WITH {V.SUPPLIER_SITES} SELECT id, round(CASE WHEN id % 3 = 0 THEN x ELSE cos(radians(nation * 2.0)) * (x - 10) - sin(radians(nation * 2.0)) * (y - 20) + 10 + 3 END, 6) AS x,
 round(CASE WHEN id % 3 = 0 THEN y ELSE sin(radians(nation * 2.0)) * (x - 10) + cos(radians(nation * 2.0)) * (y - 20) + 20 - 4 END, 6) AS y FROM ss""")
def rigid_shift(spark, d):
    p = S.rigid(F.struct("x", "y"), F.col("nation") * 2.0, S.point(10.0, 20.0), 3.0, -4.0, F.col("id") % 3 != 0)
    return V.supplier_sites(spark, d).select("id", p.alias("p")).select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 0.5 END AS level FROM part)
SELECT p_partkey, 'I:' || p_brand || ':' || CASE WHEN level = floor(level) THEN CAST(CAST(level AS BIGINT) AS VARCHAR) ELSE CAST(CAST(level AS DOUBLE) AS VARCHAR) END || ':' || p_partkey AS node, CAST(level AS DOUBLE) AS level,
 CASE WHEN p_partkey % 3 = 0 THEN 'a:b-' || p_size END AS link, replace(replace(replace(replace('<' || p_name || '>&"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
 printf('%.6f,%.6f', p_partkey / 7.0::DOUBLE, -p_size / 3.0::DOUBLE) AS place FROM p JOIN part USING (p_partkey)""")
def ids_and_keys(spark, d):
    level = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.5)
    node = S.indoor_node("p_brand", level, "p_partkey")
    portal = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("P:a:b-"), F.col("p_size").cast("string"), F.lit(":E"))).otherwise("X:E")
    html = S.escape_html(F.concat(F.lit("<"), "p_name", F.lit('>&"')))
    return V.table(spark, d, "part").select("p_partkey", node.alias("node"), S.parse_indoor_node(node)["level"].alias("level"), S.portal_link(portal).alias("link"), html.alias("html"), S.coordinate_key(F.col("p_partkey") / 7.0, -F.col("p_size") / 3.0).alias("place"))


@query("""SELECT p_partkey, CAST(floor(p_size / 4.0::DOUBLE - 3 + 0.5) AS BIGINT) AS up, CAST(floor(p_partkey / 5.0::DOUBLE + 0.5) * 5 AS BIGINT) AS fives, least(greatest(p_size - 20.0::DOUBLE, -5), 9) AS clamped,
 CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.25::DOUBLE END AS number, greatest(1, CAST(floor(p_size * 7 / 1.3::DOUBLE / 60 + 0.5) AS BIGINT)) AS minutes FROM part""")
def rounding(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".25 m"))).otherwise("about 5")
    return V.table(spark, d, "part").select("p_partkey", _long(S.round_up(F.col("p_size") / 4.0 - 3)).alias("up"), _long(S.round_to("p_partkey", 5)).alias("fives"), S.clamp(F.col("p_size") - 20.0, -5.0, 9.0).alias("clamped"), S.number_prefix(text).alias("number"), _long(R.shown_minutes(F.col("p_size") * 7)).alias("minutes"))


@query(f"""WITH {V.CUSTOMER_SITES}, r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY id) AS k, count(*) OVER (PARTITION BY nation) AS n FROM cs),
e AS (SELECT nation, arg_min(x, k) AS x0, arg_min(y, k) AS y0, arg_max(x, k) AS x1, arg_max(y, k) AS y1, max(n) AS n FROM r GROUP BY nation)
SELECT nation, m.x AS middle_x, CASE WHEN sqrt((x0 - 5000) ** 2 + (y0 - 5000) ** 2) > sqrt((x1 - 5000) ** 2 + (y1 - 5000) ** 2) THEN x1 ELSE x0 END AS first_x, e.n AS longest FROM e JOIN r m USING (nation) WHERE m.k = m.n // 2 + 1""")
def line_points(spark, d):
    start = S.point(5000.0, 5000.0)
    rings = F.array(F.slice("pts", 1, 1), F.col("pts"), F.reverse("pts"))
    return V.lines(spark, d).select("nation", S.middle("pts")["x"].alias("middle_x"), F.get(S.oriented("pts", start), F.lit(0))["x"].alias("first_x"), _long(F.size(S.longest_ring(rings))).alias("longest"))


@query(f"""WITH {V.SUPPLIER_SITES}, k AS (SELECT *, unnest(range(1, 7)) AS i FROM ss), t AS (SELECT *, i / 6.0::DOUBLE AS t FROM k)
SELECT id, CAST(i AS INTEGER) AS i, round((1 - t) ** 3 * x + 3 * (1 - t) ** 2 * t * (x + 10) + 3 * (1 - t) * t * t * y + t ** 3 * 7, 5) AS px, round((1 - t) ** 3 * y + 3 * (1 - t) ** 2 * t * (y + 10) + 3 * (1 - t) * t * t * x + t ** 3 * 9, 5) AS py FROM t""")
def bezier_chords(spark, d):
    x, y = F.col("x"), F.col("y")
    chords = S.bezier(S.point(x, y), S.point(x + 10, y + 10), S.point(y, x), S.point(7.0, 9.0))
    return V.supplier_sites(spark, d).select("id", F.posexplode(chords).alias("i", "p")).select("id", (F.col("i") + 1).alias("i"), F.round("p.x", 5).alias("px"), F.round("p.y", 5).alias("py"))


@query(f"""WITH {V.SUPPLIER_SITES} SELECT id, CASE id % 4 WHEN 1 THEN 12000 - y WHEN 2 THEN 11000 - x WHEN 3 THEN y ELSE x END AS px, CASE id % 4 WHEN 1 THEN 11000 - x WHEN 2 THEN y WHEN 3 THEN x ELSE 12000 - y END AS py FROM ss""")
def page_space(spark, d):
    p = S.upright(F.struct("x", "y"), 12000.0, (F.col("id") % 4 * 90).cast("int"), 11000.0)
    return V.supplier_sites(spark, d).select("id", p.alias("p")).select("id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(f"""WITH {V.SUPPLIER_SITES}, g AS (SELECT nation, id, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM ss WINDOW o AS (PARTITION BY nation ORDER BY id)), u AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS n FROM g WHERE x2 IS NOT NULL)
SELECT nation, count(*) AS quads, round(sum(x - (x2 - x) / n * 0.08::DOUBLE - (y2 - y) / n * 0.08::DOUBLE), 3) AS sx FROM u WHERE n >= 0.05 GROUP BY nation""")
def wall_quads(spark, d):
    s = V.supplier_sites(spark, d)
    pts = s.groupBy("nation").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("p")).select("nation", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    quads = pts.select("nation", F.explode(S.wall_quads("pts")).alias("q"))
    return quads.groupBy("nation").agg(F.count("*").alias("quads"), F.round(F.sum(F.get("q", F.lit(0))["x"]), 3).alias("sx"))


@query(f"""WITH {V.CUSTOMER_SITES}, {V.NATION_RINGS}, x AS (SELECT cs.id, count(*) FILTER (WHERE (seg.y1 > cs.y) <> (seg.y2 > cs.y) AND cs.x < (seg.x2 - seg.x1) * (cs.y - seg.y1) / (seg.y2 - seg.y1) + seg.x1) AS k,
 min(sqrt((cs.x - x1 - greatest(0, least(1, ((cs.x - x1) * (x2 - x1) + (cs.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (x2 - x1)) ** 2 + (cs.y - y1 - greatest(0, least(1, ((cs.x - x1) * (x2 - x1) + (cs.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) * (y2 - y1)) ** 2)) AS d
 FROM cs JOIN seg ON seg.pid = cs.nation GROUP BY cs.id) SELECT id, k % 2 = 1 OR d <= 500 AS near FROM x""")
def within_buffer(spark, d):
    s = V.customer_sites(spark, d).join(V.nation_rings(spark, d), F.col("nation") == F.col("pid"))
    return s.select("id", S.within(F.struct("x", "y"), F.array("ring"), 500.0).alias("near"))


# rules ------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'relation building' WHEN 1 THEN CASE WHEN p_size >= 4 THEN 'way building' END WHEN 2 THEN 'other' END AS class,
 CASE p_size % 4 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.15::DOUBLE WHEN 2 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM part""")
def way_classes(spark, d):
    m = F.col("p_partkey") % 4
    kind = F.when(m == 0, "relation").when(m == 3, "node").otherwise("way")
    building = F.when(m < 2, "yes")
    points = F.when(m > 0, F.sequence(F.lit(1), F.greatest(F.col("p_size"), F.lit(1))))
    k = F.col("p_size") % 4
    highway = F.when(k == 0, "steps").when(k == 1, "residential").when(k == 2, "service").otherwise("footway")
    return V.table(spark, d, "part").select("p_partkey", R.way_kind(kind, building, points).alias("class"), R.footway_factor(highway).alias("factor"))


_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'tunnel' WHEN 1 THEN 'bridge' ELSE 'doorway' END"


def _links(spark, d):
    m = F.col("p_partkey") % 3
    return V.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.when(m == 0, "tunnel").when(m == 1, "bridge").otherwise("doorway").alias("kind"), F.when(F.col("p_size") % 10 == 0, "closed").otherwise("open").alias("status"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 255 ELSE CASE {_KIND} WHEN 'tunnel' THEN 255 WHEN 'bridge' THEN 45 ELSE 163 END END AS r, CAST(floor(200 * CASE WHEN p_partkey <> 7 THEN 0.35::DOUBLE ELSE 1 END + 0.5) AS BIGINT) AS a,
 round(CASE WHEN {_KIND} = 'doorway' THEN 1.6::DOUBLE ELSE 3.2::DOUBLE END * CASE WHEN p_partkey = 7 THEN 1.6::DOUBLE ELSE 1 END, 6) AS width, CASE WHEN p_partkey % 2 = 0 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END AS lift, p_size - 3 < -0.5 AS under, p_size <= 7 AND 7 - p_size <= 2 AS shown FROM part""")
def link_styles(spark, d):
    s = R.link_style("kind", "status", F.col("p_partkey").cast("string"), "7", 200)
    kind = F.when(F.col("p_partkey") % 2 == 0, "walk").otherwise("indoor")
    return _links(spark, d).select("p_partkey", s["r"].alias("r"), _long(s["a"]).alias("a"), F.round(s["width"], 6).alias("width"), R.route_lift(kind).alias("lift"), R.underground(F.col("p_size") - 3).alias("under"), R.level_shown("p_size", 7, 2).alias("shown"))


@query(f"""SELECT p_partkey, {_KIND} AS kind, CASE {_KIND} WHEN 'tunnel' THEN 0 WHEN 'bridge' THEN 1 ELSE 2 END AS rank, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || ' – ' || p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 'traced' ELSE 'osm:' || p_partkey || ',' || p_size END AS source FROM part WHERE {_KIND} <> 'doorway'""")
def link_names(spark, d):
    ways = F.when(F.col("p_size") % 3 != 0, F.array(F.col("p_partkey"), F.col("p_size").cast("long")))
    shadows = _links(spark, d).where(R.casts_shadow("kind"))
    return shadows.select("p_partkey", "kind", R.kind_rank("kind").alias("rank"), R.link_name(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), "p_brand", "p_name").alias("name"), R.link_source(ways).alias("source"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_size / 50.0::DOUBLE END AS iou, p_partkey % 10 / 100.0::DOUBLE AS margin, p_partkey % 8 AS residual, p_size FROM part)
SELECT p_partkey, CASE WHEN iou IS NULL THEN 'no-footprint' WHEN iou >= 0.62 AND margin >= 0.04 AND residual <= 6 THEN 'auto' ELSE 'needs-review' END AS method, coalesce(iou, 0) >= 0.6 AND margin >= 0.05 AS trusted, abs(p_size - 25) > 3 OR abs(residual - 2) > 3 OR p_partkey % 5 <> 0 AS moved FROM p""")
def georef_rules(spark, d):
    iou, margin, residual = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") / 50.0), F.col("p_partkey") % 10 / 100.0, (F.col("p_partkey") % 8).cast("double")
    turn = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 5).cast("double")
    return V.table(spark, d, "part").select("p_partkey", R.georef_method(iou, margin, residual).alias("method"), R.shift_trusted(F.coalesce(iou, F.lit(0.0)), margin * 10).alias("trusted"), R.moved(F.col("p_size") - 25, residual - 2, turn).alias("moved"))


@query("""WITH h AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 6 = 0 OR p_size = 0 THEN 4.0::DOUBLE WHEN p_size * 1.5::DOUBLE / (p_partkey % 6) BETWEEN 3.0 AND 5.5 THEN round(p_size * 1.5::DOUBLE / (p_partkey % 6), 2) ELSE 4.0::DOUBLE END AS height FROM part)
SELECT p_partkey, height, round((p_size % 5 - 1) * height, 2) AS elev FROM h""")
def floor_heights(spark, d):
    h = R.floor_height(F.col("p_size") * 1.5, F.col("p_partkey") % 6)
    return V.table(spark, d, "part").select("p_partkey", h.alias("height"), R.elevation(F.col("p_size") % 5 - 1, h).alias("elev"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand ELSE 'IHB' || p_size END AS code, p_size % 4 = 0 OR p_size % 4 = 1 OR p_partkey % 7 = 0 AS campus FROM part""")
def building_codes(spark, d):
    m = F.col("p_partkey") % 3
    name = F.when(m == 0, F.concat("p_brand", F.lit(" - "), "p_name")).when(m == 1, F.concat("p_brand", F.lit(" and Z - "), "p_name")).otherwise(F.concat(F.lit("IHB-"), F.col("p_size").cast("string"), F.lit(" - Hall")))
    k = F.col("p_size") % 4
    campus = R.campus(F.when(k == 0, "The Owner").otherwise("x"), F.when(k == 1, "AB"), F.lit(None).cast("string"), F.when(F.col("p_partkey") % 7 == 0, "owner hall"), "Owner")
    return V.table(spark, d, "part").select("p_partkey", R.building_code(name).alias("code"), campus.alias("campus"))


# doors, rooms, floors ---------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS id, CAST(unnest(range(4)) AS INTEGER) AS step, round(greatest(0.15::DOUBLE, (s_nationkey + 1) * (unnest(range(4)) + 1) / 4.0::DOUBLE), 6) AS h, CASE WHEN s_suppkey % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wide FROM supplier""")
def stair_flights(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    shafts = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.when(even, -4.0).otherwise(-1.0).alias("x0"), F.when(even, 4.0).otherwise(1.0).alias("x1"), F.when(even, -1.0).otherwise(-2.0).alias("y0"), F.when(even, 1.0).otherwise(2.0).alias("y1"), (F.col("s_nationkey") + 1).cast("double").alias("rise"))
    s = polyline.stair_steps(shafts, 4)
    wide = F.when(F.col("id") % 2 == 0, F.col("x1") - F.col("x0")).otherwise(F.col("y1") - F.col("y0"))
    return s.select("id", "step", F.round("h", 6).alias("h"), F.round(wide, 6).alias("wide"))


_LEVELS = "lv AS (SELECT DISTINCT l_suppkey AS code, l_linenumber AS level, l_linenumber * 4.0::DOUBLE AS elev FROM lineitem)"


def _levels(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("code"), F.col("l_linenumber").alias("level"), (F.col("l_linenumber") * 4.0).alias("elev")).distinct()


@query(f"WITH {_LEVELS} SELECT code, level, lead(level) OVER w AS above, lead(elev) OVER w - elev AS rise FROM lv WINDOW w AS (PARTITION BY code ORDER BY level)")
def next_levels(spark, d):
    return lookup.next_above(_levels(spark, d)).select("code", "level", "above", "rise")


_STOPS = "st AS (SELECT DISTINCT l_suppkey AS code, CASE WHEN l_partkey % 2 = 0 THEN 'stair' ELSE 'elevator' END AS kind, l_partkey % 400 AS shaft, l_linenumber AS level FROM lineitem)"


def _stops(spark, d):
    li = V.table(spark, d, "lineitem")
    s = li.select(F.col("l_suppkey").alias("code"), F.when(F.col("l_partkey") % 2 == 0, "stair").otherwise("elevator").alias("kind"), (F.col("l_partkey") % 400).alias("shaft"), F.col("l_linenumber").alias("level")).distinct()
    return s.select("*", (F.col("level") * 10).alias("node"), (F.col("level") * 4.0).alias("elev"), F.lit(3.0).alias("diagonal"))


@query(f"""WITH {_STOPS}, n AS (SELECT *, lead(level) OVER (PARTITION BY code, kind, shaft ORDER BY level) AS up FROM st)
SELECT code, kind, shaft, level AS a_level, up AS b_level, level * 10 AS a_node, up * 10 AS b_node, (up - level) * 4.0::DOUBLE AS rise, round(CASE WHEN kind = 'stair' THEN 3 * 1.8::DOUBLE + (up - level) * 4 ELSE (up - level) * 4.0::DOUBLE + 12 END, 6) AS m FROM n WHERE up IS NOT NULL""")
def vertical_edges(spark, d):
    return indoor.vertical_edges(_stops(spark, d)).withColumn("m", F.round("m", 6))


@query(f"WITH {_STOPS} SELECT code, kind, shaft, count(DISTINCT level) AS n FROM st GROUP BY 1, 2, 3 HAVING count(DISTINCT level) < 2")
def single_level_shafts(spark, d):
    return indoor.single_level_shafts(_stops(spark, d))


def _rooms(spark, d):
    li = V.table(spark, d, "lineitem")
    number = F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 900 + 100).cast("string"))
    return li.select(F.col("l_suppkey").cast("string").alias("code"), F.col("l_linenumber").alias("level"), number.alias("number"), F.col("l_orderkey").alias("ord"), F.when(F.col("l_quantity") > 5, F.col("l_orderkey")).alias("node"))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS code, count(*) FILTER (WHERE l_partkey % 3 <> 0) AS named, count(*) AS total FROM lineitem GROUP BY ROLLUP (CAST(l_suppkey AS VARCHAR))""")
def room_coverage(spark, d):
    return indoor.room_coverage(_rooms(spark, d))


@query("""SELECT l_linenumber AS level, l_orderkey AS ord, '150' AS number FROM lineitem WHERE l_suppkey = 7 AND l_partkey % 3 <> 0 AND l_partkey % 900 + 100 = 150 AND l_quantity > 5 ORDER BY 1, 2 LIMIT 1""")
def find_room(spark, d):
    return indoor.find_room(_rooms(spark, d).where("ord >= 0"), "7", " 1 50 ").select("level", "ord", "number")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS code, array_to_string(l.levels, ',') AS levels, array_to_string(l.elev, ',') AS elev, coalesce(r.rooms, 0) AS rooms, CASE WHEN s_suppkey % 2 = 0 THEN 'auto' END AS georef FROM
 (SELECT l_suppkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS levels, list(DISTINCT l_linenumber * 4 ORDER BY l_linenumber * 4) AS elev FROM lineitem GROUP BY 1) l JOIN supplier ON s_suppkey = l_suppkey
 LEFT JOIN (SELECT l_suppkey, count(*) AS rooms FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1) r USING (l_suppkey)""")
def floor_index(spark, d):
    levels = _levels(spark, d).select(F.col("code").cast("string").alias("code"), "level", F.col("elev").cast("int").alias("elev"), F.lit("x").alias("label"))
    methods = V.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("code"), F.lit("auto").alias("method"))
    out = indoor.index(levels, _rooms(spark, d), methods)
    return out.select("code", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"), F.array_join(F.transform("elev", lambda x: x.cast("string")), ",").alias("elev"), "rooms", "georef")


@query(f"""WITH {V.CUSTOMER_SITES}, {V.NATION_RINGS}, x AS (SELECT cs.id, seg.pid, count(*) AS k FROM cs, seg WHERE (seg.y1 > cs.y) <> (seg.y2 > cs.y) AND cs.x < (seg.x2 - seg.x1) * (cs.y - seg.y1) / (seg.y2 - seg.y1) + seg.x1 GROUP BY 1, 2),
i AS (SELECT pid, id, id % 97 / 100.0::DOUBLE AS conf FROM x WHERE k % 2 = 1) SELECT pid, CAST(arg_min(id, -conf * 1000000 + id / 1000000.0) AS VARCHAR) AS text, max(conf) AS conf FROM i GROUP BY pid""")
def label_rooms(spark, d):
    labels = V.customer_sites(spark, d).select(F.col("id").cast("string").alias("text"), (F.col("id") % 97 / 100.0).alias("conf"), F.col("id").alias("ord"), "x", "y")
    return spatial.label_rooms(labels, V.nation_rings(spark, d), 1000.0)


@query(f"""WITH {V.SUPPLIER_SITES}, {V.CUSTOMER_SITES}, p AS (SELECT ss.id, cs.id AS near_id, sqrt((ss.x - cs.x) ** 2 + (ss.y - cs.y) ** 2) AS d, sqrt((ss.x + 50 - cs.x) ** 2 + (ss.y - cs.y) ** 2) AS d2 FROM ss, cs),
f AS (SELECT id, near_id, d, 'centroid' AS stage FROM p WHERE d < 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, near_id) = 1),
s AS (SELECT id, near_id, d2 AS d, 'vertex' AS stage FROM p WHERE d2 < 40 AND id NOT IN (SELECT id FROM f) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, near_id) = 1)
SELECT id, near_id, round(d, 4) AS d, stage FROM f UNION ALL SELECT id, near_id, round(d, 4), stage FROM s""")
def snap_doors(spark, d):
    doors = V.supplier_sites(spark, d).select("id", "x", "y")
    out = spatial.snap(doors, doors.withColumn("x", F.col("x") + 50), V.customer_sites(spark, d).select("id", "x", "y"))
    return out.select("id", "near_id", F.round("d", 4).alias("d"), "stage")


@query(f"""WITH {V.SUPPLIER_SITES}, {V.CUSTOMER_SITES} SELECT ss.id, min(sqrt((ss.x - cs.x) ** 2 + (ss.y - cs.y) ** 2)) AS d FROM ss, cs WHERE sqrt((ss.x - cs.x) ** 2 + (ss.y - cs.y) ** 2) < 250 GROUP BY ss.id""")
def locate(spark, d):
    return lookup.locate(V.supplier_sites(spark, d), V.customer_sites(spark, d)).select("id", "d")


_PAIR = f"""{V.SUPPLIER_SITES}, corner AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) v(i, dx, dy)),
av AS (SELECT id, i, x + dx * 50 + dy * (id % 7) AS x, y + dy * 50 - dx * (id % 5) AS y FROM ss, corner), bv AS (SELECT id, i, x + 150 + id % 40 + dx * 20 - dy * (id % 3) AS x, y - 40 + id % 130 + dy * 20 + dx * (id % 11) AS y FROM ss, corner),
ae AS (SELECT p.id, p.i, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM av p JOIN av q ON q.id = p.id AND q.i = (p.i + 1) % 4), be AS (SELECT p.id, p.i, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM bv p JOIN bv q ON q.id = p.id AND q.i = (p.i + 1) % 4),
vs AS (SELECT v.id, 0 AS side, v.i AS vi, e.i AS si, v.x AS px, v.y AS py, e.* EXCLUDE (id, i) FROM av v JOIN be e ON e.id = v.id UNION ALL SELECT v.id, 1, v.i, e.i, v.x, v.y, e.* EXCLUDE (id, i) FROM bv v JOIN ae e ON e.id = v.id),
t AS (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM vs), n AS (SELECT *, x1 + t * (x2 - x1) AS qx, y1 + t * (y2 - y1) AS qy FROM t),
best AS (SELECT *, sqrt((px - qx) ** 2 + (py - qy) ** 2) AS d FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sqrt((px - qx) ** 2 + (py - qy) ** 2), 9), side, vi, si) = 1)"""


@query(f"""WITH {_PAIR} SELECT id, round(d, 6) AS d, round(CASE side WHEN 0 THEN px ELSE qx END, 6) AS ax, round(CASE side WHEN 0 THEN py ELSE qy END, 6) AS ay, round(CASE side WHEN 0 THEN qx ELSE px END, 6) AS bx, round(CASE side WHEN 0 THEN qy ELSE py END, 6) AS by FROM best""")
def outline_pairs(spark, d):
    """Two skewed quadrangles at each supplier: their nearest points and distance."""
    k = F.col("id")
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    a = F.array(*(S.point(F.col("x") + dx * 50 + dy * (k % 7), F.col("y") + dy * 50 - dx * (k % 5)) for dx, dy in corners))
    b = F.array(*(S.point(F.col("x") + 150 + k % 40 + dx * 20 - dy * (k % 3), F.col("y") - 40 + k % 130 + dy * 20 + dx * (k % 11)) for dx, dy in corners))
    got = spatial.nearest_pair(V.supplier_sites(spark, d).select("id", a.alias("a"), b.alias("b")))
    return got.select("id", *(F.round(x, 6).alias(n) for x, n in (("d", "d"), ("p.x", "ax"), ("p.y", "ay"), ("q.x", "bx"), ("q.y", "by"))))


_QUAD = lambda k, x, y: tuple((f"{x} + {dx} * (30 + {k} % 17) - {dy} * ({k} % 13)", f"{y} + {dy} * (25 + {k} % 19) + {dx} * ({k} % 7)") for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)))
_QUAD_SQL = lambda name, sites: f"{name} AS (SELECT id, i, x1, y1, x2, y2 FROM ({' UNION ALL '.join(f'SELECT id, {i} AS i, {_QUAD("id", "x", "y")[i][0]} AS x1, {_QUAD("id", "x", "y")[i][1]} AS y1, {_QUAD("id", "x", "y")[(i + 1) % 4][0]} AS x2, {_QUAD("id", "x", "y")[(i + 1) % 4][1]} AS y2 FROM {sites}' for i in range(4))}))"


@query(f"""WITH {V.SUPPLIER_SITES}, {V.CUSTOMER_SITES}, {_QUAD_SQL("ls", "ss")}, {_QUAD_SQL("rs", "cs")},
vs AS (SELECT l.id, r.id AS near_id, 0 AS side, l.i AS ve, r.i AS ee, l.x1 AS vx, l.y1 AS vy, r.x1, r.y1, r.x2, r.y2 FROM ls l, rs r UNION ALL SELECT l.id, r.id, 1, r.i, l.i, r.x1, r.y1, l.x1, l.y1, l.x2, l.y2 FROM ls l, rs r),
n AS (SELECT *, greatest(0, least(1, ((vx - x1) * (x2 - x1) + (vy - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM vs), q AS (SELECT *, x1 + t * (x2 - x1) AS qx, y1 + t * (y2 - y1) AS qy FROM n),
m AS (SELECT id, near_id, side, vx, vy, qx, qy, sqrt((vx - qx) ** 2 + (vy - qy) ** 2) AS d FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt((vx - qx) ** 2 + (vy - qy) ** 2), near_id, side, ve, ee) = 1)
SELECT id, near_id, round(d, 6) AS d, round(CASE side WHEN 0 THEN vx ELSE qx END, 4) AS px, round(CASE side WHEN 0 THEN vy ELSE qy END, 4) AS py, round(CASE side WHEN 0 THEN qx ELSE vx END, 4) AS qx, round(CASE side WHEN 0 THEN qy ELSE vy END, 4) AS qy FROM m""")
def nearest_outlines(spark, d):
    """For a quadrangle at each supplier the nearest one of the customers'."""
    ring = F.array(*(S.point(F.expr(x), F.expr(y)) for x, y in _QUAD("id", "x", "y")))
    own, other = (f(spark, d).select("id", ring.alias("ring")) for f in (V.supplier_sites, V.customer_sites))
    got = spatial.nearest_outlines(own, other, 40.0)
    return got.select("id", "near_id", *(F.round(x, n).alias(a) for x, n, a in (("d", 6, "d"), ("p.x", 4, "px"), ("p.y", 4, "py"), ("q.x", 4, "qx"), ("q.y", 4, "qy"))))


@query(f"""WITH {V.CUSTOMER_SITES}, {V.NATION_RINGS}, x AS (SELECT cs.id, cs.nation, seg.pid, count(*) AS k FROM cs, seg WHERE (seg.y1 > cs.y) <> (seg.y2 > cs.y) AND cs.x < (seg.x2 - seg.x1) * (cs.y - seg.y1) / (seg.y2 - seg.y1) + seg.x1 GROUP BY 1, 2, 3)
SELECT id, nation AS code, pid FROM x WHERE k % 2 = 1 AND pid <> nation""")
def other_footprints(spark, d):
    prints = V.nation_rings(spark, d).select(F.col("pid").alias("code"), F.array("ring").alias("rings"))
    points = V.customer_sites(spark, d).select("id", F.col("nation").alias("code"), "x", "y")
    return georef.others(prints, points).select("id", "code", "pid")


@query(f"""WITH {V.SUPPLIER_SITES}, l(level, elev, ord) AS (VALUES (0, 0, 0), (1, 9, 1), (2, 21, 2)), pt AS (SELECT ss.id, ss.nation AS code, ss.x, ss.y, arg_min(level, abs(elev - ss.id % 30) * 100 + ord) AS level FROM ss, l GROUP BY 1, 2, 3, 4),
{V.CUSTOMER_SITES}, n AS (SELECT nation AS code, id % 3 AS level, id, x, y FROM cs)
SELECT pt.code, pt.id, CASE WHEN pt.code % 2 = 0 THEN 'fail' ELSE 'warn' END AS severity FROM pt WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.code = pt.code AND n.level = pt.level AND sqrt((n.x - pt.x) ** 2 + (n.y - pt.y) ** 2) <= 900)""")
def portal_audit(spark, d):
    portals = V.supplier_sites(spark, d).select(F.col("nation").alias("code"), "id", (F.col("id") % 30).alias("z"), "x", "y")
    nations = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("code"))
    levels = nations.withColumn("l", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("level"), F.lit(e).alias("elev"), F.lit(i).alias("ord")) for i, e in enumerate((0, 9, 21)))))).select("code", "l.*", F.lit(50).alias("nodes"))
    nodes = V.customer_sites(spark, d).select(F.col("nation").alias("code"), (F.col("id") % 3).alias("level"), "id", "x", "y")
    tiers = nations.select("code", F.when(F.col("code") % 2 == 0, "A").otherwise("C").alias("tier"))
    return spatial.portal_audit(portals, levels, nodes, tiers, 900.0).select("code", "id", "severity")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'missing end' WHEN n.n_name IS NULL THEN 'unknown building' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'same building' END AS problem FROM orders LEFT JOIN nation n ON n_nationkey = o_custkey % 30""")
def request_checks(spark, d):
    o = V.table(spark, d, "orders")
    n = V.table(spark, d, "nation").select(F.upper("n_name").alias("code"), F.col("n_nationkey").alias("k"))
    named = o.join(n, F.col("o_custkey") % 30 == F.col("k"), "left").withColumn("code", F.coalesce("code", F.lit("NOWHERE")))
    other = F.when(F.col("o_orderkey") % 3 == 0, F.col("code")).otherwise(F.lit("  home"))
    asked = named.select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.lower("code"))).alias("from"), other.alias("to"), F.when(F.col("o_orderkey") % 2 == 1, "101").alias("room"))
    known = n.select("code").unionByName(spark.createDataFrame([("HOME",)], "code string"))
    return lookup.check_request(asked, known).select("o_orderkey", "problem")


@query("""WITH n AS (SELECT CAST(s_nationkey AS VARCHAR) AS code, arg_max(s_name, s_suppkey) AS name FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1) SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS code, coalesce(n.name, CAST(c_nationkey AS VARCHAR)) AS name FROM customer LEFT JOIN n ON n.code = CAST(c_nationkey AS VARCHAR)""")
def routable_buildings(spark, d):
    nodes = V.table(spark, d, "customer").select(F.concat(F.lit("X:"), F.col("c_nationkey").cast("string")).alias("id"))
    names = V.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").cast("string").alias("code"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return lookup.routable(nodes, names)


@query("""WITH t AS (SELECT l_suppkey AS code, l_linenumber AS level, sum(CAST(l_quantity AS BIGINT)) AS length FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(length) OVER (PARTITION BY code) AS top FROM t) SELECT code, level AS file FROM m QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN level = 1 AND length >= 0.7 * top THEN 0 ELSE 1 END, length DESC, level) = 1""")
def reference_floors(spark, d):
    t = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.col("l_linenumber").alias("file")).agg(F.sum(_long("l_quantity")).alias("length"))
    return georef.reference_floor(t.withColumn("level", F.col("file") - 1)).select("code", "file")


@query("""WITH c AS (SELECT l_suppkey AS code, l_partkey % 4 * 90 + l_linenumber % 3 AS degrees, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), b AS (SELECT code, degrees AS d0, score AS best FROM c QUALIFY row_number() OVER (PARTITION BY code ORDER BY score DESC, degrees) = 1)
SELECT code, best, round(coalesce(best - max(score) FILTER (WHERE abs((degrees - d0 + 180 + 720) % 360 - 180) > 20), 1), 4) AS margin FROM c JOIN b USING (code) GROUP BY code, best""")
def fit_margins(spark, d):
    c = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code"), (F.col("l_partkey") % 4 * 90 + F.col("l_linenumber") % 3).cast("double").alias("degrees")).agg(F.max("l_extendedprice").alias("score"))
    return georef.margin(c.withColumn("mirror", F.lit(False)), "code").withColumn("margin", F.round("margin", 4))


# graphs and routes ------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey * 7 % 10007 AS id, CAST(row_number() OVER (ORDER BY s_suppkey * 7 % 10007) - 1 AS INTEGER) AS i FROM supplier")
def dense_index(spark, d):
    return graph.reindex(V.table(spark, d, "supplier").select((F.col("s_suppkey") * 7 % 10007).alias("id")), "id")


@query("""WITH e AS (SELECT c_custkey AS id, c_custkey AS a, c_custkey // 2 AS b, c_custkey % 10 AS length FROM customer WHERE c_custkey > 0) SELECT count(*) AS edges, count(DISTINCT a) AS nodes FROM e""")
def reversed_edges(spark, d):
    e = V.table(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 2).alias("b"), F.array(F.col("c_custkey"), F.lit(0)).alias("geom"))
    both = graph.both_ways(e, "geom")
    mine = both.where((F.get("geom", F.lit(1)) == 0) | (F.col("a") == 0) & (F.get("geom", F.lit(0)) == 0) & (F.col("b") != 0))
    return mine.where(F.get("geom", F.lit(1)) == 0).agg(F.count("*").alias("edges"), F.countDistinct("a").alias("nodes"))


def _campus(spark, d):
    """Links between nations from their suppliers' orders: a link for each pair of nations of neighbouring lines."""
    lines, _ = V.neighbouring_lines(spark, d, nations=True)
    pairs = lines.where("na <> nb").groupBy(F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb")).agg(F.min("w").alias("w"))  # few groups: combined before the shuffle
    place = lambda n, k: F.struct(((n * 37 + k) % 25 / 1000.0).alias("lon"), ((n * 11 + k) % 25 / 1000.0).alias("lat"))
    return pairs.select(F.concat_ws("-", "na", "nb").alias("id"), F.col("na").cast("string").alias("from"), F.col("nb").cast("string").alias("to"), F.lit("bridge").alias("kind"), F.lit(3).alias("z_m"), F.lit(None).cast("string").alias("name"),
                        F.when(F.col("w") % 7 == 0, "closed").otherwise("open").alias("status"), F.lit(True).alias("verified"), F.lit(None).cast("string").alias("notes"), F.col("w").cast("int").alias("length_m"), F.array(place(F.col("na"), F.col("nb")), place(F.col("nb"), F.col("na"))).alias("geom"))


_CAMPUS = f"""{V.SUPPLIER_ARCS}, link AS (SELECT x.s_nationkey AS na, y.s_nationkey AS nb, min(w) AS w FROM arcs JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b WHERE x.s_nationkey < y.s_nationkey GROUP BY 1, 2),
open AS (SELECT na || '-' || nb AS id, * FROM link WHERE w % 7 <> 0),
portal AS (SELECT 'P:' || id || ':' || na AS id, na AS n, (na * 37 + nb) % 25 / 1000.0::DOUBLE AS lon, (na * 11 + nb) % 25 / 1000.0::DOUBLE AS lat FROM open UNION ALL SELECT 'P:' || id || ':' || nb, nb, (nb * 37 + na) % 25 / 1000.0::DOUBLE, (nb * 11 + na) % 25 / 1000.0::DOUBLE FROM open),
node AS (SELECT * FROM portal UNION ALL SELECT 'B:' || n, n, avg(lon), avg(lat) FROM portal GROUP BY n)"""


@query(f"""WITH {_CAMPUS}, i AS (SELECT a.id AS a, b.id AS b, greatest(5, 1.25 * sqrt(((a.lon - b.lon) * {_MX}) ** 2 + ((a.lat - b.lat) * {_MY}) ** 2)) AS m FROM node a JOIN node b ON a.n = b.n AND a.id <> b.id)
SELECT a, b, 'intra' AS kind, round(m, 3) AS m FROM i UNION ALL SELECT 'P:' || id || ':' || na, 'P:' || id || ':' || nb, 'indoor', w FROM open UNION ALL SELECT 'P:' || id || ':' || nb, 'P:' || id || ':' || na, 'indoor', w FROM open""")
def campus_arcs(spark, d):
    _, arcs = route.portal_arcs(_campus(spark, d))
    return arcs.select("a", "b", "kind", F.round("m", 3).alias("m"))


@query(f"WITH {_CAMPUS}, x AS (SELECT 'P:' || id || ':' || na AS id FROM link l JOIN (SELECT na || '-' || nb AS id, na AS n0, nb AS n1 FROM link) k ON k.n0 = l.na AND k.n1 = l.nb) SELECT x.id FROM x WHERE x.id IN (SELECT id FROM portal)")
def alive_nodes(spark, d):
    links = _campus(spark, d)
    nodes = links.select(F.concat_ws(":", F.lit("P"), "id", "from").alias("id"))
    edges = spark.createDataFrame([], "a string, b string")
    return route.alive_edges(edges, nodes, links)[0].select("id")


@query(f"""WITH {V.CUSTOMER_SITES}, g AS (SELECT nation, id, x, y, row_number() OVER o - 1 AS seg, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM cs WINDOW o AS (PARTITION BY nation ORDER BY id)),
h AS (SELECT *, atan2(x2 - x, y2 - y) AS b, greatest(1, CAST(floor(sqrt((x2 - x) ** 2 + (y2 - y) ** 2) / 500 + 0.5) AS BIGINT)) AS n FROM g WHERE x2 IS NOT NULL),
k AS (SELECT *, unnest(range(n)) AS k FROM h),
f AS (SELECT nation, row_number() OVER w - 1 AS n, seg, x + (x2 - x) * (k / n) AS px, sum(sin(b)) OVER r AS ss, sum(cos(b)) OVER r AS sc, percent_rank() OVER w AS t FROM k WINDOW w AS (PARTITION BY nation ORDER BY seg, k), r AS (PARTITION BY nation ORDER BY seg, k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT nation, CAST(n AS INTEGER) AS n, CAST(seg AS BIGINT) AS seg, round(px / 500, 8) AS px, CAST(floor(((degrees(atan2(ss, sc)) + 360) % 360) * 1000 + 0.5) AS BIGINT) % 360000 AS millidegrees, round(t, 6) AS t, 82.0::DOUBLE AS pitch FROM f""")
def route_frames(spark, d):
    """Frames along each nation's customers as a route, at a scale of 500."""
    lines = V.lines(spark, d).select("nation", F.posexplode(S.segments("pts")).alias("hop", "s"))
    at = lambda p: F.struct((p["x"] / 500 / S.MX).alias("lon"), (p["y"] / 500 / S.MY).alias("lat"), F.lit(1.0).alias("z"))
    segments = lines.select("nation", _long("hop").alias("hop"), F.array(at(F.col("s.a")), at(F.col("s.b"))).alias("coords"))
    f = route.frames(segments, ("nation",))
    return f.select("nation", "n", "seg", F.round(F.col("lon") * S.MX, 8).alias("px"), (_long(S.round_up(F.col("bearing") * 1000)) % 360000).alias("millidegrees"), F.round("t", 6).alias("t"), "pitch")


@query("""WITH s AS (SELECT o_custkey % 50 AS code, o_orderkey % 4 AS level, o_orderkey AS i FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY code, level ORDER BY i) AS k, count(*) OVER (PARTITION BY code, level) AS n FROM s)
SELECT CAST(code AS VARCHAR) AS code, CAST(level AS DOUBLE) AS level, 1 + count(*) FILTER (WHERE k % 40 = 3 AND k < n) AS parts FROM k GROUP BY 1, 2 HAVING count(*) FILTER (WHERE k % 40 = 3 AND k < n) > 0""")
def split_levels(spark, d):
    """Levels whose chains of nodes lack every fortieth edge."""
    from pyspark.sql import Window

    s = V.table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("code"), (F.col("o_orderkey") % 4).cast("double").alias("level"), F.col("o_orderkey").alias("i"))
    w = Window.partitionBy("code", "level").orderBy("i")
    e = s.select("code", "level", F.col("i").alias("a"), F.lead("i").over(w).alias("b"), F.row_number().over(w).alias("k")).where("k % 40 <> 3 AND b IS NOT NULL")
    return quality.split_levels(s, e)


@query("""SELECT l_suppkey AS code, CAST(l_linenumber AS BIGINT) AS level, l_partkey AS i FROM lineitem WHERE l_partkey % 50 = 1 GROUP BY 1, 2, 3""")
def dangling_edges(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("code"), _long("l_linenumber").alias("level"), F.col("l_partkey").alias("a"), F.col("l_partkey").alias("b"))
    nodes = li.where("a % 50 <> 1").select("code", "level", F.col("a").alias("i"))
    return quality.dangling(li, nodes)


@query(f"""WITH {_STOPS} SELECT code, count(DISTINCT level) AS n FROM st WHERE kind = 'stair' AND code % 4 = 0 GROUP BY code HAVING count(DISTINCT level) >= 2""")
def unlinked_stairs(spark, d):
    stops = _stops(spark, d)
    return quality.unlinked_stairs(stops, indoor.vertical_edges(stops).where("code % 4 <> 0"))


@query("""SELECT n_nationkey AS a, r_regionkey AS b FROM nation, region WHERE n_regionkey <> r_regionkey AND n_nationkey <> r_regionkey AND NOT EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey = r_regionkey AND m.n_regionkey = nation.n_nationkey)""")
def missing_links(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("from"), F.col("n_regionkey").alias("to"))
    r = V.table(spark, d, "region").select(F.col("r_regionkey").alias("b"))
    required = n.select(F.col("from").alias("a")).crossJoin(F.broadcast(r)).where("a <> b")  # nations by regions: a stated small set
    return quality.missing_pairs(required, n)


@query("""SELECT l_suppkey AS code, CAST(l_linenumber AS BIGINT) AS level, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2 ORDER BY code, coalesce(level, 99) LIMIT 40""")
def preview_list(spark, d):
    t = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code"), _long("l_linenumber").alias("level")).agg(F.max("l_quantity").alias("q"))
    return quality.preview(t, 40)


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS building FROM supplier UNION SELECT CAST(s_suppkey % 37 AS VARCHAR) FROM supplier""")
def linked_buildings(spark, d):
    s = V.table(spark, d, "supplier")
    return route.linked_buildings(s.select(F.col("s_nationkey").cast("string").alias("from"), (F.col("s_suppkey") % 37).cast("string").alias("to")))


@query(f"""WITH {V.SUPPLIER_ARCS} SELECT 'node' AS part, 'all' AS kind, count(*) AS n, 0.0::DOUBLE AS metres FROM supplier UNION ALL SELECT 'edge', CASE WHEN w % 2 = 0 THEN 'outdoor' ELSE 'indoor' END, count(*), CAST(sum(w) AS DOUBLE) FROM arcs GROUP BY 2""")
def build_statistics(spark, d):
    nodes = V.table(spark, d, "supplier").select(F.lit("all").alias("kind"))
    edges = V.supplier_arcs(spark, d).select(F.when(F.col("w") % 2 == 0, "outdoor").otherwise("indoor").alias("kind"), F.col("w").cast("double").alias("m"))
    return quality.build_statistics(nodes, edges)


@query("""WITH dr AS (SELECT l_suppkey AS file, CASE l_partkey % 4 WHEN 0 THEN 'A-WALL' WHEN 1 THEN 'A-DOOR' WHEN 2 THEN '' ELSE 'misc' END AS layer, l_quantity AS items FROM lineitem),
c AS (SELECT file, CASE layer WHEN 'A-WALL' THEN 'wall' WHEN 'A-DOOR' THEN 'door' WHEN '' THEN 'unlayered' ELSE 'other' END AS class, sum(CAST(items AS BIGINT)) AS n FROM dr GROUP BY 1, 2)
SELECT CAST(file AS VARCHAR) AS file, CASE WHEN bool_or(class <> 'unlayered') THEN 'B' ELSE 'C' END AS tier, CAST(sum(n) FILTER (WHERE class = 'wall') AS BIGINT) AS walls FROM c GROUP BY file""")
def plan_corpus(spark, d):
    m = F.col("l_partkey") % 4
    layer = F.when(m == 0, "A-WALL").when(m == 1, "A-DOOR").when(m == 2, "").otherwise("misc")
    drawings = V.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), layer.alias("layer"), _long("l_quantity").alias("items"))
    labels = V.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.lit("1st Floor").alias("label"))
    out = maps.plan_corpus(drawings, labels)
    return out.select("file", "tier", F.try_element_at("per_class", F.lit("wall")).alias("walls"))


@query("""SELECT s_suppkey AS file, CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM supplier WHERE s_suppkey % 5 <> 0""")
def plan_walls(spark, d):
    line = F.array(S.point(0.0, 0.0), S.point(1.0, 1.0))
    none = F.slice(F.array(line), 1, 0)
    m = F.col("s_suppkey") % 3
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.create_map(F.lit("wall"), F.when(m == 0, F.array(line, line)).otherwise(none), F.lit("unlayered"), F.when(m == 2, none).otherwise(F.array(line))).alias("classes"))
    files = V.table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("file"))
    return maps.wall_lines(maps.present(files, s)).select("file", F.size("walls").alias("n"))


# registration -----------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT c_nationkey AS code, count(*) AS n FROM customer GROUP BY 1) SELECT code, (5 + code * 3 % 40)::DOUBLE AS degrees, 1 + code % 3 * 0.2::DOUBLE AS scale, true AS placed, 'auto' AS method FROM n""")
def registration(spark, d):
    """L-shaped plans turned, scaled and moved as footprints: the turn, scale and place that registration finds for each, and whether it takes them over."""
    n = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("n"))
    n = graph.kept(n.select("code", (36 + F.col("n") % 5).alias("a"), (12 + F.col("code") % 3).alias("b"), (26 + F.col("n") % 4).alias("e"), (5 + F.col("code") * 3 % 40).cast("double").alias("turn"), (1 + F.col("code") % 3 * 0.2).alias("size"), (F.col("code") * 10).cast("double").alias("tx"), (F.col("code") * -7).cast("double").alias("ty")))
    grid = n.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("e") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("a") - 1)))
    name = F.col("code").cast("string").alias("code")
    plans = graph.kept(grid.where("r < b OR c < 18").select(name, "r", "c"))
    corner = lambda x, y: S.point(S.c(x).cast("double"), S.c(y).cast("double"))
    outline = F.array(corner(F.lit(0), F.lit(0)), corner("a", F.lit(0)), corner("a", "b"), corner(F.lit(18), "b"), corner(F.lit(18), "e"), corner(F.lit(0), "e"))
    moved = F.transform(outline, lambda p: S.affine(p, F.col("size"), F.col("turn"), False, F.col("tx"), F.col("ty")))
    angles = graph.kept(georef.dominant_angle(n.select(name, outline.alias("pts")), "code"))
    found = georef.register(plans, graph.kept(n.select(name, F.array(moved).alias("rings"))), 1.0, angles).withColumn("code", F.col("code").cast("int")).withColumnsRenamed({"tx": "tx_", "ty": "ty_"}).join(n, "code")
    off = F.abs(F.pmod(F.col("degrees") - F.col("turn") + 180, F.lit(360.0)) - 180)
    middle = corner(F.lit(9), F.lit(6))
    there = lambda size, turn, tx, ty: S.affine(middle, F.col(size), F.col(turn), False, F.col(tx), F.col(ty))
    placed = S.distance(there("scale", "degrees", "tx_", "ty_"), there("size", "turn", "tx", "ty")) < 1.5
    return found.select("code", F.when(off < 2, F.col("turn")).otherwise(F.col("degrees")).alias("degrees"), F.when(F.abs(F.col("scale") / F.col("size") - 1) < 0.05, F.col("size")).otherwise(F.col("scale")).alias("scale"), placed.alias("placed"), "method")
