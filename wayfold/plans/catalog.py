"""The queries of the engine's own operators, each with its SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scalars as S
from ..operators import georef, graph, indoor, polyline, quality, route, spatial, tiles
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _long(x) -> F.Column:
    return S.c(x).cast("long")


# filters, rules, sorts --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus = 'F' AS verified FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'")
def link_filter(spark, d):
    o = V.table(spark, d, "orders").withColumn("verified", F.col("o_orderstatus") == "F")
    return o.where(R.visible("o_orderpriority", "verified", ["1-URGENT", "2-HIGH"], False)).select("o_orderkey", "o_orderpriority", "verified")


@query("""SELECT p_partkey, p_name, p_brand, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END AS rank FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring') ORDER BY rank, p_brand, p_partkey""")
def link_search_sort(spark, d):
    rank = R.kind_rank(F.when(F.col("p_type") == "PROMO", "tunnel").when(F.col("p_type") == "LARGE", "bridge").otherwise("doorway"))
    found = V.table(spark, d, "part").where(R.matches(" RING ", "p_name", "p_brand", "p_type"))
    return found.select("p_partkey", "p_name", "p_brand", rank.alias("rank")).orderBy("rank", "p_brand", "p_partkey")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY 1")
def kind_counts(spark, d):
    return V.trace(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), _long(F.sum(F.when(F.col("value") > 10, 1).otherwise(0))).alias("large"))


#: What each layer is, told by hand; of a part's name the words that it may hold, the first of them deciding.
_LAYERS = {"B-SP-ROOM_NO": "room_no", "A-ELEV": "elevator", "x STR y": "stair", "Door-1": "door", "WIN": "window", "COL": "column", "B-BP-WALL": "wall", "B-SP-X": "site", "legend": "title", "furniture": "fixture"}
_LAYER_SQL = " ".join(f"WHEN layer = '{x}' THEN '{n}'" for x, n in _LAYERS.items())


@query(f"""WITH l AS (SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN 'B-SP-ROOM_NO' WHEN 1 THEN 'A-ELEV' WHEN 2 THEN 'x STR y' WHEN 3 THEN 'Door-1' WHEN 4 THEN 'WIN' WHEN 5 THEN 'COL' WHEN 6 THEN 'B-BP-WALL'
 WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN 'B-SP-X' WHEN 10 THEN 'legend' WHEN 11 THEN 'furniture' ELSE p_name END AS layer FROM part),
k AS (SELECT p_partkey, CASE WHEN coalesce(layer, '') = '' THEN 'unlayered' {_LAYER_SQL} ELSE 'other' END AS class FROM l)
SELECT p_partkey, class, CASE WHEN class <> 'unlayered' AND class = 'room_no' THEN 'A' WHEN class <> 'unlayered' THEN 'B' ELSE 'C' END AS tier FROM k""")
def rule_classify(spark, d):
    names = ["B-SP-ROOM_NO", "A-ELEV", "x STR y", "Door-1", "WIN", "COL", "B-BP-WALL", "", None, "B-SP-X", "legend", "furniture"]
    m = F.col("p_partkey") % 13
    layer = F.when(m == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        layer = layer.when(m == i, F.lit(n))
    out = V.table(spark, d, "part").select("p_partkey", R.layer_class(layer.otherwise(F.col("p_name"))).alias("class"))
    return out.withColumn("tier", R.tier(F.col("class") != "unlayered", (F.col("class") == "room_no").cast("int")))


@query("""WITH l AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'st' WHEN p_size % 10 = 2 AND p_size % 100 <> 12 THEN 'nd' WHEN p_size % 10 = 3 AND p_size % 100 <> 13 THEN 'rd' ELSE 'th' END || ' Floor'
 WHEN 1 THEN 'Basement' WHEN 2 THEN '2nd Floor Mezzanine' WHEN 3 THEN 'Midlevel Basement' ELSE 'Roof' END AS label, 'X_' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'FLR.pdf' AS file FROM part)
SELECT p_partkey, CASE WHEN label LIKE 'Midlevel%' THEN -1.5::DOUBLE WHEN label = 'Basement' THEN -1.0::DOUBLE WHEN label LIKE '%Mezzanine' THEN 1.5::DOUBLE
 WHEN label LIKE '%Floor' THEN CAST(regexp_extract(label, '^(\\d+)', 1) AS DOUBLE) - 1 ELSE greatest(CAST(regexp_extract(file, '_(\\d\\d)FLR', 1) AS DOUBLE) - 1, 0) END AS level FROM l""")
def level_parse(spark, d):
    n = F.col("p_size")
    suffix = F.when((n % 10 == 1) & (n % 100 != 11), "st").when((n % 10 == 2) & (n % 100 != 12), "nd").when((n % 10 == 3) & (n % 100 != 13), "rd").otherwise("th")
    m = F.col("p_partkey") % 5
    label = F.when(m == 0, F.concat(n.cast("string"), suffix, F.lit(" Floor"))).when(m == 1, "Basement").when(m == 2, "2nd Floor Mezzanine").when(m == 3, "Midlevel Basement").otherwise("Roof")
    file = F.concat(F.lit("X_"), F.lpad(n.cast("string"), 2, "0"), F.lit("FLR.pdf"))
    return V.table(spark, d, "part").select("p_partkey", R.level(label, file).alias("level"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 WHEN p_partkey % 3 = 1 THEN p_size * 3.5::DOUBLE ELSE 12.0::DOUBLE END AS height,
 coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, n.n_name) AS code FROM part LEFT JOIN nation n ON n.n_nationkey = p_size""")
def fallback_fields(spark, d):
    p, n = V.table(spark, d, "part"), V.table(spark, d, "nation")
    m = F.col("p_partkey") % 3
    height = F.when(m == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5 m"))).when(m == 1, F.lit(None).cast("string")).otherwise("high")
    levels = F.when(m == 1, F.col("p_size").cast("string"))
    code = F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.col("n_name"))
    return p.join(n, p["p_size"] == n["n_nationkey"], "left").select("p_partkey", R.building_height(height, levels).alias("height"), code.alias("code"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def closed_anti(spark, d):
    closed = V.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.table(spark, d, "orders").select("o_orderkey").join(closed, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def pruned_semi(spark, d):
    wanted = V.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    loaded = V.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return V.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_orderkey", "left_semi").join(loaded, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT n_name, c_mktsegment, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def dim_lookup(spark, d):
    li, o = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")
    cu, n = V.table(spark, d, "customer"), V.table(spark, d, "nation")
    # quantities are summed per order first, so the joins carry one row an order
    per_order = li.groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(_long("l_quantity")).alias("q"))
    joined = per_order.join(o, per_order["l_orderkey"] == o["o_orderkey"]).join(cu, o["o_custkey"] == cu["c_custkey"]).join(n, cu["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy("n_name", "c_mktsegment").agg(_long(F.sum("k")).alias("n"), _long(F.sum("q")).alias("quantity"))


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT user_id, ts, event_type FROM events WHERE event_type <> 'error')
SELECT e.event_id, s.event_type AS last_event_type FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def latest_step_asof(spark, d):
    t = V.trace(spark, d)
    out = spatial.last_before(t.where("event_type <> 'error'"), t.where("event_type = 'error'").select("user_id", "ts", "event_id"), "user_id", "ts", "event_type")
    return out.select("event_id", "last_event_type")


# spatial ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.CUSTOMER_SITES}, {V.SUPPLIER_SITES}, p AS (SELECT ss.id, cs.id AS near_id, round(sqrt((ss.x - cs.x) * (ss.x - cs.x) + (ss.y - cs.y) * (ss.y - cs.y)), 4) AS d FROM ss, cs)
SELECT id, near_id, d FROM p WHERE d < 250 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, near_id) = 1""")
def nearest_capped(spark, d):
    out = spatial.nearest_capped(V.supplier_sites(spark, d), V.customer_sites(spark, d), 250.0)
    return out.select("id", "near_id", F.round("d", 4).alias("d"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT q.id AS query_id, v.id, round(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - v.v[i]) * (q.v[i] - v.v[i]))), 6) AS d2 FROM v q, v WHERE q.id % 20 = 0 AND q.id <> v.id)
SELECT query_id, id, d2, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 4""")
def knn_top4(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return spatial.knn(e.where("id % 20 = 0"), e, 4)


@query(f"""WITH {V.CUSTOMER_SITES}, {V.NATION_RINGS}, x AS (SELECT cs.id, seg.pid, count(*) AS k FROM cs, seg WHERE (seg.y1 > cs.y) <> (seg.y2 > cs.y) AND cs.x < (seg.x2 - seg.x1) * (cs.y - seg.y1) / (seg.y2 - seg.y1) + seg.x1 GROUP BY 1, 2)
SELECT id, pid FROM x WHERE k % 2 = 1""")
def pip_join(spark, d):
    return spatial.polygons_at_points(V.customer_sites(spark, d).select("id", "x", "y"), V.nation_rings(spark, d), 1000.0).select("id", "pid")


@query(f"""WITH {V.CUSTOMER_SITES}, {V.NATION_RINGS}, x AS (SELECT cs.id, seg.pid, count(*) AS k FROM cs, seg WHERE (seg.y1 > cs.y) <> (seg.y2 > cs.y) AND cs.x < (seg.x2 - seg.x1) * (cs.y - seg.y1) / (seg.y2 - seg.y1) + seg.x1 GROUP BY 1, 2)
SELECT id, pid FROM x WHERE k % 2 = 1""")
def pip_cover(spark, d):
    """The same by a cover of the polygons, whose inner cells need no test."""
    points = V.customer_sites(spark, d).select("id", "x", "y")
    return spatial.polygons_by_cover(points, spatial.cover(V.nation_rings(spark, d), 500.0), 500.0).select("id", "pid")


@query(f"""WITH {V.CUSTOMER_SITES}, {V.NATION_RINGS}, t AS (SELECT cs.id, cs.x, cs.y, seg.*, greatest(0, least(1, ((cs.x - x1) * (x2 - x1) + (cs.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS u FROM cs JOIN seg ON seg.pid = cs.nation),
q AS (SELECT id, sqrt((x - x1 - u * (x2 - x1)) ** 2 + (y - y1 - u * (y2 - y1)) ** 2) AS d FROM t)
SELECT id, round(min(d), 4) AS d FROM q GROUP BY id""")
def boundary_nearest(spark, d):
    pts = V.customer_sites(spark, d).select("id", F.col("nation").alias("pid"), "x", "y")
    return spatial.nearest_boundary(pts, V.nation_rings(spark, d)).select("id", F.round("d", 4).alias("d"))


@query(f"""WITH {V.SUPPLIER_SITES}, p AS (SELECT a.nation AS building, a.id AS a, b.id AS b, greatest(5, 1.25 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM ss a JOIN ss b ON a.nation = b.nation AND a.id <> b.id)
SELECT building, a, b, round(m, 4) AS m FROM p""")
def clique_pairs(spark, d):
    nodes = V.supplier_sites(spark, d).select(F.col("nation").alias("building"), "id", F.col("id").alias("ord"), (F.col("x") / S.MX).alias("lon"), (F.col("y") / S.MY).alias("lat"))
    return graph.clique(nodes).select("building", "a", "b", F.round("m", 4).alias("m"))


@query("""SELECT p_partkey, arg_min(level, abs(elev - p_size) * 100 + ord) AS level FROM part, (VALUES (0.0::DOUBLE, 0, 0), (1.0::DOUBLE, 9, 1), (2.0::DOUBLE, 21, 2), (3.5::DOUBLE, 33, 3), (5.0::DOUBLE, 47, 4)) v(level, elev, ord) GROUP BY 1""")
def level_nearest(spark, d):
    levels = spark.createDataFrame([(0.0, 0, 0), (1.0, 9, 1), (2.0, 21, 2), (3.5, 33, 3), (5.0, 47, 4)], "level double, elev int, ord int").withColumn("nodes", F.lit(50))
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("z"))
    return spatial.level_nearest(rows, levels).select(F.col("id").alias("p_partkey"), "level")


@query("SELECT event_id, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_pairs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return V.trace(spark, d).select("event_id", F.lead("event_id").over(w).alias("next_id"), F.lead("event_type").over(w).alias("next_type"))


# polylines --------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.CUSTOMER_SITES}, g AS (SELECT nation, x, y, lag(x) OVER o AS px, lag(y) OVER o AS py FROM cs WINDOW o AS (PARTITION BY nation ORDER BY id))
SELECT nation, round(coalesce(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 0), 3) AS length FROM g GROUP BY nation""")
def polyline_length(spark, d):
    return V.lines(spark, d).select("nation", F.round(S.length("pts"), 3).alias("length"))


@query(f"WITH {V.CUSTOMER_SITES} SELECT nation, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cs GROUP BY nation")
def bounds(spark, d):
    return V.lines(spark, d).select("nation", S.bounds("pts").alias("b")).select("nation", "b.x0", "b.y0", "b.x1", "b.y1")


@query(f"WITH {V.CUSTOMER_SITES} SELECT nation, round(sum(x) / count(*), 6) AS x, round(sum(y) / count(*), 6) AS y FROM cs GROUP BY nation")
def centroid(spark, d):
    return V.lines(spark, d).select("nation", S.vertex_mean("pts").alias("p")).select("nation", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"""WITH {V.CUSTOMER_SITES}, g AS (SELECT nation, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy FROM cs WINDOW o AS (PARTITION BY nation ORDER BY id)),
s AS (SELECT nation, sqrt(dx * dx + dy * dy) AS len, atan2(dy, dx) AS t FROM g WHERE dx IS NOT NULL)
SELECT nation, round(degrees(atan2(sum(len * sin(4 * t)), sum(len * cos(4 * t)))) / 4, 6) AS angle FROM s GROUP BY nation""")
def circular_mean(spark, d):
    return georef.dominant_angle(V.lines(spark, d), "nation").select("nation", F.round("angle", 6).alias("angle"))


@query(f"""WITH {V.CUSTOMER_SITES}, a AS (SELECT DISTINCT CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM cs WHERE x < 7000), b AS (SELECT DISTINCT CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM cs WHERE x > 3000)
SELECT count(*) FILTER (WHERE ia AND ib) AS both_n, count(*) AS any_n, round(count(*) FILTER (WHERE ia AND ib) / count(*), 6) AS iou
FROM (SELECT a.cx IS NOT NULL AS ia, b.cx IS NOT NULL AS ib FROM a FULL JOIN b ON a.cx = b.cx AND a.cy = b.cy)""")
def cell_iou(spark, d):
    s = V.customer_sites(spark, d).withColumns({"cx": spatial.cell("x", 100), "cy": spatial.cell("y", 100)})
    return georef.iou(s.where("x < 7000"), s.where("x > 3000")).withColumn("iou", F.round("iou", 6))


@query("""WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) SELECT l_suppkey, n FROM n WHERE n >= 0.85 * (SELECT max(n) FROM n)""")
def keep_fraction(spark, d):
    rows = V.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("label"))
    kept = graph.keep_fraction(rows, 0.85)
    return kept.groupBy(F.col("label").alias("l_suppkey")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS m, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS indoor_m FROM lineitem GROUP BY 1)
SELECT l_orderkey, m, indoor_m, round(m / 1.3 / 60, 6) AS minutes, round(CASE WHEN m = 0 THEN 1 ELSE indoor_m / m END, 6) AS indoor_share FROM s""")
def route_summary(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", _long("l_quantity").alias("m"), F.when(F.col("l_returnflag") == "R", "outdoor").otherwise("indoor").alias("kind"))
    return route.summary(li, ("l_orderkey",)).select("l_orderkey", _long("m").alias("m"), _long("indoor_m").alias("indoor_m"), F.round("minutes", 6).alias("minutes"), F.round("indoor_share", 6).alias("indoor_share"))


@query("""WITH f AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY 1, 2""")
def run_collapse(spark, d):
    return route.runs(V.trace(spark, d), "ts", ["event_type"], ("user_id",)).groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", _long("run").alias("run"), "event_type", "n", "first_id")


@query(f"""WITH {V.CUSTOMER_SITES}, g AS (SELECT nation, id, atan2(lead(x) OVER o - x, lead(y) OVER o - y) AS t0 FROM cs WINDOW o AS (PARTITION BY nation ORDER BY id)),
h AS (SELECT nation, id, coalesce(last_value(t0 IGNORE NULLS) OVER (PARTITION BY nation ORDER BY id ROWS UNBOUNDED PRECEDING), 0) AS t FROM g),
s AS (SELECT nation, id, sum(sin(t)) OVER w AS ss, sum(cos(t)) OVER w AS sc, percent_rank() OVER (PARTITION BY nation ORDER BY id) AS pos FROM h WINDOW w AS (PARTITION BY nation ORDER BY id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT id, CAST(floor(((degrees(atan2(ss, sc)) + 360) % 360) * 1000 + 0.5) AS BIGINT) % 360000 AS millidegrees, round(pos, 6) AS pos FROM s""")
def bearing_smooth(spark, d):
    o = Window.partitionBy("nation").orderBy("id")
    near = o.rowsBetween(-3, 3)
    own = F.atan2(F.lead("x").over(o) - F.col("x"), F.lead("y").over(o) - F.col("y"))
    s = V.customer_sites(spark, d).withColumn("own", own).withColumn("t", F.coalesce(F.last("own", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    mean = F.pmod(F.degrees(F.atan2(F.sum(F.sin("t")).over(near), F.sum(F.cos("t")).over(near))) + 360, F.lit(360.0))
    return s.select("id", (_long(S.round_up(mean * 1000)) % 360000).alias("millidegrees"), F.round(F.percent_rank().over(o), 6).alias("pos"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE n <= greatest(20, CAST(floor(0.25 * c) AS BIGINT))""")
def top_fraction(spark, d):
    li = V.table(spark, d, "lineitem")
    return georef.longest(li, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"""WITH {V.SUPPLIER_SITES}, g AS (SELECT id, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM ss WINDOW o AS (PARTITION BY nation ORDER BY id)),
n AS (SELECT *, greatest(1, CAST(floor(sqrt((x2 - x) ** 2 + (y2 - y) ** 2) / 100 + 0.5) AS BIGINT)) AS n FROM g WHERE x2 IS NOT NULL), k AS (SELECT *, unnest(range(n)) AS k FROM n)
SELECT id, CAST(k AS BIGINT) AS k, round(x + (x2 - x) * (k / n), 4) AS px, round(y + (y2 - y) * (k / n), 4) AS py FROM k""")
def densify(spark, d):
    o = Window.partitionBy("nation").orderBy("id")
    g = V.supplier_sites(spark, d).withColumns({"x2": F.lead("x").over(o), "y2": F.lead("y").over(o)}).where("x2 IS NOT NULL")
    n = F.greatest(F.lit(1), _long(S.round_up(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) / 100)))
    k = g.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    return k.select("id", "k", F.round(F.col("x") + (F.col("x2") - F.col("x")) * t, 4).alias("px"), F.round(F.col("y") + (F.col("y2") - F.col("y")) * t, 4).alias("py"))


@query(f"""WITH {V.CUSTOMER_SITES} SELECT nation, count(*) AS n, CAST(sum(CAST(x AS BIGINT) * 10 * id) AS BIGINT) AS sx, CAST(sum(CAST(y AS BIGINT) * 10 * id) AS BIGINT) AS sy, true AS same FROM cs GROUP BY nation""")
def codec_roundtrip(spark, d):
    s = V.customer_sites(spark, d)
    packed = s.groupBy("nation").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("p")).withColumn("flat", S.quantise("p"))
    back = packed.withColumn("q", S.dequantise("flat"))
    same = F.forall(F.zip_with("p", "q", lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])), lambda t: t)
    total = lambda k: F.aggregate(F.zip_with("p", F.filter("flat", lambda _, i: i % 2 == k), lambda a, v: a["id"] * v), F.lit(0).cast("long"), lambda t, v: t + v)
    return back.select("nation", _long(F.size("p")).alias("n"), total(0).alias("sx"), total(1).alias("sy"), same.alias("same"))


@query(f"""WITH {V.CUSTOMER_SITES}, f AS (SELECT id, CASE WHEN id % 2 = 0 THEN -x ELSE x END AS u, y, radians(nation * 7.0) AS r FROM cs)
SELECT id, round(0.5 * (cos(r) * u - sin(r) * y) + 10, 4) AS tx, round(0.5 * (sin(r) * u + cos(r) * y) - 20, 4) AS ty FROM f""")
def affine_apply(spark, d):
    s = V.customer_sites(spark, d)
    p = S.affine(F.struct("x", "y"), 0.5, F.col("nation") * 7.0, F.col("id") % 2 == 0, 10.0, -20.0)
    return s.select("id", p.alias("p")).select("id", F.round("p.x", 4).alias("tx"), F.round("p.y", 4).alias("ty"))


@query("""SELECT s_suppkey, round((1 + s_nationkey / 10) * (2 + s_suppkey % 3), 6) AS scale, (s_suppkey % 2 = 1) AS mirror,
 round(degrees(atan2(sin(radians(CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey * 3.0 + (s_suppkey % 5) * 4.0 ELSE s_nationkey * 3.0 + (s_suppkey % 5) * 4.0 END)), cos(radians(s_nationkey * 3.0 + (s_suppkey % 5) * 4.0)))), 4) AS angle FROM supplier""")
def affine_compose(spark, d):
    s = V.table(spark, d, "supplier")
    m = S.matrix(1 + F.col("s_nationkey") / 10, F.col("s_nationkey") * 3.0, F.lit(False))
    n = S.matrix((2 + F.col("s_suppkey") % 3).cast("double"), (F.col("s_suppkey") % 5) * 4.0, F.col("s_suppkey") % 2 == 1)
    out = S.decompose(S.compose(m, n))
    return s.select("s_suppkey", out.alias("o")).select("s_suppkey", F.round("o.scale", 6).alias("scale"), "o.mirror", F.round("o.degrees", 4).alias("angle"))


# graphs -----------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {V.CUSTOMER_TREE}, r(v, l) USING KEY (v) AS (SELECT c_custkey, c_custkey FROM customer UNION
 SELECT e.b, min(r.l) FROM r JOIN e ON e.a = r.v JOIN recurring.r c ON c.v = e.b WHERE r.l < c.l GROUP BY e.b) SELECT v AS id, l AS label FROM r""")
def components(spark, d):
    one = V.customer_tree(spark, d)
    return graph.components(V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), graph.both_ways(one))


@query(f"""WITH RECURSIVE {V.CUSTOMER_TREE}, r(v, l) USING KEY (v) AS (SELECT DISTINCT a, a FROM e UNION
 SELECT e.b, min(r.l) FROM r JOIN e ON e.a = r.v JOIN recurring.r c ON c.v = e.b WHERE r.l < c.l GROUP BY e.b),
z AS (SELECT l, count(*) AS n FROM r GROUP BY l ORDER BY n DESC, l LIMIT 1) SELECT v AS id FROM r JOIN z USING (l)""")
def largest_component(spark, d):
    return graph.largest_component(V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), graph.both_ways(V.customer_tree(spark, d)))


@query(f"""WITH RECURSIVE {V.SUPPLIER_ARCS}, r(n, d) USING KEY (n) AS (SELECT CAST(min(a) AS BIGINT), CAST(0 AS BIGINT) FROM arcs UNION
 SELECT e.b, CAST(min(r.d + e.w) AS BIGINT) FROM r JOIN arcs e ON e.a = r.n LEFT JOIN recurring.r c ON c.n = e.b WHERE r.d + e.w < coalesce(c.d, 999999999) GROUP BY e.b) SELECT n AS id, d FROM r""")
def sssp(spark, d):
    arcs = graph.kept(V.supplier_arcs(spark, d))
    return graph.shortest(arcs, arcs.agg(F.min("a").alias("id"))).select("id", "d")


_DOORS = "door AS (SELECT min(s_suppkey) AS id FROM supplier GROUP BY s_nationkey)"


def _from_doors(within: str = "") -> str:
    """The distances from every door; within bounds the search."""
    return f"""{V.SUPPLIER_ARCS}, {_DOORS}, r(src, n, d) USING KEY (src, n) AS (SELECT id, id, CAST(0 AS BIGINT) FROM door UNION
 SELECT r.src, e.b, CAST(min(r.d + e.w) AS BIGINT) FROM r JOIN arcs e ON e.a = r.n LEFT JOIN recurring.r c ON c.src = r.src AND c.n = e.b WHERE r.d + e.w < coalesce(c.d, 999999999){within} GROUP BY r.src, e.b)"""


def _doors(spark, d) -> DataFrame:
    return V.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("id")).select("id", F.col("id").alias("ord"))


@query(f"""WITH RECURSIVE {_from_doors(" AND r.d + e.w <= 250")} SELECT src, n AS id, d FROM r""")
def bounded_sssp(spark, d):
    return graph.shortest(graph.kept(V.supplier_arcs(spark, d)), _doors(spark, d), radius=250).select("src", "id", "d")


@query(f"""WITH RECURSIVE {_from_doors()}, t AS (SELECT src, n, d, row_number() OVER (PARTITION BY src ORDER BY d, n) AS k FROM r WHERE n <> src AND n IN (SELECT id FROM door)),
p AS (SELECT *, row_number() OVER (PARTITION BY least(src, n), greatest(src, n) ORDER BY src, k) AS f FROM t WHERE k <= 4) SELECT src AS a, n AS b, d FROM p WHERE f = 1""")
def shortcuts_topk(spark, d):
    doors = _doors(spark, d)
    return graph.shortcuts(graph.shortest(graph.kept(V.supplier_arcs(spark, d)), doors), doors, 4)


@query(f"""WITH RECURSIVE {V.SUPPLIER_ARCS}, r(n, d) USING KEY (n) AS (SELECT CAST(min(a) AS BIGINT), CAST(0 AS BIGINT) FROM arcs UNION
 SELECT e.b, CAST(min(r.d + e.w) AS BIGINT) FROM r JOIN arcs e ON e.a = r.n LEFT JOIN recurring.r c ON c.n = e.b WHERE r.d + e.w < coalesce(c.d, 999999999) GROUP BY e.b),
pr AS MATERIALIZED (SELECT e.b AS n, min(e.a) AS p FROM arcs e JOIN r x ON x.n = e.a JOIN r y ON y.n = e.b WHERE x.d + e.w = y.d GROUP BY e.b),
walk(target, n, back) AS (SELECT n, n, 0 FROM r UNION ALL SELECT w.target, pr.p, w.back + 1 FROM walk w JOIN pr ON pr.n = w.n WHERE w.n <> (SELECT min(a) FROM arcs))
SELECT target, CAST(max(back) OVER (PARTITION BY target) - back AS INTEGER) AS hop, n AS id FROM walk""")
def path_hops(spark, d):
    arcs = graph.kept(V.supplier_arcs(spark, d))
    dist = graph.shortest(arcs, arcs.agg(F.min("a").alias("id")))
    return graph.paths(dist, dist.select("src", F.col("id").alias("target"))).select("target", "hop", "id")


@query(f"WITH {V.SUPPLIER_ARCS} SELECT a AS id, count(*) AS degree FROM arcs GROUP BY a")
def degrees(spark, d):
    return graph.degrees(V.supplier_arcs(spark, d))


# roll-ups, merges, quality -----------------------------------------------------------------------------------------


@query("""SELECT l_suppkey, array_to_string(list(DISTINCT l_linenumber ORDER BY l_linenumber), ',') AS levels, count(*) FILTER (WHERE l_returnflag = 'R') AS rooms, count(*) AS n FROM lineitem GROUP BY 1""")
def index_rollup(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("l_linenumber")), ",").alias("levels"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("rooms"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey JOIN supplier s ON l_suppkey = s.s_suppkey)
SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1, 2""")
def pair_multiplicity(spark, d):
    li, o = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")
    cu, su = V.table(spark, d, "customer"), V.table(spark, d, "supplier")
    p = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(cu, o["o_custkey"] == cu["c_custkey"]).join(su, li["l_suppkey"] == su["s_suppkey"]).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    return quality.pair_counts(p)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN 'manual' ELSE 'auto' END AS method FROM supplier
UNION ALL SELECT s_suppkey + 1000000, s_acctbal, 'manual' FROM supplier WHERE s_suppkey % 3 = 1""")
def upsert_merge(spark, d):
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    k = F.col("s_suppkey") % 3
    new = s.where(k == 0).select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal")).unionByName(s.where(k == 1).select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_acctbal"))
    return indoor.upsert(s.withColumn("method", F.lit("auto")), new.withColumn("method", F.lit("manual")), "s_suppkey")


@query("""SELECT 'line without part' AS rule, count(*) AS violations FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'long order', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 7)
UNION ALL SELECT 'repeated line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'missing pair', count(*) FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)""")
def quality_violations(spark, d):
    li, p = V.table(spark, d, "lineitem"), V.table(spark, d, "part")
    return quality.report({
        "line without part": li.join(p, li["l_partkey"] == p["p_partkey"], "left_anti"),
        "long order": quality.over(li, ["l_orderkey"], 7),
        "repeated line": quality.over(li, ["l_orderkey", "l_linenumber"], 1),
        "missing pair": quality.missing(V.table(spark, d, "nation").select("n_nationkey"), V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))),
    })


@query("""SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN 1.8::DOUBLE * s_nationkey + abs(s_suppkey % 7 - 3) ELSE abs(s_suppkey % 7 - 3) + 12 END, 6) AS m,
 round(CASE WHEN s_suppkey % 2 = 0 THEN 1.15::DOUBLE * (1.8::DOUBLE * s_nationkey + abs(s_suppkey % 7 - 3)) ELSE abs(s_suppkey % 7 - 3) + 12 END, 6) AS w FROM supplier""")
def vertical_costs(spark, d):
    kind = F.when(F.col("s_suppkey") % 2 == 0, "stair").otherwise("elevator")
    m = R.vertical_metres(kind, F.col("s_nationkey"), F.col("s_suppkey") % 7 - 3).cast("double")
    return V.table(spark, d, "supplier").select("s_suppkey", F.round(m, 6).alias("m"), F.round(R.arc_weight(kind, m), 6).alias("w"))


@query("""WITH l AS (SELECT p_partkey, (p_size - 4) AS v FROM part)
SELECT p_partkey, CASE WHEN v = -1 THEN 'Basement' WHEN v < 0 THEN 'Level ' || v ELSE (v + 1) || CASE WHEN (v + 1) % 10 = 1 AND (v + 1) % 100 <> 11 THEN 'st' WHEN (v + 1) % 10 = 2 AND (v + 1) % 100 <> 12 THEN 'nd' WHEN (v + 1) % 10 = 3 AND (v + 1) % 100 <> 13 THEN 'rd' ELSE 'th' END || ' Floor' END AS floor FROM l""")
def floor_names(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.floor_name((F.col("p_size") - 4).cast("double")).alias("floor"))


@query("""SELECT p_partkey, regexp_matches(t, '^[0-9]{3,4}[A-Z]{0,2}$') AND (length(regexp_extract(t, '^([0-9]+)', 1)) = 3 OR starts_with(t, CAST(p_size % 9 + 1 AS VARCHAR))) AS ok
FROM (SELECT *, CAST(p_partkey * 37 % 12000 AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'ABC' ELSE '' END AS t FROM part)""")
def room_numbers(spark, d):
    m = F.col("p_partkey") % 4
    text = F.concat((F.col("p_partkey") * 37 % 12000).cast("string"), F.when(m == 0, "A").when(m == 1, "ABC").otherwise(""))
    return V.table(spark, d, "part").select("p_partkey", R.plausible_room(R.clean_text(text), (F.col("p_size") % 9).cast("double")).alias("ok"))


# grouped kernels: the SQL states them as recursions over cells and segments -------------------------------------------


@query(f"""WITH RECURSIVE {V.CUSTOMER_SITES}, pt AS MATERIALIZED (SELECT nation, x, y, row_number() OVER (PARTITION BY nation ORDER BY id) AS i FROM cs),
seg(nation, lo, hi) AS (SELECT nation, min(i), max(i) FROM pt GROUP BY nation UNION ALL
 SELECT nation, CASE WHEN h = 0 THEN lo ELSE i END, CASE WHEN h = 0 THEN i ELSE hi END FROM
  (SELECT *, row_number() OVER (PARTITION BY nation, lo, hi ORDER BY off DESC, i) AS first FROM
   (SELECT nation, lo, hi, i, sqrt((qx - t * dx) ** 2 + (qy - t * dy) ** 2) AS off FROM
    (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, (qx * dx + qy * dy) / (dx * dx + dy * dy))) END AS t FROM
     (SELECT s.nation, s.lo, s.hi, p.i, p.x - a.x AS qx, p.y - a.y AS qy, b.x - a.x AS dx, b.y - a.y AS dy FROM seg s
      JOIN pt a ON a.nation = s.nation AND a.i = s.lo JOIN pt b ON b.nation = s.nation AND b.i = s.hi JOIN pt p ON p.nation = s.nation AND p.i > s.lo AND p.i < s.hi))))
  CROSS JOIN (VALUES (0), (1)) v(h) WHERE first = 1 AND off > 300),
kept AS (SELECT nation, lo AS i FROM seg UNION SELECT nation, hi FROM seg),
step AS (SELECT nation, x, y, lag(x) OVER o AS x0, lag(y) OVER o AS y0 FROM kept JOIN pt USING (nation, i) WINDOW o AS (PARTITION BY nation ORDER BY i))
SELECT nation, count(*) AS n, round(coalesce(sum(sqrt((x - x0) ** 2 + (y - y0) ** 2)), 0), 3) AS length FROM step GROUP BY nation""")
def dp_simplify(spark, d):
    return V.lines(spark, d).select("nation", polyline.simplify("pts", 300.0).alias("pts")).select("nation", _long(F.size("pts")).alias("n"), F.round(S.length("pts"), 3).alias("length"))


def _cells(spark, d) -> DataFrame:
    """Thick blobs about the customers of each nation, as cells."""
    s = V.customer_sites(spark, d).select("nation", spatial.cell("x", 100).alias("c"), spatial.cell("y", 100).alias("r"))
    wide = spatial.spread(s.withColumnsRenamed({"c": "x", "r": "y"}).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}), 1.0)
    return wide.select("nation", F.col("cy").alias("r"), F.col("cx").alias("c")).distinct()


_CELLS = f"""{V.CUSTOMER_SITES}, cells AS MATERIALIZED (SELECT DISTINCT nation, CAST(floor(y / 100) AS BIGINT) + i AS r, CAST(floor(x / 100) AS BIGINT) + j AS c FROM cs, range(-1, 2) v(i), range(-1, 2) w(j))"""


#: Cells on a tile's side: floors of some hundred cells a side fall into many tiles.
_TILE = 32
_FOUR = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(i, j)"


def _parts(name: str, cells: str) -> str:
    """SQL of a recursion: cells with the least reading-order key l of their four-neighbour component."""
    return f"""{name}(nation, r, c, l) USING KEY (nation, r, c) AS (SELECT nation, r, c, (r + 10) * 1000 + c + 10 FROM {cells} UNION
 SELECT b.nation, b.r, b.c, min(a.l) FROM {name} a CROSS JOIN {_FOUR} JOIN {cells} b ON b.nation = a.nation AND b.r = a.r + i AND b.c = a.c + j
 JOIN recurring.{name} o ON o.nation = b.nation AND o.r = b.r AND o.c = b.c WHERE a.l < o.l GROUP BY b.nation, b.r, b.c)"""


@query(f"""WITH RECURSIVE {_CELLS}, {_parts("part", "cells")}
SELECT nation, r, c, dense_rank() OVER (PARTITION BY nation ORDER BY l) AS label FROM part""")
def label_cells(spark, d):
    return tiles.label(_cells(spark, d), "nation", size=_TILE)


@query(f"""WITH RECURSIVE {_CELLS}, {_parts("part", "cells")}, numbered AS (SELECT nation, r, c, dense_rank() OVER (PARTITION BY nation ORDER BY l) AS label FROM part),
side AS (SELECT n.nation, n.label, count(*) AS sides FROM numbered n CROSS JOIN {_FOUR} ANTI JOIN cells k ON k.nation = n.nation AND k.r = n.r + i AND k.c = n.c + j GROUP BY ALL)
SELECT nation, label, CAST(count(*) AS DOUBLE) AS area, CAST(sides AS DOUBLE) AS metres FROM numbered JOIN side USING (nation, label) GROUP BY nation, label, sides""")
def mask_outlines(spark, d):
    """The area in the rings of each component of a nation's blobs, holes subtracted, and the length of these rings."""
    rings = tiles.outlines(_cells(spark, d), "nation", _TILE)
    closed = S.length(F.concat("pts", F.slice("pts", 1, 1)))
    return rings.groupBy("nation", "label").agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("area"), F.sum(closed).alias("metres"))


@query(f"""WITH {_CELLS}, beside AS (SELECT DISTINCT nation, r + i AS r, c + j AS c FROM cells, {_FOUR}),
unset AS (SELECT * FROM beside EXCEPT SELECT nation, r, c FROM cells),
near AS (SELECT a.nation, a.r, a.c, min((a.r - u.r) ** 2 + (a.c - u.c) ** 2) AS d2 FROM cells a JOIN unset u ON a.nation = u.nation GROUP BY ALL)
SELECT nation, r, c, round(sqrt(d2), 6) AS d FROM near""")
def edt(spark, d):
    return tiles.distance(_cells(spark, d), "nation").withColumn("d", F.round("d", 6))


#: The cells about one, from above it and clockwise.
_ABOUT = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
_SET = ", ".join(f"count(*) FILTER (b.r - a.r = {r} AND b.c - a.c = {c}) AS p{i}" for i, (r, c) in enumerate(_ABOUT))
_TURNS = " + ".join(f"(1 - p{i}) * p{(i + 1) % 8}" for i in range(8))


@query(f"""WITH RECURSIVE {_CELLS}, s(k, nation, r, c, last, before) AS (SELECT 0, nation, r, c, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM cells UNION ALL
 SELECT k + 1, nation, r, c, gone_now, last FROM (SELECT *, count(*) FILTER (gone) OVER () AS gone_now FROM
  (SELECT *, {" + ".join(f"p{i}" for i in range(8))} BETWEEN 2 AND 6 AND {_TURNS} = 1
    AND CASE WHEN k % 2 = 0 THEN p0 * p2 * p4 + p2 * p4 * p6 ELSE p0 * p2 * p6 + p0 * p4 * p6 END = 0 AS gone FROM
   (SELECT a.k, a.nation, a.r, a.c, a.last, a.before, {_SET} FROM s a JOIN s b ON a.nation = b.nation AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
    GROUP BY a.k, a.nation, a.r, a.c, a.last, a.before))) WHERE NOT gone AND last + before > 0)
SELECT nation, r, c FROM s WHERE k = (SELECT max(k) FROM s)""")
def skeleton(spark, d):
    return tiles.skeleton(_cells(spark, d), "nation", _TILE)


@query(f"""WITH RECURSIVE {_CELLS}, disk AS (SELECT i, j FROM range(-2, 3) v(i), range(-2, 3) w(j) WHERE i * i + j * j <= 4),
grown AS MATERIALIZED (SELECT DISTINCT nation, r + i AS r, c + j AS c FROM cells, disk),
shut AS MATERIALIZED (SELECT g.nation, g.r - i AS r, g.c - j AS c FROM grown g, disk GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM disk)),
box AS (SELECT nation, min(r) - 1 AS r0, max(r) + 1 AS r1, min(c) - 1 AS c0, max(c) + 1 AS c1 FROM shut GROUP BY nation),
free AS MATERIALIZED (SELECT nation, r, c FROM box, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS r), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c) EXCEPT SELECT nation, r, c FROM shut),
out(nation, r, c) AS (SELECT nation, r0, c0 FROM box UNION SELECT f.nation, f.r, f.c FROM out o CROSS JOIN {_FOUR} JOIN free f ON f.nation = o.nation AND f.r = o.r + i AND f.c = o.c + j),
whole AS MATERIALIZED (SELECT * FROM shut UNION ALL (SELECT * FROM free EXCEPT SELECT * FROM out)), {_parts("part", "whole")},
size AS (SELECT nation, l, count(*) AS n, max(count(*)) OVER (PARTITION BY nation) AS top FROM part GROUP BY nation, l)
SELECT nation, r, c FROM part JOIN size USING (nation, l) WHERE n >= 0.06 * top""")
def closed_masks(spark, d):
    return tiles.filled_mass(_cells(spark, d), "nation", 2, 0.06, _TILE)


@query("""SELECT n_nationkey AS code, CAST(f AS INTEGER) AS floor, CASE WHEN f = 0 THEN 0 ELSE -(n_nationkey % 4 + 1) END AS dr, CASE WHEN f = 0 THEN 0 ELSE 3 END AS dc, 1.0::DOUBLE AS score FROM nation, range(2) t(f) WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def phase_correlate(spark, d):
    """Each nation's blobs as its ground floor, and moved by a planted shift as the next."""
    low = _cells(spark, d).withColumnRenamed("nation", "code")
    high = low.select("code", (F.col("r") + F.col("code") % 4 + 1).alias("r"), (F.col("c") - 3).alias("c"), F.lit(1).alias("floor"))
    return georef.floor_shift(low.withColumn("floor", F.lit(0)).unionByName(high), "code").select("code", "floor", "dr", "dc", "score")


@query()
def walk_graph(spark, d):
    return indoor.walk_graph_cells(_cells(spark, d).withColumnRenamed("nation", "key"), "key", 1.0, 3.0)


@query(f"""WITH RECURSIVE {V.SUPPLIER_ARCS}, r(n, d) USING KEY (n) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
 SELECT e.b, CAST(min(r.d + e.w) AS BIGINT) FROM r JOIN arcs e ON e.a = r.n LEFT JOIN recurring.r c ON c.n = e.b WHERE r.d + e.w < coalesce(c.d, 999999999) GROUP BY e.b),
pr AS MATERIALIZED (SELECT e.b AS n, CAST(min(CAST(e.a AS VARCHAR)) AS BIGINT) AS p FROM arcs e JOIN r x ON x.n = e.a JOIN r y ON y.n = e.b WHERE x.d + e.w = y.d GROUP BY e.b),
far AS (SELECT n FROM r ORDER BY d DESC, CAST(n AS VARCHAR) LIMIT 1),
walk(target, n, back) AS (SELECT n, n, 0 FROM far UNION ALL SELECT w.target, pr.p, w.back + 1 FROM walk w JOIN pr ON pr.n = w.n WHERE w.n <> 0)
SELECT CAST(target AS VARCHAR) AS target, CAST(max(back) OVER () - back AS INTEGER) AS hop, CAST(walk.n AS VARCHAR) AS id, d FROM walk JOIN r ON r.n = walk.n""")
def route_steps(spark, d):
    """The way from supplier 0 to the one farthest from it, hop by hop."""
    arcs = V.supplier_arcs(spark, d).withColumns({"m": F.col("w"), "a": F.col("a").cast("string"), "b": F.col("b").cast("string"), "building": F.lit(None).cast("string")})
    dist = graph.shortest(graph.kept(arcs), spark.createDataFrame([("0",)], "id string"))
    far = dist.orderBy(F.desc("d"), "id").limit(1).select("src", F.col("id").alias("target"))
    hops = graph.paths(dist, far)
    return hops.join(dist.select("id", "d"), "id").select("target", "hop", "id", "d")


from . import campus, journeys  # noqa: E402, F401  more queries, registered by import
