"""Queries of batched routing with their SQL: a campus of nations, floors in every second one, and a request for every supplier."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, journeys, route
from ..sources import indoor, versions
from . import views as V
from .campus import _CAMPUS, _MX, _MY, _campus
from .catalog import _long, query


def _links(spark, d) -> DataFrame:
    w = F.col("length_m")
    kind = F.when(w % 3 == 0, "tunnel").when(w % 3 == 1, "bridge").otherwise("doorway")
    bent = lambda n, k: F.struct((((n * 37 + k) % 25 + (n * n * 7 + k * k * 3) % 19 / 50.0) / 1000.0).alias("lon"), (((n * 11 + k) % 25 + (n * n * 5 + k * k * 2) % 17 / 50.0) / 1000.0).alias("lat"))
    a, b = F.col("from").cast("long"), F.col("to").cast("long")  # places out of line, so that no two ways cost the same
    return _campus(spark, d).withColumns({"geom": F.array(bent(a, b), bent(b, a)), "kind": kind, "z_m": F.when(w % 3 == 0, -4).otherwise(3), "verified": w % 2 == 0, "name": F.when(w % 5 == 0, F.concat(F.lit("Walkway "), "id")).otherwise("plain"), "notes": F.lit(None).cast("string")})


def _site(spark, d) -> dict[str, DataFrame]:
    """The links, nodes and edges of the campus, and levels, places, walks and verticals of the floors."""
    links = graph.kept(_links(spark, d))
    ends = route.portals(links).select("id", "building", "lon", "lat")
    n = F.col("n_nationkey")
    doors = V.table(spark, d, "nation").select(F.concat(F.lit("X:"), n.cast("string")).alias("id"), n.cast("string").alias("building"), ((n * 37 + 7) % 25 / 1000.0 + 0.0003).alias("lon"), ((n * 11 + 7) % 25 / 1000.0 + 0.0002).alias("lat"))
    nodes = graph.kept(ends.unionByName(route.buildings(ends)).unionByName(doors))
    x = doors.select(F.col("id").alias("b"), F.struct("lon", "lat").alias("q"))
    ways = V.table(spark, d, "nation").select(F.concat(F.lit("X:"), n.cast("string")).alias("a"), F.concat(F.lit("X:"), ((n + 1) % 25).cast("string")).alias("b"), (300 + n * 7).cast("double").alias("m"))
    outdoor = ways.join(doors.select(F.col("id").alias("a"), F.struct("lon", "lat").alias("p")), "a").join(x, "b").select("a", "b", F.lit("outdoor").alias("kind"), F.lit(None).cast("string").alias("link"), "m", F.array("p", "q").alias("geom"))
    edges = journeys.link_edges(links).unionByName(outdoor.drop("geom"))
    i = F.row_number().over(Window.partitionBy("building").orderBy("id")) - 1
    own = nodes.where(F.col("building").cast("int") % 2 == 0).select(F.col("building").alias("code"), i.alias("i"), "lon", "lat")
    floors = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.lit(elev).alias("elev"), F.lit(off).alias("off"), F.lit(int(level)).alias("ord")) for level, elev, off in ((0.0, 0.0, 0.0001), (1.0, 4.0, 0.00005)))))
    wide = own.withColumn("f", floors)
    places = graph.kept(wide.select("code", "f.level", "i", (F.col("lon") + F.col("f.off")).alias("lon"), (F.col("lat") + F.col("f.off")).alias("lat")))
    levels = wide.groupBy("code", "f.level", "f.elev", "f.ord").agg(F.count("*").alias("nodes"))
    o = Window.partitionBy("code", "level").orderBy("i")
    ahead = places.withColumns({"b": F.lead("i").over(o), "p": F.struct("lon", "lat"), "q": F.lead(F.struct("lon", "lat")).over(o)}).where("b IS NOT NULL")
    walks = ahead.select("code", "level", F.col("i").alias("a"), "b", F.greatest(F.lit(1.0), S.metres("p", "q")).alias("m"), F.array("p", "q").alias("path"))
    last = own.groupBy("code").agg(F.max("i").alias("i"))
    shaft = lambda kind, node, m: last.select("code", F.lit(kind).alias("kind"), F.lit(0.0).alias("a_level"), node.alias("a_node"), F.lit(1.0).alias("b_level"), node.alias("b_node"), F.lit(m).alias("m"))
    verticals = shaft("stair", F.lit(0), 9.0).unionByName(shaft("elevator", F.col("i"), 16.0))
    return {"links": links, "nodes": nodes, "edges": edges, "outdoor": outdoor, "levels": levels, "places": places, "walks": walks, "verticals": verticals}


def _requests(spark, d) -> DataFrame:
    """From each supplier's nation to another one, every third time to a place on its upper floor."""
    k, to = F.col("s_suppkey"), (F.col("s_suppkey") * 7 + 3) % 25
    room = F.concat(F.lit("I:"), to.cast("string"), F.lit(":1:"), (k % 5).cast("string"))
    target = F.when((k % 3 == 0) & (to % 2 == 0), room).otherwise(F.concat(F.lit("B:"), to.cast("string")))
    return V.table(spark, d, "supplier").select(k.alias("req"), F.concat(F.lit("B:"), F.col("s_nationkey").cast("string")).alias("source"), target.alias("target")).where("source <> target")


def _solved(spark, d) -> tuple[dict[str, DataFrame], DataFrame]:
    site = _site(spark, d)
    coarse = journeys.coarse_arcs(site["nodes"], site["edges"], site["links"])
    fine = journeys.floor_arcs(site["nodes"], site["links"], site["walks"], site["verticals"], site["levels"], site["places"])
    return site, journeys.solve(coarse, fine, _requests(spark, d), site["nodes"])


_METRES = lambda p, q: f"sqrt((({p}.lon - {q}.lon) * {_MX}) ** 2 + (({p}.lat - {q}.lat) * {_MY}) ** 2)"
_STEP = lambda r, mine: f"""SELECT r.req, e.b, min(r.d + e.w * CASE WHEN e.kind = 'intra' AND {mine} THEN 2.5 ELSE 1 END), arg_min(list_append(r.path, e.k), r.d + e.w * CASE WHEN e.kind = 'intra' AND {mine} THEN 2.5 ELSE 1 END)
 FROM {r} r JOIN {'req1' if r == 'r1' else 'req2'} q ON q.req = r.req JOIN arc e ON e.a = r.n AND (NOT e.fine OR {mine}) LEFT JOIN recurring.{r} c ON c.req = r.req AND c.n = e.b
 WHERE r.d + e.w * CASE WHEN e.kind = 'intra' AND {mine} THEN 2.5 ELSE 1 END < coalesce(c.d, 1e18) GROUP BY r.req, e.b"""  # noqa: E731
_BENT = lambda n, k: f"(({n} * 37 + {k}) % 25 + ({n} * {n} * 7 + {k} * {k} * 3) % 19 / 50.0::DOUBLE) / 1000.0::DOUBLE, (({n} * 11 + {k}) % 25 + ({n} * {n} * 5 + {k} * {k} * 2) % 17 / 50.0::DOUBLE) / 1000.0::DOUBLE"
_SOLVED = f"""WITH RECURSIVE {_CAMPUS.split("portal AS")[0]}
bent(id, n, lon, lat) AS (SELECT 'P:' || id || ':' || na, na, {_BENT("na", "nb")} FROM open UNION ALL SELECT 'P:' || id || ':' || nb, nb, {_BENT("nb", "na")} FROM open),
node AS (SELECT * FROM bent UNION ALL SELECT 'B:' || n, n, avg(lon), avg(lat) FROM bent GROUP BY n),
lk AS (SELECT id, CAST(na AS VARCHAR) AS f, CAST(nb AS VARCHAR) AS t, w, CASE w % 3 WHEN 0 THEN 'tunnel' WHEN 1 THEN 'bridge' ELSE 'doorway' END AS kind, CASE WHEN w % 3 = 0 THEN -4 ELSE 3 END AS z, w % 2 = 0 AS verified, CASE WHEN w % 5 = 0 THEN 'Walkway ' || id ELSE 'plain' END AS name FROM open),
nd AS MATERIALIZED (SELECT id, n, lon, lat FROM node UNION ALL SELECT 'X:' || n_nationkey, n_nationkey, (n_nationkey * 37 + 7) % 25 / 1000.0::DOUBLE + 0.0003, (n_nationkey * 11 + 7) % 25 / 1000.0::DOUBLE + 0.0002 FROM nation),
own AS (SELECT n, row_number() OVER (PARTITION BY n ORDER BY id) - 1 AS i, lon, lat FROM nd WHERE n % 2 = 0),
place AS MATERIALIZED (SELECT n, level, i, lon + off AS lon, lat + off AS lat, 'I:' || n || ':' || level || ':' || i AS id FROM own, (VALUES (0, 0.0001::DOUBLE), (1, 0.00005::DOUBLE)) f(level, off)),
wk AS (SELECT p.id AS a, q.id AS b, p.n, p.level, greatest(1, {_METRES("p", "q")}) AS m FROM place p JOIN place q ON q.n = p.n AND q.level = p.level AND q.i = p.i + 1),
vt AS (SELECT p.id AS a, q.id AS b, p.n, s.kind, s.m FROM place p JOIN place q ON q.n = p.n AND q.i = p.i AND p.level = 0 AND q.level = 1 JOIN (SELECT n, max(i) AS last FROM own GROUP BY n) x ON x.n = p.n
 JOIN (VALUES ('stair', 9.0::DOUBLE), ('elevator', 16.0::DOUBLE)) s(kind, m) ON p.i = CASE s.kind WHEN 'stair' THEN 0 ELSE x.last END),
spot AS (SELECT nd.id, nd.n, nd.lon, nd.lat, CASE WHEN l.z = 3 THEN 1 ELSE 0 END AS level FROM nd LEFT JOIN lk l ON nd.id IN ('P:' || l.id || ':' || l.f, 'P:' || l.id || ':' || l.t) WHERE nd.n % 2 = 0),
tie AS (SELECT a.id AS a, p.id AS b, a.n, a.level, {_METRES("a", "p")} AS d FROM spot a JOIN place p ON p.n = a.n AND p.level = a.level WHERE {_METRES("a", "p")} <= 25 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_METRES("a", "p")}, p.i) = 1),
half AS (SELECT 'P:' || id || ':' || f AS a, 'P:' || id || ':' || t AS b, w::DOUBLE AS w, w::DOUBLE AS m, 'indoor' AS kind, id AS link, NULL::VARCHAR AS building, NULL::VARCHAR AS vertical, NULL::INTEGER AS level, NULL::INTEGER AS to_level, false AS fine FROM lk
 UNION ALL SELECT 'X:' || n_nationkey, 'X:' || (n_nationkey + 1) % 25, (300 + n_nationkey * 7) * 1.6::DOUBLE, 300 + n_nationkey * 7, 'outdoor', NULL, NULL, NULL, NULL, NULL, false FROM nation
 UNION ALL SELECT p.id, q.id, greatest(5, {_METRES("p", "q")} * 1.25), greatest(5, {_METRES("p", "q")} * 1.25), 'intra', NULL, CAST(p.n AS VARCHAR), NULL, NULL, NULL, false FROM nd p JOIN nd q ON q.n = p.n AND p.id < q.id
 UNION ALL SELECT a, b, m, m, 'walk', NULL, CAST(n AS VARCHAR), NULL, level, level, true FROM wk
 UNION ALL SELECT a, b, greatest(2, d), greatest(2, d), 'walk', NULL, CAST(n AS VARCHAR), NULL, level, level, true FROM tie
 UNION ALL SELECT a, b, m * CASE kind WHEN 'stair' THEN 1.15 ELSE 1 END, m, 'vertical', NULL, CAST(n AS VARCHAR), kind, 0, 1, true FROM vt),
arc AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM (SELECT * FROM half UNION ALL SELECT b, a, w, m, kind, link, building, vertical, to_level, level, fine FROM half)),
req1 AS MATERIALIZED (SELECT s_suppkey AS req, 'B:' || s_nationkey AS source, CASE WHEN s_suppkey % 3 = 0 AND (s_suppkey * 7 + 3) % 25 % 2 = 0 THEN 'I:' || (s_suppkey * 7 + 3) % 25 || ':1:' || s_suppkey % 5 ELSE 'B:' || (s_suppkey * 7 + 3) % 25 END AS target,
 CASE WHEN s_suppkey % 3 = 0 AND (s_suppkey * 7 + 3) % 25 % 2 = 0 THEN [CAST((s_suppkey * 7 + 3) % 25 AS VARCHAR)] ELSE [] END AS loaded FROM supplier WHERE s_nationkey <> (s_suppkey * 7 + 3) % 25 OR s_suppkey % 3 = 0 AND (s_suppkey * 7 + 3) % 25 % 2 = 0),
r1(req, n, d, path) USING KEY (req, n) AS (SELECT req, source, 0.0::DOUBLE, []::BIGINT[] FROM req1 UNION {_STEP("r1", "coalesce(list_contains(q.loaded, e.building), false)")}),
way1 AS MATERIALIZED (SELECT q.req, unnest(r.path) AS k, generate_subscripts(r.path, 1) - 1 AS hop FROM req1 q JOIN r1 r ON r.req = q.req AND r.n = q.target),
code AS (SELECT id, CAST(n AS VARCHAR) AS code FROM nd UNION ALL SELECT id, CAST(n AS VARCHAR) FROM place),
seen AS (SELECT req, list_distinct(list(code)) AS codes FROM (SELECT w.req, c.code FROM way1 w JOIN arc e USING (k) JOIN code c ON c.id IN (e.a, e.b) WHERE CAST(c.code AS BIGINT) % 2 = 0) GROUP BY req),
req2 AS MATERIALIZED (SELECT req, source, target, list_distinct(list_concat(loaded, codes)) AS loaded FROM req1 JOIN seen USING (req) WHERE len(list_distinct(list_concat(loaded, codes))) > len(loaded)),
r2(req, n, d, path) USING KEY (req, n) AS (SELECT req, source, 0.0::DOUBLE, []::BIGINT[] FROM req2 UNION {_STEP("r2", "coalesce(list_contains(q.loaded, e.building), false)")}),
way AS (SELECT * FROM way1 WHERE req NOT IN (SELECT req FROM req2) UNION ALL SELECT q.req, unnest(r.path), generate_subscripts(r.path, 1) - 1 FROM req2 q JOIN r2 r ON r.req = q.req AND r.n = q.target),
hop AS MATERIALIZED (SELECT way.req, way.hop, arc.*, x.code AS ca, y.code AS cb FROM way JOIN arc USING (k) JOIN code x ON x.id = arc.a JOIN code y ON y.id = arc.b)"""


@query(f"{_SOLVED} SELECT req, CAST(hop AS INTEGER) AS hop, a, b, kind, round(w, 3) AS w, round(m, 3) AS m FROM hop")
def journeys_solved(spark, d):
    """Two-pass routes of all requests, each hop with its cost in the search without the fallback's factor."""
    _, hops = _solved(spark, d)
    return hops.select("req", "hop", "a", "b", "kind", F.round("w", 3).alias("w"), F.round("m", 3).alias("m"))


_STEPS = f"""{_SOLVED}, sg AS (SELECT req, hop, kind, link, coalesce(building, CASE WHEN kind = 'intra' THEN ca END) AS building, level, to_level, vertical, ca, cb, CAST(floor(m + 0.5) AS BIGINT) AS m FROM hop),
mark AS (SELECT *, coalesce(kind = lag(kind) OVER o AND kind IN ('intra', 'walk') AND building = lag(building) OVER o AND (kind = 'intra' OR level = lag(level) OVER o), false) AS same FROM sg WINDOW o AS (PARTITION BY req ORDER BY hop)),
run AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY req ORDER BY hop) AS run FROM mark),
grp AS (SELECT req, min(hop) AS idx, arg_min(kind, hop) AS kind, arg_min(link, hop) AS link, arg_min(building, hop) AS building, arg_min(level, hop) AS level, arg_min(to_level, hop) AS to_level, arg_min(vertical, hop) AS vertical, arg_min(cb, hop) AS too, sum(m) AS m FROM run GROUP BY req, run),
floorname AS (SELECT * FROM (VALUES (0, '1st Floor'), (1, '2nd Floor')) f(level, name)),
body AS (SELECT g.req, g.idx, g.kind, g.m, CASE g.kind WHEN 'intra' THEN 'Walk through <b>' || building || '</b> (≈ ' || CAST(floor(m / 5.0 + 0.5) * 5 AS BIGINT) || ' m).'
 WHEN 'walk' THEN 'Follow the corridor on <b>' || building || ' ' || f.name || '</b> (≈ ' || CAST(floor(m / 5.0 + 0.5) * 5 AS BIGINT) || ' m).'
 WHEN 'vertical' THEN CASE WHEN vertical = 'elevator' THEN 'Take the elevator' WHEN g.to_level > g.level THEN 'Take the stairs up' ELSE 'Take the stairs down' END || ' to <b>' || building || ' ' || t.name || '</b>.'
 WHEN 'indoor' THEN CASE l.kind WHEN 'tunnel' THEN 'Take the <b>tunnel to ' || too || '</b>' WHEN 'bridge' THEN 'Cross the <b>' || CASE WHEN l.name LIKE '%Walkway%' THEN l.name ELSE 'bridge' END || ' to ' || too || '</b>' ELSE 'Go through the doorway to <b>' || too || '</b>' END
  || ' (' || l.w || ' m' || CASE l.kind WHEN 'tunnel' THEN ', -4 m' ELSE '' END || ')' || CASE WHEN l.verified THEN '' ELSE ' (unverified)' END || '.'
 ELSE 'Go outside · ' || m || ' m to <b>' || too || '</b>.' END AS text FROM grp g LEFT JOIN lk l ON l.id = g.link LEFT JOIN floorname f ON f.level = g.level LEFT JOIN floorname t ON t.level = g.to_level WHERE NOT (g.kind = 'intra' AND m < 15) AND NOT (g.kind = 'walk' AND m < 8)),
ends AS (SELECT req, arg_min(ca, hop) AS a, arg_max(cb, hop) AS b, max(hop) AS last FROM sg GROUP BY req),
label AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_nationkey || ' · ' || n_name AS name FROM nation),
every AS (SELECT req, -1 AS idx, 'start' AS kind, 0 AS m, 'Start in <b>' || name || '</b>.' AS text FROM ends JOIN label ON code = a UNION ALL SELECT req, idx, kind, m, text FROM body UNION ALL SELECT req, last + 1, 'end', 0, 'Arrive at <b>' || name || '</b>.' FROM ends JOIN label ON code = b)"""


def _segments(site, hops) -> DataFrame:
    edges = site["outdoor"].select("a", "b", "geom")
    return route.to_segments(hops.drop("arc", "w", "loaded"), site["nodes"], site["links"], edges)


@query(f"{_STEPS} SELECT req, CAST(row_number() OVER (PARTITION BY req ORDER BY idx) - 1 AS INTEGER) AS n, kind, CAST(m AS BIGINT) AS m, text FROM every")
def journeys_steps(spark, d):
    """The sentences of every route, of the runs of its segments."""
    site, hops = _solved(spark, d)
    names = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return route.to_steps(_segments(site, hops), site["links"], names).select("req", "n", "kind", _long("m").alias("m"), "text")


@query(f"""{_STEPS}, fl AS (SELECT s.*, CASE s.kind WHEN 'vertical' THEN least(s.level, s.to_level) WHEN 'walk' THEN s.level WHEN 'indoor' THEN CASE WHEN CAST(cb AS BIGINT) % 2 = 0 THEN CASE WHEN l.z = 3 THEN 1 ELSE 0 END END END AS floor FROM sg s LEFT JOIN lk l ON l.id = s.link)
SELECT req, CAST(hop AS INTEGER) AS hop, CASE WHEN kind = 'indoor' THEN cb ELSE coalesce(building, cb) END AS building, CAST(floor AS DOUBLE) AS floor FROM fl""")
def journeys_floors(spark, d):
    """The floor shown with every segment of every route."""
    site, hops = _solved(spark, d)
    return route.opened_floor(_segments(site, hops), journeys.link_floors(site["links"], site["levels"]))


@query(f"""{_SOLVED}, asked AS (SELECT DISTINCT CAST(split_part(target, ':', 2) AS BIGINT) AS n FROM req1) SELECT CAST(w.n AS VARCHAR) AS code, CAST(w.level AS DOUBLE) AS level, CAST(p.i AS INTEGER) AS a, CAST(q.i AS INTEGER) AS b, round(w.m, 1) AS m, 2 AS points
FROM wk w JOIN asked ON asked.n = w.n JOIN place p ON p.id = w.a JOIN place q ON q.id = w.b""")
def indoor_files(spark, d):
    """The floors written as files, one a building, and the corridors of the buildings that requests go to, read back from theirs alone."""
    site = _site(spark, d)
    levels = site["levels"].withColumns({"label": F.lit("x"), "tier": F.lit("A"), "area": F.lit(None).cast("double")})
    walls, rooms = (spark.createDataFrame([], indoor.PARTS[p]) for p in ("walls", "rooms"))
    verticals = site["verticals"].withColumns({"shaft": F.col("kind"), "rise": F.lit(4.0)})
    path = f"{graph.shared_folder(spark)}/indoor-{uuid.uuid4().hex}"
    indoor.write(levels, site["places"].withColumn("kind", F.lit("corridor")), site["walks"], verticals, walls, rooms, path)
    asked = _requests(spark, d).select(F.split("target", ":")[1].alias("code"))
    edges = indoor.read_of(spark, path, "edges", asked)
    return edges.select("code", "level", "a", "b", "m", F.size("path").alias("points"))


@query("""WITH v1 AS (SELECT CAST(s_suppkey AS VARCHAR) AS code, s_nationkey AS nation, CAST(NULL AS BIGINT) AS lines FROM supplier),
n2 AS (SELECT CAST(l_suppkey AS VARCHAR) AS code, count(*) AS lines FROM lineitem GROUP BY 1), v2 AS (SELECT coalesce(v1.code, n2.code) AS code, nation, coalesce(n2.lines, v1.lines) AS lines FROM v1 FULL JOIN n2 USING (code)),
n3 AS (SELECT CAST(c_custkey AS VARCHAR) AS code, c_nationkey AS nation FROM customer WHERE c_custkey % 3 = 0), v3 AS (SELECT coalesce(v2.code, n3.code) AS code, coalesce(n3.nation, v2.nation) AS nation, lines FROM v2 FULL JOIN n3 USING (code))
SELECT 2 AS version, * FROM v2 UNION ALL SELECT 3, * FROM v3""")
def versioned_upsert(spark, d):
    """Suppliers, then their lines by one writer, then customers by another that began on the same base, was refused and began anew; versions 2 and 3."""
    path = f"{graph.shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    key = lambda c: F.col(c).cast("string").alias("code")
    first = V.table(spark, d, "supplier").select(key("s_suppkey"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("long").alias("lines"))
    base = versions.commit(first, path, 0)
    lines = V.table(spark, d, "lineitem").groupBy(key("l_suppkey")).agg(F.count("*").alias("lines"))
    people = V.table(spark, d, "customer").where("c_custkey % 3 = 0").select(key("c_custkey"), F.col("c_nationkey").alias("nation"))
    versions.upsert(spark, path, lines, "code", base)
    try:
        versions.upsert(spark, path, people, "code", base)
    except versions.Stale:
        versions.upsert(spark, path, people, "code")
    both = [versions.read(spark, path, v).select(F.lit(v).alias("version"), "code", "nation", "lines") for v in (2, 3)]
    return both[0].unionByName(both[1])
