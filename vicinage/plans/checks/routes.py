"""Route geometry over ways derived from order lines."""

from pyspark.sql import Window, functions as F

from ...functions.geo import KM_PER_DEGREE as KM
from ...operators import routes as ops
from ...plans import quality
from ...session import kept
from .base import check

# Vertex n of a route is its n-th order line; way n runs from vertex n to vertex n + 1 over a middle point.
VERTICES = """v AS (SELECT route_id, row_number() OVER w AS n, lat, lng, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2
  FROM (SELECT route_id, seq, lat + seq * 0.0001 AS lat, lng + (l_partkey % 97) * 0.00001 AS lng, l_partkey, l_suppkey FROM routes_v)
  WINDOW w AS (PARTITION BY route_id ORDER BY seq, l_partkey, l_suppkey))"""


def way_points(t):
    """(route_id, way_id, seq, lat, lng): three vertices per way, every second way drawn backwards."""
    r = t.routes_v.withColumns({"lat": F.col("lat") + F.col("seq") * 0.0001, "lng": F.col("lng") + (F.col("l_partkey") % 97) * 0.00001})
    w = Window.partitionBy("route_id").orderBy("seq", "l_partkey", "l_suppkey")
    v = r.withColumns({"n": F.row_number().over(w), "lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)}).filter("lat2 IS NOT NULL")
    ends = F.array(F.struct("lat", "lng"), F.struct(((F.col("lat") + F.col("lat2")) / 2).alias("lat"), ((F.col("lng") + F.col("lng2")) / 2 + 0.001).alias("lng")),
                   F.struct(F.col("lat2").alias("lat"), F.col("lng2").alias("lng")))
    turned = F.when(F.col("n") % 2 == 0, F.reverse(ends)).otherwise(ends)
    return v.select("route_id", (F.col("route_id") * 1000 + F.col("n")).alias("way_id"), F.posexplode(turned).alias("seq", "p")) \
        .select("route_id", "way_id", "seq", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"))


def way_ends(points):
    h = F.struct("seq", "lat", "lng")
    e = points.groupBy("route_id", "way_id").agg(F.min(h).alias("h"), F.max(h).alias("t"))
    return e.select("route_id", "way_id", F.col("h.lat").alias("first_lat"), F.col("h.lng").alias("first_lng"), F.col("t.lat").alias("last_lat"), F.col("t.lng").alias("last_lng"))


# Ways with their ends in the drawn direction, ends joined two by two at their vertex, and the least way that each can reach.
JOINED = f"""{VERTICES},
w AS (SELECT route_id, route_id * 1000 + n AS way_id, n, lat, lng, lat2, lng2 FROM v WHERE lat2 IS NOT NULL),
e AS (SELECT route_id, way_id, 0 AS side, CASE WHEN n % 2 = 0 THEN lat2 ELSE lat END AS y, CASE WHEN n % 2 = 0 THEN lng2 ELSE lng END AS x FROM w
  UNION ALL SELECT route_id, way_id, 1, CASE WHEN n % 2 = 0 THEN lat ELSE lat2 END, CASE WHEN n % 2 = 0 THEN lng ELSE lng2 END FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY route_id, round(y, 7), round(x, 7) ORDER BY side, way_id) - 1 AS k FROM e),
j AS (SELECT a.route_id, a.way_id, a.side, b.way_id AS to_way, b.side AS to_side FROM p a LEFT JOIN p b ON a.route_id = b.route_id
  AND round(a.y, 7) = round(b.y, 7) AND round(a.x, 7) = round(b.x, 7) AND a.k // 2 = b.k // 2 AND a.k <> b.k)"""


@check("g02_chain_ways", f"""
WITH RECURSIVE {JOINED},
r AS (SELECT route_id, way_id, way_id AS met FROM w UNION SELECT r.route_id, r.way_id, j.to_way FROM r JOIN j ON j.route_id = r.route_id AND j.way_id = r.met WHERE j.to_way IS NOT NULL),
c AS (SELECT route_id, way_id, min(met) AS least FROM r GROUP BY route_id, way_id)
SELECT route_id, count(DISTINCT least) AS lines, count(*) AS ways, 2 * count(*) + count(DISTINCT least) AS vertices FROM c GROUP BY route_id""")
def chain(t):
    """Every way lies in one line, and a line holds the vertices of its ways without the joints twice."""
    points = way_points(t)
    chained = ops.chain(way_ends(points))
    laid = ops.lay_out(points, chained).groupBy("route_id").agg(F.count("*").alias("vertices"))
    lines = chained.groupBy("route_id").agg(F.count_distinct("line").alias("lines"), F.count("*").alias("ways"))
    return lines.join(laid, "route_id")


# Splits of each line (k, p: its points in order, flat) at its farthest vertex, for as long as that lies more than 25 m off.
SPLIT = """s AS (SELECT k, 1::BIGINT AS a, len(p)::BIGINT AS b, NULL::BIGINT AS m FROM flat
  UNION ALL SELECT k, unnest([a, m]), unnest([m, b]), unnest([m, NULL]) FROM (
    SELECT k, a, b, a + list_position(d, list_max(d)) AS m, list_max(d) AS far FROM (
      SELECT k, a, b, list_transform(range(a + 1, b), lambda i: {far}) AS d FROM s JOIN flat USING (k) WHERE b > a + 1)) WHERE far > 0.025)"""
_T = "CASE WHEN ({dx}) * ({dx}) + ({dy}) * ({dy}) > 0 THEN greatest(0.0, least(1.0, ((p[i].x - p[a].x) * ({dx}) + (p[i].y - p[a].y) * ({dy})) / (({dx}) * ({dx}) + ({dy}) * ({dy})))) ELSE 0.0 END"
_D = {"dx": "p[b].x - p[a].x", "dy": "p[b].y - p[a].y"}
SPLIT = SPLIT.format(far="sqrt(pow(p[i].x - p[a].x - {t} * ({dx}), 2) + pow(p[i].y - p[a].y - {t} * ({dy}), 2))".format(t=_T.format(**_D), **_D))


@check("g01_simplify", f"""
WITH RECURSIVE o AS (SELECT route_id AS k, lat, lng, seq, l_partkey, l_suppkey, avg(lat) OVER (PARTITION BY route_id) AS mean FROM routes_v),
flat AS (SELECT k, list({{'y': lat * {KM}, 'x': lng * {KM} * cos(radians(mean))}} ORDER BY seq, l_partkey, l_suppkey) AS p FROM o GROUP BY k),
{SPLIT}
SELECT k AS route_id, least(2, any_value(len(p))) + count(m) AS kept, 25.0::DOUBLE AS tolerance_m FROM flat JOIN s USING (k) GROUP BY k""")
def simplify(t):
    """Kept vertices per route at the first tolerance that fits the budget."""
    points = t.routes_v.select("route_id", F.lit(0).alias("line"), "seq", "l_partkey", "l_suppkey", "lat", "lng")
    rows = ops.simplify(points, "route_id", "line", ["seq", "l_partkey", "l_suppkey"])
    return rows.groupBy("route_id").agg(F.count("*").alias("kept"), F.max("tolerance_m").alias("tolerance_m"))


@check("q11_route_geometry", f"""
WITH RECURSIVE {JOINED},
-- walks from every loose end, those kept that begin at the lesser of their line's two
g AS (SELECT route_id, way_id AS start, side AS began, way_id, side AS entry, 0 AS piece FROM j WHERE to_way IS NULL
  UNION ALL SELECT g.route_id, start, began, j.to_way, j.to_side, piece + 1 FROM g JOIN j ON j.route_id = g.route_id AND j.way_id = g.way_id AND j.side = 1 - g.entry WHERE j.to_way IS NOT NULL),
t AS (SELECT route_id, start, began, arg_max(way_id, piece) AS stop, arg_max(1 - entry, piece) AS stopped FROM g GROUP BY route_id, start, began),
lines AS (SELECT g.* FROM g JOIN t USING (route_id, start, began) WHERE start < stop OR (start = stop AND began < stopped)),
-- once round from the head of every way of a ring, kept for its least way
h AS (SELECT route_id, way_id AS start, way_id, 0 AS entry, 0 AS piece FROM w WHERE (route_id, way_id) NOT IN (SELECT (route_id, way_id) FROM g)
  UNION ALL SELECT h.route_id, start, j.to_way, j.to_side, piece + 1 FROM h JOIN j ON j.route_id = h.route_id AND j.way_id = h.way_id AND j.side = 1 - h.entry WHERE j.to_way <> start),
least_ AS (SELECT route_id, start FROM h GROUP BY route_id, start HAVING min(way_id) = start),
laid AS (SELECT route_id, start, way_id, entry, piece FROM lines UNION ALL SELECT route_id, start, way_id, entry, piece FROM h JOIN least_ USING (route_id, start)),
o AS (SELECT (l.route_id, l.start) AS k, piece, i, CASE WHEN i = 1 THEN (lat + lat2) / 2 WHEN (i = 0) = ((n % 2 = 1) = (entry = 0)) THEN lat ELSE lat2 END AS y,
    CASE WHEN i = 1 THEN (lng + lng2) / 2 + 0.001 WHEN (i = 0) = ((n % 2 = 1) = (entry = 0)) THEN lng ELSE lng2 END AS x
  FROM laid l JOIN w USING (route_id, way_id), range(3) AS r(i) WHERE piece = 0 OR i > 0),
flat AS (SELECT k, list({{'y': y * {KM}, 'x': x * {KM} * cos(radians(mean)), 'lat': y}} ORDER BY piece, i) AS p FROM (SELECT *, avg(y) OVER (PARTITION BY k) AS mean FROM o) GROUP BY k),
{SPLIT},
kept AS (SELECT k, unnest(list_distinct(list_concat([1::BIGINT, len(any_value(p))::BIGINT], list(m) FILTER (m IS NOT NULL)))) AS m FROM s JOIN flat USING (k) GROUP BY k),
v2 AS (SELECT k, round(p[m].lat, 6) AS lat FROM kept JOIN flat USING (k))
SELECT k[1] AS osm_id, CASE WHEN k[1] % 2 = 0 THEN 'hiking_route' ELSE 'cycle_route' END AS kind, count(DISTINCT k[2])::INT AS parts, count(*)::INT AS points,
  min(lat) AS bbox_south, max(lat) AS bbox_north FROM v2 GROUP BY k[1]""")
def geometry(t):
    """Route places with shape and box, from relations and ways."""
    points = kept(way_points(t))         # relations, ways and places are all made of it
    relations = points.groupBy("route_id").agg(F.array_sort(F.collect_set("way_id")).alias("members"))
    ways = points.drop("route_id")
    places = points.select(F.col("route_id").alias("osm_id")).distinct().withColumn(
        "kind", F.when(F.col("osm_id") % 2 == 0, "hiking_route").otherwise("cycle_route"))
    rows = quality.build_route_geometry(places, relations, ways)
    return rows.select("osm_id", "kind", F.size("path_parts").alias("parts"), F.size(F.flatten("path_parts")).alias("points"), "bbox_south", "bbox_north")
