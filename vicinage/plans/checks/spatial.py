"""Grid joins and ring geometry."""

from pyspark.sql import functions as F

from ...functions import geo
from ...operators import spatial as ops
from .base import check
from .filters import haversine_sql
from .places import REGION_HIT

POINT = """49.45 + CAST({k} * 7919 % 1000 AS DOUBLE) * 0.0007 AS lat, 5.75 + CAST({k} * 6101 % 1000 AS DOUBLE) * 0.0008 AS lng"""


def points(df, key, name):
    k = F.col(key)
    return df.select(k.alias(name), (F.lit(49.45) + (k * 7919 % 1000).cast("double") * 0.0007).alias("lat"),
                     (F.lit(5.75) + (k * 6101 % 1000).cast("double") * 0.0008).alias("lng"))


@check("a10_ring_area", """
SELECT region_id, round(0.16 * 0.14 * 111320.0 * 110540.0 * cos(radians(miny + 0.07)), 0) AS area FROM regions_v""")
def area(t):
    return t.regions.select("region_id", F.round(geo.largest_ring_m2(F.col("rings")), 0).alias("area"))


@check("j06_nearest_commune", """
SELECT DISTINCT CAST(l.id AS VARCHAR) AS id, first_value(c.commune_id) OVER (PARTITION BY l.id ORDER BY
  (c.lat - l.lat) * (c.lat - l.lat) + (c.lng - l.lng) * (c.lng - l.lng), c.commune_id) AS commune_id
FROM listings_v l, communes_v c WHERE l.lat IS NOT NULL""")
def nearest(t):
    hits = ops.nearest(t.listings.filter("lat IS NOT NULL"), t.communes, "commune_id")
    return t.listings.join(hits, ["lat", "lng"]).select("id", "commune_id")


@check("j07_assign_region", f"""
SELECT p.osm_id, min_by(r.name, r.region_id) AS region FROM places_v p LEFT JOIN regions_v r ON {REGION_HIT} GROUP BY p.osm_id""")
def assign(t):
    return ops.assign_region(t.elements, t.regions).select("osm_id", "region")


@check("j08_radius_join", f"""
WITH s AS (SELECT s_suppkey, {POINT.format(k='s_suppkey')} FROM supplier), c AS (SELECT c_custkey, {POINT.format(k='c_custkey * 3')} FROM customer)
SELECT c_custkey, s_suppkey, round({haversine_sql('s.lat', 's.lng', 'c.lat', 'c.lng')}, 6) AS km FROM s, c
WHERE {haversine_sql('s.lat', 's.lng', 'c.lat', 'c.lng')} <= 2""")
def radius(t):
    customers = points(t.customer.withColumn("k", F.col("c_custkey") * 3), "k", "k").select((F.col("k") / 3).cast("bigint").alias("c_custkey"), "lat", "lng")
    suppliers = points(t.supplier, "s_suppkey", "s_suppkey")
    pairs = ops.radius_join(customers, suppliers, 2)
    return pairs.select("c_custkey", F.col("t_s_suppkey").alias("s_suppkey"), F.round("distance_km", 6).alias("km"))
