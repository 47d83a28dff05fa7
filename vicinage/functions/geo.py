"""Distances, boxes, rings and polylines as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Sphere radius, kilometres and metres per degree, country boxes (south, north, west, east).
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
M_PER_DEGREE_LNG = 111_320.0
M_PER_DEGREE_LAT = 110_540.0
COUNTRY_BOX = (49.40, 50.20, 5.70, 6.55)
EXTRACT_BOX = (49.44, 50.19, 5.72, 6.55)


def valid_point(lat: Column, lng: Column) -> Column:
    """A real position: both numbers present and not the 0/0 that means "nothing found"."""
    return F.coalesce(lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0)), F.lit(False))


def numeric_or_null(value: Column) -> Column:
    """A JSON value as a coordinate only when it is a number, not a string or a boolean."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"),
                  F.try_variant_get(value, "$", "double"))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres on a sphere."""
    d_lat = F.sin(F.radians(lat2 - lat1) / 2)
    d_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = d_lat * d_lat + d_lng * d_lng * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bounding_box(lat: float, lng: float, radius_km: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) of a box that always encloses the circle; plain numbers, so pushable."""
    d_lat = radius_km / KM_PER_DEGREE
    d_lng = radius_km / (KM_PER_DEGREE * max(math.cos(math.radians(lat)), 0.01))
    return lat - d_lat, lat + d_lat, lng - d_lng, lng + d_lng


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return (lat >= south) & (lat <= north) & (lng >= west) & (lng <= east)


def plausible(lat: Column, lng: Column, box: tuple[float, float, float, float] = COUNTRY_BOX) -> Column:
    return F.coalesce(in_box(lat, lng, box), F.lit(False))


def _segment_km(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Point to segment on a local plane, the foot of the perpendicular clamped to the segment."""
    kx = F.lit(KM_PER_DEGREE) * F.cos(F.radians((a["lat"] + b["lat"]) / 2))
    ky = F.lit(KM_PER_DEGREE)
    px, py = (lng - a["lng"]) * kx, (lat - a["lat"]) * ky
    bx, by = (b["lng"] - a["lng"]) * kx, (b["lat"] - a["lat"]) * ky
    squared = bx * bx + by * by
    along = F.when(squared == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / F.nullif(squared, F.lit(0.0)))))
    return F.hypot(px - along * bx, py - along * by)


def distance_to_path_km(lat: Column, lng: Column, parts: Column) -> Column:
    """Nearest point of the nearest segment over all parts; parts are never joined to each other."""
    def of_part(points: Column) -> Column:
        ahead = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
        behind = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
        segments = F.zip_with(behind, ahead, lambda a, b: _segment_km(lat, lng, a, b))
        return F.when(
            F.size(points) == 1,
            haversine_km(lat, lng, points.getItem(0)["lat"], points.getItem(0)["lng"]),
        ).when(F.size(points) > 1, F.array_min(segments))
    return F.array_min(F.transform(parts, of_part))


def distance_km(lat: Column, lng: Column, row_lat: Column, row_lng: Column, parts: Column | None = None) -> Column:
    """How far a row is, point or line; null when it is neither."""
    point = F.when(valid_point(row_lat, row_lng), haversine_km(lat, lng, row_lat, row_lng))
    if parts is None:
        return point
    return F.when(F.size(F.coalesce(parts, F.array())) > 0, distance_to_path_km(lat, lng, parts)).otherwise(point)


def ring_area_m2(ring: Column) -> Column:
    """Shoelace area of a lon/lat ring in square metres; zero below three points."""
    k = F.cos(F.radians(F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p["lat"]) / F.size(ring)))
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    x = lambda p: p["lng"] * M_PER_DEGREE_LNG * k
    y = lambda p: p["lat"] * M_PER_DEGREE_LAT
    cross = F.zip_with(ring, turned, lambda p, q: x(p) * y(q) - x(q) * y(p))
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(
        F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2)


def largest_ring_m2(rings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rings, ring_area_m2)), F.lit(0.0))


def point_in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Even-odd test: an odd number of edges crosses the ray going east."""
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crossings = F.zip_with(ring, turned, lambda p, q: F.when(
        ((p["lat"] > lat) != (q["lat"] > lat))
        & ((p["lng"] + (lat - p["lat"]) * (q["lng"] - p["lng"])
            / F.nullif(q["lat"] - p["lat"], F.lit(0.0))) > lng), 1).otherwise(0))
    return F.aggregate(crossings, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def point_in_rings(lat: Column, lng: Column, rings: Column) -> Column:
    return F.exists(rings, lambda ring: point_in_ring(lat, lng, ring))


def vertex_mean(points: Column) -> Column:
    """Mean of the vertices as struct(lat, lng); null for no vertices."""
    n = F.size(points)
    total = lambda key: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[key])
    return F.when(n > 0, F.struct((total("lat") / n).alias("lat"), (total("lng") / n).alias("lng")))


def path_bounds(parts: Column) -> Column:
    """struct(bbox_south, bbox_north, bbox_west, bbox_east) of all vertices."""
    flat = F.flatten(parts)
    lats = F.transform(flat, lambda p: p["lat"])
    lngs = F.transform(flat, lambda p: p["lng"])
    return F.struct(F.array_min(lats).alias("bbox_south"), F.array_max(lats).alias("bbox_north"),
                    F.array_min(lngs).alias("bbox_west"), F.array_max(lngs).alias("bbox_east"))


def within_view(lat: Column, lng: Column, centre: tuple[float, float], radius_km: float, zoom: float,
                follow_from: float = 10) -> Column:
    """Map-view membership: everything below the follow zoom, and rows without a position, stay in."""
    if zoom < follow_from:
        return F.lit(True)
    d = haversine_km(F.lit(centre[0]), F.lit(centre[1]), lat, lng)
    return F.when(valid_point(lat, lng), d <= radius_km).otherwise(F.lit(True))
