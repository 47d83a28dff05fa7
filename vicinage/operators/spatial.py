"""Grid joins: radius, region, nearest.

Latitude and longitude are cut into cells; near things share a cell or touch, so every join below
is an equi join on the cell followed by the exact test. Probes are reduced to distinct positions
first; busy cells are split by adaptive skew handling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..session import cut

EARTH_DEGREE_KM = geo.EARTH_KM * math.pi / 180   # a degree of a great circle, as distances are measured
MIN_RADIUS_KM = 0.001
SPREAD = 8                                       # shares of a spot's probes, and join tasks per core


def cell(c: Column, size: float | Column) -> Column:
    return F.floor(c / size).cast("bigint")


def _around(df: DataFrame, lat_size: float, lng_size: float) -> DataFrame:
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (df.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
            .withColumns({"_cy": cell(F.col("lat"), lat_size) + F.col("_dy"),
                          "_cx": cell(F.col("lng"), lng_size) + F.col("_dx")}).drop("_dx", "_dy"))


def _cells_of_band(row: Column, band: float) -> Column:
    """How many cells a band of latitude has around the globe: as many as are no narrower than the radius.

    A circle around a point at latitude f reaches asin(sin r / cos f) degrees of longitude; f is at most
    one band away. Where a circle may hold a pole, the band is one cell.
    """
    f = F.greatest(F.abs((row - 1) * band), F.abs((row + 2) * band))
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(band))) / F.cos(F.radians(f)))))
    return F.when(f + band < 90, F.greatest(F.lit(1), F.floor(360 / reach))).otherwise(F.lit(1)).cast("bigint")


def _turn(lng: Column, cells: Column) -> Column:
    """The cell of a longitude among those around the globe; 180 and -180 are one place."""
    return F.pmod(F.floor((lng + 180) / 360 * cells).cast("bigint"), cells)


def radius_join(probes: DataFrame, targets: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of a probe and a target within the radius, with `distance_km`, anywhere on the globe.

    Both sides have lat and lng; `targets` columns get the prefix `t_`. Bands are as high as the radius and
    cut into cells at least as wide, so the cells beside a target's in its band and the next ones hold its
    circle. Distinct probe positions meet the targets, so many probes on one spot cost one test.
    """
    band = max(radius_km, MIN_RADIUS_KM) / EARTH_DEGREE_KM * (1 + 1e-9)
    valid = geo.valid_point(F.col("lat"), F.col("lng"))
    here = probes.filter(valid)
    spots = here.select("lat", "lng").distinct().withColumn("_cy", cell(F.col("lat"), band))
    spots = spots.withColumn("_cx", _turn(F.col("lng"), _cells_of_band(F.col("_cy"), band)))
    there = targets.filter(valid).withColumn("_cy", F.explode(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda step: cell(F.col("lat"), band) + step)))
    there = there.withColumn("_n", _cells_of_band(F.col("_cy"), band))
    there = there.withColumn("_cx", F.explode(F.array_distinct(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda step: F.pmod(_turn(F.col("lng"), F.col("_n")) + step, F.col("_n"))))))
    prefixed = [F.col(c).alias(f"t_{c}") for c in targets.columns]
    d = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("t_lat"), F.col("t_lng"))
    pairs = (spots.join(there.select("_cy", "_cx", *prefixed), ["_cy", "_cx"]).withColumn("distance_km", d)
             .filter(F.col("distance_km") <= radius_km).drop("_cy", "_cx"))
    # Probes and targets of one spot multiply, so a spot's probes are dealt to several tasks, its targets sent to each.
    tasks = SPREAD * probes.sparkSession.sparkContext.defaultParallelism
    dealt = here.withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int"))
    copies = pairs.withColumn("_share", F.explode(F.array(*[F.lit(i) for i in range(SPREAD)])))
    spot = ["lat", "lng", "_share"]
    met = dealt.repartition(tasks, *spot).join(copies.repartition(tasks, *spot), spot)
    return met.select(*probes.columns, *[f"t_{c}" for c in targets.columns], "distance_km")


def region_cells(regions: DataFrame, size: float) -> DataFrame:
    """Regions once per grid cell their bounds touch."""
    ys = F.explode(F.sequence(cell(F.col("south"), size), cell(F.col("north"), size)))
    xs = F.explode(F.sequence(cell(F.col("west"), size), cell(F.col("east"), size)))
    return regions.withColumn("_cy", ys).withColumn("_cx", xs)


def assign_region(points: DataFrame, regions: DataFrame, order: str = "region_id", size: float = 0.05,
                  out: str = "region", name: str = "name") -> DataFrame:
    """Points with the first region, in order, whose outline holds them; null for none.

    Distinct positions meet the regions, so many points on one spot cost one test. `regions`:
    (order, name, south, north, west, east, rings).
    """
    spots = points.filter(geo.valid_point(F.col("lat"), F.col("lng"))).select("lat", "lng").distinct()
    shapes = region_cells(regions.select(order, F.col(name).alias("_name"), "south", "north", "west", "east", "rings"),
                          size)
    in_bounds = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(F.col("west"), F.col("east"))
    hits = (spots.withColumns({"_cy": cell(F.col("lat"), size), "_cx": cell(F.col("lng"), size)})
            .join(shapes, ["_cy", "_cx"])
            .filter(in_bounds & geo.point_in_rings(F.col("lat"), F.col("lng"), F.col("rings"))))
    first = hits.groupBy("lat", "lng").agg(F.min_by("_name", order).alias(out))
    return points.join(first, ["lat", "lng"], "left")


def nearest(points: DataFrame, refs: DataFrame, key: str = "ref_id", size: float = 0.05,
            max_size: float = 720.0) -> DataFrame:
    """Distinct point positions with the nearest reference by squared degrees (ties: smallest key).

    A position looks at the 3 x 3 cells around it; a hit closer than one cell is final, all others
    go on with cells four times as large. Rounds end when every position is settled.
    """
    spots = points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("lat", "lng").distinct()
    sites = refs.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()) \
        .groupBy("lat", "lng").agg(F.min(key).alias(key))
    done: list[DataFrame] = []
    open_ = cut(spots)
    while True:
        near = _around(sites, size, size).select(
            "_cy", "_cx", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), key)
        d2 = (F.col("lat") - F.col("r_lat")) * (F.col("lat") - F.col("r_lat")) \
            + (F.col("lng") - F.col("r_lng")) * (F.col("lng") - F.col("r_lng"))
        best = (open_.withColumns({"_cy": cell(F.col("lat"), size), "_cx": cell(F.col("lng"), size)})
                .join(near, ["_cy", "_cx"]).withColumn("d2", d2)
                .groupBy("lat", "lng").agg(F.min(F.struct("d2", key)).alias("_best")))
        last = size >= max_size
        settled = cut(best.filter(F.lit(last) | (F.col("_best.d2") <= size * size))
                      .select("lat", "lng", F.col(f"_best.{key}").alias(key), F.col("_best.d2").alias("d2")))
        done.append(settled)
        open_ = cut(open_.join(settled, ["lat", "lng"], "left_anti"))
        if last or open_.isEmpty():
            break
        size *= 4
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
