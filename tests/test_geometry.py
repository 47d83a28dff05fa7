"""Geometry against independent formulas and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinage.functions import geo
from vicinage.operators import filters, routes, spatial


def cosines(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 6371 * math.acos(min(1, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)))


def scatter(n, seed, low=(49.4, 5.7), high=(50.2, 6.5)):
    r = random.Random(seed)
    return [(i, r.uniform(low[0], high[0]), r.uniform(low[1], high[1])) for i in range(n)]


def test_circle_and_its_box(spark):
    pts = scatter(2000, 1)
    df = spark.createDataFrame([(str(i), a, b) for i, a, b in pts], "id string, lat double, lng double")
    got = {r.id: r.distance_km for r in filters.within_radius(df, 49.75, 6.1, 12).collect()}
    want = {str(i): cosines(49.75, 6.1, a, b) for i, a, b in pts if cosines(49.75, 6.1, a, b) <= 12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_missing_positions(spark):
    df = spark.sql("""SELECT parse_json(j) AS v FROM VALUES ('{"lat":49.6,"lng":6.1}'), ('{"lat":"49.6","lng":6.1}'), ('{"lat":true,"lng":6.1}'),
      ('{"lat":0,"lng":0}'), ('{"lng":6.1}') AS t(j)""")
    lat = geo.numeric_or_null(F.try_variant_get("v", "$.lat", "variant"))
    lng = geo.numeric_or_null(F.try_variant_get("v", "$.lng", "variant"))
    assert [r.ok for r in df.select(geo.valid_point(lat, lng).alias("ok")).collect()] == [True, False, False, False, False]


def ring(spark, points):
    return spark.createDataFrame([(points,)], "r array<struct<lat:double,lng:double>>")


def test_ring_area_and_direction(spark):
    d_lat, d_lng = 100 / 110540, 100 / (111320 * math.cos(math.radians(49.7)))
    square = [(49.7, 6.0), (49.7, 6.0 + d_lng), (49.7 + d_lat, 6.0 + d_lng), (49.7 + d_lat, 6.0)]
    for points in (square, square[::-1]):
        assert ring(spark, points).select(geo.ring_area_m2(F.col("r"))).first()[0] == pytest.approx(10_000, rel=1e-3)
    assert ring(spark, square[:2]).select(geo.ring_area_m2(F.col("r"))).first()[0] == 0


def test_distance_to_a_line(spark):
    r = random.Random(3)
    line = [(49.6 + r.uniform(-.05, .05), 6.0 + r.uniform(-.05, .05)) for _ in range(6)]
    dense = [(a[0] + (b[0] - a[0]) * k / 400, a[1] + (b[1] - a[1]) * k / 400) for a, b in zip(line, line[1:]) for k in range(401)]
    df = spark.createDataFrame([([line],)], "p array<array<struct<lat:double,lng:double>>>")
    got = df.select(geo.distance_to_path_km(F.lit(49.65), F.lit(6.02), F.col("p"))).first()[0]
    assert got == pytest.approx(min(cosines(49.65, 6.02, *p) for p in dense), rel=0.01)
    single = spark.createDataFrame([([[(49.6, 6.0)], []],)], "p array<array<struct<lat:double,lng:double>>>")
    assert single.select(geo.distance_to_path_km(F.lit(49.65), F.lit(6.02), F.col("p"))).first()[0] == pytest.approx(cosines(49.65, 6.02, 49.6, 6.0))


def test_nearest_reference(spark):
    points, refs = scatter(300, 5), scatter(40, 6, (48.0, 4.0), (52.0, 8.0))
    p = spark.createDataFrame(points, "id int, lat double, lng double")
    r = spark.createDataFrame(refs, "ref_id int, lat double, lng double")
    got = {(x.lat, x.lng): x.ref_id for x in spatial.nearest(p, r, size=0.02).collect()}
    assert got == {(a, b): min(refs, key=lambda q: ((q[1] - a) ** 2 + (q[2] - b) ** 2, q[0]))[0] for _, a, b in points}


def test_radius_join_with_a_crowded_cell(spark):
    """A third of the rows on one spot: all pairs are there, none twice."""
    a = scatter(150, 7) + [(1000 + i, 49.75, 6.1) for i in range(75)]
    b = scatter(60, 8) + [(2000, 49.7501, 6.1001)]
    x = spark.createDataFrame(a, "id int, lat double, lng double")
    y = spark.createDataFrame(b, "ref int, lat double, lng double")
    got = sorted((r.id, r.t_ref) for r in spatial.radius_join(x, y, 5).collect())
    assert got == sorted((i, j) for i, p, q in a for j, s, t in b if cosines(p, q, s, t) <= 5)


@pytest.mark.parametrize("radius", [60, 1500, 9000])
def test_radius_join_over_poles_and_date_line(spark, radius):
    a = scatter(40, 9, (-90, -180), (90, 180)) + [(100, 89.9, 10.0), (101, 70.0, 179.9), (102, -89.95, -120.0), (103, 10.0, 180.0)]
    b = scatter(40, 10, (-90, -180), (90, 180)) + [(200, 89.95, -170.0), (201, 70.1, -179.95), (202, -89.8, 60.0), (203, 10.0, -180.0)]
    x = spark.createDataFrame(a, "id int, lat double, lng double")
    y = spark.createDataFrame(b, "ref int, lat double, lng double")
    got = sorted((r.id, r.t_ref) for r in spatial.radius_join(x, y, radius).collect())
    assert {(100, 200), (101, 201), (102, 202), (103, 203)} <= set(got)
    assert got == sorted((i, j) for i, p, q in a for j, s, t in b if cosines(p, q, s, t) <= radius)


def simplified(points, tolerance):
    """Textbook recursion."""
    lat0 = math.radians(sum(p[0] for p in points) / len(points))
    flat = [(p[1] * 111 * math.cos(lat0), p[0] * 111) for p in points]

    def far(a, b, i):
        (ax, ay), (bx, by), (px, py) = flat[a], flat[b], flat[i]
        dx, dy = bx - ax, by - ay
        t = 0 if dx == dy == 0 else max(0, min(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    def keep(a, b):
        if b <= a + 1:
            return set()
        best = max(range(a + 1, b), key=lambda i: (far(a, b, i), -i))
        return {best} | keep(a, best) | keep(best, b) if far(a, b, best) > tolerance / 1000 else set()

    return {0, len(points) - 1} | keep(0, len(points) - 1)


def wiggle(n, seed, spread):
    r = random.Random(seed)
    lat, lng, out = 49.6, 6.0, []
    for _ in range(n):
        lat, lng = lat + r.uniform(-spread, spread), lng + r.uniform(0, spread)
        out.append((lat, lng))
    return out


def vertices(spark, lines):
    rows = [(k, 0, i, a, b) for k, pts in lines.items() for i, (a, b) in enumerate(pts)]
    return spark.createDataFrame(rows, "route_id int, line int, seq int, lat double, lng double")


def test_simplification_fits_the_budget(spark):
    lines = {1: wiggle(40, 1, .001), 2: wiggle(700, 2, .004), 3: wiggle(2, 3, .001), 4: wiggle(90, 4, .0001)}
    kept = {}
    for r in routes.simplify(vertices(spark, lines), "route_id", "line", ["seq"]).collect():
        kept.setdefault(r.route_id, (r.tolerance_m, set()))[1].add(r.seq)
    for k, pts in lines.items():
        tolerance = 25.0
        while len(simplified(pts, tolerance)) > 200 and tolerance <= 2000:
            tolerance *= 2
        assert kept[k] == (tolerance, simplified(pts, tolerance))


def test_long_lines_over_rounds(spark):
    df = vertices(spark, {1: wiggle(8, 1, .01), 2: wiggle(14, 2, .004)})
    local = {(r.route_id, r.seq): r.significance for r in routes.significance(df, ["route_id", "line"], ["seq"]).collect()}
    apart = {(r.route_id, r.seq): r.significance for r in routes.significance(df, ["route_id", "line"], ["seq"], local_points=10).collect()}
    assert local.keys() == apart.keys() and all(local[k] == pytest.approx(apart[k]) for k in local)


def test_ways_become_lines(spark):
    ways = [(1, 10, 0., 0., 0., 1.), (1, 11, 0., 2., 0., 1.), (1, 12, 0., 2., 0., 3.), (1, 13, 5., 5., 5., 6.), (2, 20, 0., 0., 1., 1.)]
    df = spark.createDataFrame(ways, "route_id int, way_id int, first_lat double, first_lng double, last_lat double, last_lng double")
    lines = {}
    for r in routes.chain(df).orderBy("route_id", "line", "piece").collect():
        lines.setdefault((r.route_id, r.line), []).append((r.way_id, r.reversed))
    as_sets = {frozenset(w for w, _ in v) for v in lines.values()}
    assert as_sets == {frozenset({10, 11, 12}), frozenset({13}), frozenset({20})}
    ends = {w: ((a, b), (c, d)) for _, w, a, b, c, d in ways}
    for line in lines.values():
        walked = [ends[w][::-1] if turned else ends[w] for w, turned in line]
        assert all(x[1] == y[0] for x, y in zip(walked, walked[1:]))


def test_many_lines_at_once_as_each_alone():
    r = random.Random(5)
    lines = [wiggle(r.choice([1, 2, 3, 4, 7, 9, 40, 300]), i, r.choice([0, .0002, .004])) for i in range(300)]
    lines += [[(49.5, 6.0), (49.6, 6.1), (49.5, 6.0)], [(49.5, 6.0), (float("nan"), 6.1), (49.7, 6.0), (49.5, 6.2)]]
    flat = np.array([p for line in lines for p in line])
    begins = np.cumsum([0, *map(len, lines)])[:-1].tolist()
    want = np.concatenate([routes._significance(*np.array(line).T, 0.025) for line in lines])
    assert np.array_equal(routes._significances(flat[:, 0].copy(), flat[:, 1].copy(), begins, 0.025), want)


def test_small_routes_are_chained_without_rounds(spark, monkeypatch):
    """In one task as over rounds: lines, rings, ways that are rings, ends without a value, many ways at one vertex."""
    r = random.Random(3)
    at = lambda: (float(r.randint(0, 3)), r.choice([0., 1., None, float("nan")]))
    ways = [(k, w, *at(), *at()) for k in range(60) for w in r.sample(range(100), r.randint(1, 14))]
    ways += [(60 + n, i, float(i), 0., float((i + 1) % n), 0.) for n in (1, 2, 3, 9) for i in range(n)]
    df = spark.createDataFrame(ways, "route_id int, way_id int, first_lat double, first_lng double, last_lat double, last_lng double")
    rounds = {tuple(x) for x in routes.chain_rounds(df, "route_id", "way_id").collect()}
    mixed = {tuple(x) for x in routes.chain(df, local_ways=5).collect()}
    monkeypatch.setattr(routes, "_followed", lambda *a: pytest.fail("rounds"))
    assert {tuple(x) for x in routes.chain(df).collect()} == rounds == mixed and len(rounds) == len(ways)


def test_small_routes_are_built_in_one_pass(spark, monkeypatch):
    """As step by step: shared ways, rings, ways of one vertex, repeated rows, missing values. Before, every step wrote all vertices."""
    r = random.Random(11)
    corner = lambda: (49.5 + r.randint(0, 3) / 100, 6.0 + r.randint(0, 2) / 100)
    wobble = lambda: (49.5 + r.random() / 30, 6.0 + r.random() / 30)
    whole = [(w, i, *p) for w in range(60) for i, p in enumerate([corner(), *[wobble() for _ in range(r.randint(0, 4))], corner()][:r.choice([1, 9, 9, 9])])]
    whole += whole[::9]
    odd = [(60, 0, None, 6.0), (60, 1, 49.5, 6.0), (61, 0, 49.5, float("nan")), (61, 1, 49.6, 6.0), (62, None, 49.5, 6.0), (62, 1, 49.6, 6.0)]
    members = [(k, r.sample(range(60), r.randint(1, 12))) for k in range(50)] + [(None, [1, 2]), (50, []), (51, None), (52, [3, 3, 99])]
    relations = lambda rows: spark.createDataFrame(rows, "route_id int, members array<int>")
    points = spark.createDataFrame(whole + odd, "way_id int, seq int, lat double, lng double")
    told = lambda df: sorted((x.route_id, str(x.path_parts), x.bbox_south, x.bbox_west, x.bbox_north, x.bbox_east) for x in df.collect())
    for rows in (members, members + [(53, [60, 5]), (54, [61, 5]), (55, [62, 5])]):
        shapes = relations(rows).select("route_id", F.explode(F.array_distinct("members")).alias("way_id")).join(points, "way_id")
        want = told(routes._build_in_steps(shapes))
        assert told(routes.build_geometry(relations(rows), points)) == want and len(want) >= 51
        assert told(routes.build_geometry(relations(rows), points, local_points=20)) == want
    monkeypatch.setattr(routes, "cut", lambda df: pytest.fail("written between the steps"))
    assert len(told(routes.build_geometry(relations(members), points))) >= 51


def test_routes_larger_than_a_task_are_named_only():
    """Rows of such a route are let go as they come, over any number of batches."""
    import pyarrow as pa

    schema = pa.schema([("route_id", pa.int64()), ("path_parts", pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lng", pa.float64())])))), ("apart", pa.bool_())])
    rows = [(k, w, i, 49.0 + w + i / 9, 6.0, 49.0 + w + i / 9, 6.0, False) for k, n in ((1, 2), (2, 9), (3, 1), (4, 2)) for w in range(n) for i in range(2)]
    for size in (1, 3, 4, 100):
        batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i:i + size])], names=list("abcdefgh")) for i in range(0, len(rows), size)]
        out = pa.Table.from_batches(routes._per_route(5, schema)(iter(batches)), schema=schema).to_pylist()
        assert sorted((x["route_id"], x["apart"], len(x["path_parts"] or [])) for x in out) == [(1, False, 2), (2, True, 0), (3, False, 1), (4, False, 2)]
