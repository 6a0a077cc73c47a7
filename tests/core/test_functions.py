"""Geometry and number functions against stated values and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem

RING = "array<struct<x:double,z:double>>"


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def ring(*points):
    return [(float(x), float(z)) for x, z in points]


SQUARE = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
HOLE = ring((3, 3), (7, 3), (7, 7), (3, 7), (3, 3))
POLYS = f"a array<{RING}>, b array<{RING}>"


def test_area_with_a_hole(spark):
    a = F.col("a")
    got = one(spark, POLYS, ([SQUARE, HOLE], [SQUARE]), geom.area(a[0]), geom.polygon_area(a), geom.area(F.slice(a[0], 1, 4)))
    assert tuple(got) == (100, 84, 100)


@pytest.mark.parametrize(("b", "want"), [([SQUARE], 84), ([HOLE], 0), ([ring((5, 5), (15, 5), (15, 15), (5, 15))], 21), ([ring((20, 20), (30, 20), (25, 30))], 0)])
def test_overlap_respects_holes(spark, b, want):
    for x, y in (([SQUARE, HOLE], b), (b, [SQUARE, HOLE]), ([SQUARE[::-1], HOLE], [r[::-1] for r in b])):
        assert abs(one(spark, POLYS, (x, y), geom.overlap_area(F.col("a"), F.col("b")))[0] - want) < 1e-6


def test_overlap_of_star_polygons(spark):
    rng = random.Random(1)

    def star():
        c = rng.uniform(-3, 3), rng.uniform(-3, 3)
        return ring(*[(c[0] + rng.uniform(2, 8) * math.cos(2 * math.pi * k / 9), c[1] + rng.uniform(2, 8) * math.sin(2 * math.pi * k / 9)) for k in range(9)])

    def holds(p, r):
        return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:] + r[:1], strict=True)) % 2

    pairs = [(star(), star()) for _ in range(4)]
    rows = spark.createDataFrame([([a], [b]) for a, b in pairs], POLYS).select(geom.overlap_area(F.col("a"), F.col("b")), geom.area(F.col("a")[0]), geom.area(F.col("b")[0])).collect()
    grid = [(-12 + (i + 0.5) * 0.1, -12 + (j + 0.5) * 0.1) for i in range(240) for j in range(240)]
    for (a, b), (got, sa, sb) in zip(pairs, rows, strict=True):
        want = 0.01 * sum(holds(p, a) and holds(p, b) for p in grid)
        assert abs(got - want) < 0.02 * max(want, 10) and -1e-9 <= got <= min(sa, sb) + 1e-6


def test_triangles_cover_a_polygon_once(spark):
    rng = random.Random(5)

    def star(n, near, far, x=0.0, z=0.0):
        turned = rng.choice((1, -1))
        points = [(x + (d := rng.uniform(near, far)) * math.cos(turned * 2 * math.pi * k / n), z + d * math.sin(turned * 2 * math.pi * k / n)) for k in range(n)]
        return ring(*points, *(points[:1] if rng.random() < 0.5 else []))

    polys = [[star(rng.randint(3, 40), 5, 9), *[star(rng.randint(3, 9), 0.3, 0.9, x, z) for x, z in ((-1, -1), (1, -1), (0.0, 1.2))[: rng.randint(0, 3)]]] for _ in range(12)]
    polys = [p for p in polys if len(p[0]) > 6] + [[SQUARE, HOLE], [SQUARE[::-1], HOLE], [ring((0, 0), (5, 0), (9, 0))], [ring((0, 0))], [[]], []]
    rows = spark.createDataFrame([(p,) for p in polys], f"a array<{RING}>").select("a", geom.triangles(F.col("a")).alias("t"), geom.trapezoids(F.col("a")).alias("q")).collect()
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    holds = lambda t, p: len({side(a, b, p) > 0 for a, b in zip(t, t[1:] + t[:1], strict=True)}) == 1
    crossed = lambda r, p: sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:] + r[:1], strict=True))
    shoelace = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))) / 2
    for r in rows:
        rings = [[tuple(p) for p in own] for own in r.a]
        found = [[tuple(p) for p in t] for t in r.t]
        want = shoelace(rings[0]) - sum(map(shoelace, rings[1:])) if rings else 0
        assert abs(sum(map(shoelace, found)) - want) < 1e-9 * max(want, 1) and len(found) <= 2 * len(r.q)
        for _ in range(300):
            p = rng.uniform(-9, 10), rng.uniform(-9, 10)
            assert sum(holds(t, p) for t in found) == sum(crossed(own, p) for own in rings) % 2
    assert rows[-1].t == rows[-2].t == rows[-3].t == rows[-4].t == []


def test_containment(spark):
    inside = geom.inside_polygon(F.col("p"), F.col("a"))
    rows = [((1.0, 1.0), True), ((5.0, 5.0), False), ((-1.0, 5.0), False), ((3.5, 2.0), True), ((0.0, 0.0), True), ((10.0, 5.0), False), ((5.0, 10.0), False)]
    for p, want in rows:
        assert one(spark, f"a array<{RING}>, p struct<x:double,z:double>", ([SQUARE, HOLE], p), inside)[0] is want


def test_segment_distance(spark):
    d = geom.segment_distance(F.col("p"), F.col("a"), F.col("b"))
    s = "p struct<x:double,z:double>, a struct<x:double,z:double>, b struct<x:double,z:double>"
    assert one(spark, s, ((5.0, 4.0), (0.0, 0.0), (10.0, 0.0)), d)[0] == 4
    assert one(spark, s, ((3.0, 4.0), (0.0, 0.0), (0.0, 0.0)), d)[0] == 5


def test_projection(spark):
    p = geom.project(F.col("lon"), F.col("lat"), (3.7890245, 48.5097657))
    east = one(spark, "lon double, lat double", (3.7900245, 48.5097657), p["x"], p["z"])
    north = one(spark, "lon double, lat double", (3.7890245, 48.5107657), p["x"], p["z"])
    assert abs(east[0] - 73.666) < 1e-3 and abs(north[1] + 111.195) < 1e-3


def test_clipping(spark):
    e = F.struct(F.lit(0.0).alias("minx"), F.lit(10.0).alias("maxx"), F.lit(0.0).alias("minz"), F.lit(10.0).alias("maxz"))
    line = ring((-5, 5), (5, 5), (15, 5), (15, 8), (5, 8), (5, 20))
    got = one(spark, f"l {RING}", (line,), geom.clip_line(F.col("l"), e))[0]
    assert [[tuple(p) for p in piece] for piece in got] == [ring((0, 5), (5, 5), (10, 5)), ring((10, 8), (5, 8), (5, 10))]
    touching = one(spark, f"l {RING}", (ring((-5, 10), (0, 10)),), geom.clip_line(F.col("l"), e))[0]
    assert [[tuple(p) for p in piece] for piece in touching] == [ring((0, 10), (0, 10))]
    cut = geom.clip_ring(F.col("l"), e)
    assert one(spark, f"l {RING}", (ring((5, 5), (15, 5), (15, 15), (5, 15)),), geom.area(cut))[0] == 25
    assert one(spark, f"l {RING}", (ring((20, 20), (30, 20), (30, 30)),), F.size(cut))[0] == 0


def test_sampling_and_strips(spark):
    line = ring((0, 0), (3, 0), (3, 0), (3, 10))
    got = one(spark, f"l {RING}", (line,), geom.sample_line(F.col("l"), 2.0))[0]
    assert [(p.x, p.z) for p in got] == [(1, 0), (3, 0), (3, 2), (3, 4), (3, 6), (3, 8), (3, 10)]
    assert one(spark, f"l {RING}", (ring((0, 0), (1, 0)),), F.size(geom.sample_line(F.col("l"), 4.0)))[0] == 0
    quads = one(spark, f"l {RING}", (ring((0, 0), (10, 0)),), geom.strip(F.col("l"), 2.0))[0]
    assert [tuple(p) for p in quads[0]] == [(0, 1), (10, 1), (10, -1), (0, -1)] and len(quads) == 1
    circle = one(spark, "p struct<x:double,z:double>", ((1.0, 2.0),), geom.halo(F.col("p")))[0]
    assert len(circle) == 33 and abs(circle[0].x - 23) < 1e-9


def test_roof_axis(spark):
    axis = one(spark, f"l {RING}", (ring((0, 0), (20, 0), (20, 6), (0, 6), (0, 0)),), geom.roof_axis(F.col("l")))[0]
    assert abs(axis["max"] - axis["min"] - 6) < 1e-9 and abs(abs(axis.uz) - 1) < 1e-9 and axis.area == 120
    assert one(spark, f"l {RING}", (ring((0, 0), (0.5, 0), (0, 0.5)),), geom.roof_axis(F.col("l")))[0] is None


def test_numbers(spark):
    texts = ["5.5 m", "", None, "abc", " -2.5e1x", ".5", "12", "+3."]
    want = [5.5, None, None, None, -25.0, 0.5, 12.0, 3.0]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(jsem.parse_float("t")).collect()] == want
    halves = spark.createDataFrame([(x,) for x in (-2.5, 2.5, -0.5, 1.4)], "x double")
    assert [r[0] for r in halves.select(jsem.round_half_up(F.col("x"))).collect()] == [-2, 3, 0, 1]
    nan = spark.createDataFrame([(float("nan"),), (0.0,), (None,), (2.0,)], "x double")
    assert [r[0] for r in nan.select(jsem.number_or(F.col("x"), F.lit(4.0))).collect()] == [4, 4, 4, 2]


def test_hash_and_random(spark):
    assert one(spark, "t string", ("way/588791993",), jsem.text_hash("t"))[0] == 1638571065

    def draws(seed, n):
        out, mask = [], 0xFFFFFFFF
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) & mask
            t = ((seed ^ seed >> 15) * (1 | seed)) & mask
            t = ((t + ((t ^ t >> 7) * (61 | t) & mask)) & mask) ^ t
            out.append((t ^ t >> 14) / 2**32)
        return out

    got = [r[0] for r in spark.range(1, 51).orderBy("id").select(jsem.seeded_random(F.col("id"))).collect()]
    assert got == draws(10220, 50)
