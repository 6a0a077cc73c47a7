"""Rounds, hot keys, sources and rules on small hand-made tables."""

import json
import math
import random

import pytest
from pyspark.errors import PySparkException  # noqa: F401
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem
from parcelwise.operators import cover, labels, landuse, quality, rounds, spatial
from parcelwise.plans import registry
from parcelwise.sources import elements, geojson, osm

POINT = "struct<x:double,z:double>"


def first_come_brute(marks, reach=45.0):
    records, out = [], {}
    for i, name, p, _ in sorted(marks, key=lambda m: (m[3], m[0])):
        near = [r for r in records if r[1] == name and ((r[2][0] - p[0]) ** 2 + (r[2][1] - p[1]) ** 2) ** 0.5 < reach]
        out[i] = near[0][0] if near else i
        records += [] if near else [(i, name, p)]
    return out


def test_chains_of_marks(spark):
    marks = [("A", "n", (0.0, 0.0), 1), ("B", "n", (30.0, 0.0), 2), ("C", "n", (60.0, 0.0), 3)]
    rng = random.Random(1)
    marks += [(f"r{k}", rng.choice("xyz"), (rng.uniform(0, 400), rng.uniform(0, 400)), k % 7) for k in range(200)]
    got = {r.id: r.record_id for r in spatial.first_come(spark.createDataFrame(marks, f"id string, name string, p {POINT}, ord long")).collect()}
    assert got == first_come_brute(marks) and got["B"] == "A" and got["C"] == "C"
    assert spatial.first_come(spark.createDataFrame([], f"id string, name string, p {POINT}, ord long")).collect() == []


def test_nearest_by_name_grows_its_cells(spark):
    rng = random.Random(2)
    marks = [(k, rng.choice(["a", "b", "none"]), (rng.uniform(-5000, 5000), rng.uniform(-5000, 5000))) for k in range(150)]
    records = [(1000 + k, "a" if k % 9 else "b", (rng.uniform(-5000, 5000), rng.uniform(-5000, 5000)), k) for k in range(60)] + [(2000, "a", (marks[0][2]), 99)]
    got = {r.id: r.record_id for r in spatial.nearest_by_name(spark.createDataFrame(marks, f"id long, name string, p {POINT}"), spark.createDataFrame(records, f"record_id long, record_name string, q {POINT}, ord long"), 8.0).collect()}
    want = {}
    for i, name, p in marks:
        near = sorted((((r[2][0] - p[0]) ** 2 + (r[2][1] - p[1]) ** 2) ** 0.5, r[3], r[0]) for r in records if r[1] == name)
        want |= {i: near[0][2]} if near else {}
    assert got == want


def test_intervals_across_cells(spark):
    ranges = [("k", 1, 0, 10), ("k", 2, 10, 3000), ("k", 3, 5000, 5001), ("j", 4, 100, 200), (None, 5, 0, 50)]
    asked = [(key, p, pos) for p, (key, pos) in enumerate([("k", 0), ("k", 9), ("k", 10), ("k", 2999), ("k", 3000), ("k", 4999), ("k", 5000), ("k", 5001), ("k", -1), ("j", 0), ("j", 150), ("x", 1), (None, 49)])]
    for cell in (1, 7, 1000, 1 << 16):
        got = spatial.interval_lookup(spark.createDataFrame(asked, "key string, point_id long, pos long"), spark.createDataFrame(ranges, "key string, id long, start long, end long"), ["key"], cell)
        assert [r.range_id for r in sorted(got.collect(), key=lambda r: r.point_id)] == [1, 1, 2, 2, None, None, 3, None, None, None, 4, None, 5]


@pytest.mark.parametrize("sort", [3, 1024])
def test_quantiles_of_hot_and_tied_keys(spark, sort):
    rng = random.Random(3)
    inf = float("inf")
    rows = [("hot", float(rng.choice([1, 2, 2, 2, 50, rng.random()]))) for _ in range(5000)] + [("same", 7.0)] * 40 + [("one", 3.0), (None, 1.0), (None, 2.0), ("hot", None), ("none", None)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(300)] + [("odd", x) for x in (inf, -inf, inf, 0.0, -1.0, inf)] + [("low", -(10.0 ** rng.uniform(-9, 9))) for _ in range(90)] + [("zero", x) for x in [0.0] * 30 + [5e-324, 1e308, -5e-324]]
    got = {r.k: (r.n, r.median, r.p95) for r in quality.interval_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", sort=sort).collect()}
    for k in ("hot", "same", "one", None, "wide", "odd", "low", "zero"):
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == (len(v), v[len(v) // 2], v[int(len(v) * 0.95)]), k
    assert "none" not in got


def test_one_value_a_million_times_is_counted(spark, monkeypatch):
    plans = []
    cut = rounds.cut
    monkeypatch.setattr(quality, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = quality.interval_statistics(spark.range(1_000_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id").cast("double")).alias("v")), ["k"], "v").first()
    assert (got.n, got.median, got.p95) == (1_000_000, 5.0, 500009.0) and len(plans) <= 8
    assert all("Window" not in p or "Aggregate" in p[p.index("Window") :] for p in plans)  # over counts of buckets


@pytest.mark.parametrize("way", ["rounds", "descent"])
def test_nearest_of_a_name_at_two_far_ends(spark, way):
    rng = random.Random(4)
    records = [(i, "hot", (rng.choice([-40_000, 40_000]) + rng.choice([0.0, rng.uniform(-30, 30)]), rng.uniform(-20, 20)), i) for i in range(400)]
    records += [(1000 + i, f"n{i % 3}", (rng.uniform(-900, 900), rng.uniform(-900, 900)), i) for i in range(30)] + [(2000, "alone", (5.0, 5.0), 1), (2001, "alone", (5.0, 5.0), 0)]
    marks = [(i, rng.choice(["hot", "hot", "n0", "n1", "alone", "none"]), (rng.uniform(-1, 1) * s, rng.uniform(-1, 1) * s)) for i, s in enumerate([100, 5e4, 3e6] * 25)]
    m, r = spark.createDataFrame(marks, f"id long, name string, p {POINT}"), spark.createDataFrame(records, f"record_id long, record_name string, q {POINT}, ord long")
    got = spatial.nearest_by_name(m, r) if way == "rounds" else spatial.nearest_by_descent(m, r, 80_100.0)
    d = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    want = {i: min((d(p, q), o, k) for k, other, q, o in records if other == name)[2] for i, name, p in marks if name != "none"}
    assert {x.id: x.record_id for x in got.collect()} == want


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranges_of_one_list_are_spread(spark, request, keys):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several ranges
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([0, 1, 5])) for i in range(500)]
    got = quality.running_ranges(spark.createDataFrame(rows, "k string, ord long, n long").repartition(7), keys, "ord", "n")
    at, want = {}, []
    for k, i, n in rows:
        key = k if keys else 0
        at[key] = at.get(key, 0) + n
        want += [(i, at[key] - n, at[key])] if n else []
    got = rounds.cut(got.select("k", "ord", "start", "end"))
    assert sorted(map(tuple, got.select("ord", "start", "end").collect())) == want
    assert quality.gaps(got, keys).count() == 0
    holes = got.where("ord % 10 <> 3")
    kept, last, bad = sorted(map(tuple, holes.collect()), key=lambda r: r[1]), {}, 0
    for k, _, start, end in kept:
        bad += start != last.get(k if keys else 0, 0)
        last[k if keys else 0] = end
    assert quality.gaps(holes, keys).count() == bad > 5


def kept_brute(n, pairs):
    against = {}
    for i, j in pairs:
        against.setdefault(i, set()).add(j)
    kept = {}
    for i in range(n):
        kept[i] = not any(kept[j] for j in against.get(i, ()))
    return kept


def graph(name, n):
    rng = random.Random(9)
    chain = [(i, i - 1) for i in range(1, n)]
    ladder = chain + [(i, i - 2) for i in range(2, n)]
    wild = [(i, rng.randrange(i)) for i in range(1, n) for _ in range(rng.choice([0, 1, 3]))]
    many = [(i, i - 1) for i in range(1, n) if i % 12] + [(i, i - 5) for i in range(5, n) if i % 12 > 7]
    return sorted(set({"none": [], "ladder": ladder, "wild": wild, "many": many}[name]))


@pytest.mark.parametrize("name, n, bound", [("none", 5, 9), ("ladder", 40, 60), ("wild", 200, 100_000), ("many", 300, 100)])
def test_first_kept_of_any_graph(spark, name, n, bound):
    pairs = graph(name, n)
    rows = spark.createDataFrame([(i, (f"{i:05d}", i)) for i in range(n)], "id long, order struct<a:string,b:long>")
    got = {r.id: r.kept for r in rounds.first_kept(rows, spark.createDataFrame(pairs, "id long, other long"), bound, 1).collect()}
    assert got == kept_brute(n, pairs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, cuts, cut = 100_000, [], rounds.cut  # a chain of 100,000 rows: pointers double 17 times
    monkeypatch.setattr(rounds, "cut", lambda df: cuts.append(1) or cut(df))
    rows = spark.range(n).select("id", F.col("id").alias("order"))
    got = rounds.first_kept(rows, rows.where("id > 0").select("id", (F.col("id") - 1).alias("other")), bound=1000)
    assert got.where(F.col("kept") == (F.col("id") % 2 == 0)).count() == n and len(cuts) < 40


BOXES = "struct<minx:double,maxx:double,minz:double,maxz:double>"


def test_rows_of_a_shape_are_bounded(spark):
    rows = [(k, (-(3.0**k), 3.0**k * 1.7, 5.0, 5.0 + 2.0**k)) for k in range(-5, 600)] + [(1000, (float("-inf"), 1.0, 0.0, 1.0)), (1001, (0.0, float("nan"), 0.0, 1.0)), (1002, None), (1003, (1e18, 1e18 + 500, 0.0, 0.0))]
    df = cover.sized(spark.createDataFrame(rows, f"id int, box {BOXES}"), F.col("box"), 80.0)
    got = {r["id"]: r["count"] for r in cover.cells(df, 80.0).groupBy("id").count().collect()}
    assert set(got) == {k for k, _ in rows} - {1000, 1001, 1002} and max(got.values()) <= (cover.FIT + 2) ** 2
    assert got[0] == got[3] == 2 and df.agg(F.max("_lev")).first()[0] > 900


def star(x, z, r, n, seed=0):
    rng = random.Random(seed)
    ring = [(x + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * k / n), z + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*ring, ring[0]]


def holds(poly, p):
    def inside(ring):
        n = 0
        for (ax, az), (bx, bz) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (az > p[1]) != (bz > p[1]) and p[0] < (bx - ax) * (p[1] - az) / (bz - az) + ax:
                n += 1
        return n % 2 == 1

    return inside(poly[0]) and not any(map(inside, poly[1:]))


def test_shapes_of_any_size_hold_the_same_points_as_by_brute_force(spark):
    rng = random.Random(5)
    shapes = [(0, [star(0, 0, 10**6, 40)]), (1, [star(100, 100, 10, 7)]), (2, [star(-3e4, 2e4, 5e4, 25, 2), star(-3e4, 2e4, 2e4, 9, 3)]), (3, [star(120, 90, 900, 12, 4), star(120, 90, 300, 5, 5)]), (4, [[(1e300, 1e300), (1e300, -1e300), (-1e300, 0.0)]])]
    shapes += [(10 + k, [star(rng.uniform(-2e3, 2e3), rng.uniform(-2e3, 2e3), 10 ** rng.uniform(0, 4), 6, k)]) for k in range(40)]
    points = [(i, (rng.uniform(-1, 1) * s, rng.uniform(-1, 1) * s)) for i, s in enumerate([50, 300, 3e3, 1e5, 1.2e6] * 60)] + [(9000, (float("nan"), 0.0)), (9001, None)]
    pts = spark.createDataFrame(points, "id long, p struct<x:double,z:double>")
    shp = spark.createDataFrame(shapes, "ord long, poly array<array<struct<x:double,z:double>>>")
    got = sorted(map(tuple, spatial.contained(pts, shp).select("id", "ord").collect()))
    assert got == sorted((i, k) for k, poly in shapes for i, p in points if p and p[0] == p[0] and holds(poly, p))
    assert len({k for _, k in got}) > 12
    cells = cover.polygon_cells(cover.sized(shp, geom.bounds(F.col("poly")[0]), 80.0), "poly", 80.0).groupBy("ord").agg(F.count("*").alias("n"), F.count_if("_whole").alias("whole"))
    many = {r.ord: (r.n, r.whole) for r in cells.collect()}
    assert max(n for n, _ in many.values()) <= 100 and many[0][1] > 5


def test_boxes_of_any_size_meet_once(spark):
    rng = random.Random(6)
    box = lambda: (lambda x, z, w, h: (x, x + w, z, z + h))(rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([0, 3, 10 ** rng.uniform(0, 7)]), 10 ** rng.uniform(0, 7))
    a, b = [(i, box(), i % 3) for i in range(80)], [(i, box(), i % 3) for i in range(90)]
    left, right = spark.createDataFrame(a, f"i long, u {BOXES}, g long"), spark.createDataFrame(b, f"j long, v {BOXES}, g long")
    meet = lambda u, v: u[0] <= v[1] and u[1] >= v[0] and u[2] <= v[3] and u[3] >= v[2]
    got = sorted(map(tuple, spatial.grid_join(left.drop("g"), right.drop("g"), "u", "v", 10.0).select("i", "j").collect()))
    assert got == sorted((i, j) for i, u, _ in a for j, v, _ in b if meet(u, v))
    got = sorted(map(tuple, spatial.grid_join(left, right, "u", "v", 10.0, by=("g",)).select("i", "j").collect()))
    assert got == sorted((i, j) for i, u, g in a for j, v, h in b if g == h and meet(u, v))


def test_long_segments_find_their_points(spark):
    rng = random.Random(7)
    lines = [(k, [(rng.uniform(-1, 1) * s, rng.uniform(-1, 1) * s) for _ in range(3)]) for k, s in enumerate([100, 1e4, 1e6] * 4)]
    points = [(i, (a[0] + t * (b[0] - a[0]) + rng.uniform(-15, 15), a[1] + t * (b[1] - a[1]) + rng.uniform(-15, 15))) for i in range(200) for _, line in [rng.choice(lines)] for a, b in [rng.choice([line[:2], line[1:]])] for t in [rng.random()]]
    got = sorted((r.id, r.ord) for r in spatial.nearest_segment(spark.createDataFrame(points, "id long, p struct<x:double,z:double>"), spark.createDataFrame(lines, "ord long, line array<struct<x:double,z:double>>"), "id", "ord").collect())

    def d(p, line):
        out = []
        for (ax, az), (bx, bz) in zip(line, line[1:], strict=False):
            t = max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - az) * (bz - az)) / ((bx - ax) ** 2 + (bz - az) ** 2)))
            out.append(math.hypot(p[0] - ax - t * (bx - ax), p[1] - az - t * (bz - az)))
        return min(out)

    want = sorted((i, min((d(p, line), k) for k, line in lines)[1]) for i, p in points if min(d(p, line) for _, line in lines) < 10)
    assert got == want and len(got) > 100


@pytest.mark.parametrize("name, most", [("building_profile", 6), ("overlap_iou", 2)])
def test_derived_columns_are_evaluated_once(spark, sf_dir, name, most):
    df = registry.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("hypot") <= most and len(plan) < 60_000


def test_text_hash_of_any_text(spark):
    def plain(text):
        n = 0
        for c in text:
            code = ord(c) if ord(c) < 0x10000 else 0xD800 + ((ord(c) - 0x10000) >> 10)
            n = (n * 31 + code + 2**31) % 2**32 - 2**31
        return n

    texts = ["way/588791993", "é", "日本", "a🙂b", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(jsem.text_hash("t")).collect()
    assert [r[0] for r in got] == [plain(t) for t in texts] and plain(texts[0]) == 1638571065


def test_half_planes_and_open_rings(spark):
    ring = "array<struct<x:double,z:double>>"
    df = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 6.0), (0.0, 6.0), (0.0, 0.0)],)], f"r {ring}").select(geom.open_ring(F.col("r")).alias("r"))
    side = lambda k, mid: geom.area(geom.half_plane(F.col("r"), F.lit(1.0), F.lit(0.0), F.lit(mid), k))
    assert tuple(df.select(F.size("r"), side(-1, 4.0), side(1, 4.0), side(-1, 20.0), side(1, 20.0)).first()) == (4, 24.0, 36.0, 60.0, 0.0)


def test_element_queries(spark, sf_dir):
    assert "relation[building](b);" in elements.query_text("b") and "way[barrier=hedge](b);" in elements.query_text("b") and elements.query_text("b").endswith(">;out skel qt;")
    only = elements.query_text("b", ("way",))
    assert "node[" not in only and "way[highway](b);" in only and ">;" not in only
    reader = elements.ElementsReader({"endpoints": f"down:,{sf_dir}", "box": "b", "transport": "parcelwise.plans.feeds:elements"})
    rest = list(reader.pushFilters([elements.EqualTo(("kind",), "node"), elements.EqualTo(("id",), 4)]))
    assert [f.attribute for f in rest] == [("id",)] and reader.kinds == ("node",)
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"node"}
    bad = elements.ElementsReader({"endpoints": "down:", "transport": "parcelwise.plans.feeds:elements"})
    with pytest.raises(RuntimeError):
        list(bad.read(bad.partitions()[0]))


def test_boundaries(spark):
    feature = lambda code, kind: json.dumps({"type": "Feature", "id": "b", "properties": {"code": code}, "geometry": {"type": kind, "coordinates": []}})
    df = lambda *a: geojson.parse(spark.createDataFrame([(feature(*a),)], "value string"))
    assert geojson.boundary(df("10220", "Polygon"), "10220").count() == 1
    assert geojson.boundary(df("10220", "MultiPolygon"), "10220").first().kind == "MultiPolygon"
    for wrong in (("1", "Polygon"), (None, "Polygon"), ("10220", "Point")):
        with pytest.raises(PySparkException):
            geojson.boundary(df(*wrong), "10220").collect()


def test_rings_of_many_ways():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    ways = [[square[0], square[1]], [square[2], square[1]], [square[2], square[3]], [square[0], square[3]], [(9.0, 9.0), (9.5, 9.0), (9.0, 9.5), (9.0, 9.0)]]
    rings, whole = osm._stitched(ways)
    assert whole and [len(r) for r in rings] == [5, 4] and osm._holds(rings[0], (1.0, 1.0)) and not osm._holds(rings[0], (5.0, 1.0))
    assert osm._stitched(ways[:3])[1] is False


def test_blocked_places(spark):
    points = spark.createDataFrame([(1, (1.0, 1.0)), (2, (30.0, 4.0)), (3, (30.0, 9.0)), (4, (200.0, 0.0))], f"id int, p {POINT}")
    shapes = spark.createDataFrame([([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]],)], "poly array<array<struct<x:double,z:double>>>")
    lines = spark.createDataFrame([([(10.0, 0.0), (190.0, 0.0)], 3.0)], "line array<struct<x:double,z:double>>, width double")
    assert sorted(r.id for r in landuse.unblocked(points, shapes, lines).collect()) == [3, 4]


def test_labels_fit_in_their_order(spark):
    rng = random.Random(5)
    rows = [(v, i, i, "n" * rng.randint(1, 30), rng.random() < 0.2, False, 0.0, rng.uniform(0, 900), rng.uniform(100, 500)) for v in range(2) for i in range(120)]
    got = {(r.view_id, r.id): r.visible for r in labels.fitting(spark.createDataFrame(rows, "view_id long, id long, ord long, name string, major boolean, local boolean, distance double, x double, y double"), 900.0, 600.0).collect()}
    for v in range(2):
        placed = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (not r[4], r[2])):
            w, fits = len(r[3]) * 7 + 20, 20 < r[7] < 880 and 135 < r[8] < 520
            free = fits and not any(abs(r[7] - x) < (w + u) / 2 and abs(r[8] - y) < 30 for x, y, u in placed)
            placed += [(r[7], r[8], w)] if free else []
            assert got[v, r[1]] == free
