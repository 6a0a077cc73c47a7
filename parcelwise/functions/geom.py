"""Plane geometry as column functions over nested arrays.

A point is struct<x, z> in metres (x east, z south), a ring array<struct<x, z>> (open or closed), a polygon an array of
rings: the shell, then holes. Everything is built of higher-order functions, so it stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6371008.8
METRES = RADIUS * math.pi / 180
RING = "array<struct<x:double,z:double>>"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, however often later ones use them: the optimiser inlines projections,
    but not a generator."""
    out = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return out.withColumns({n: F.col("_once")[n] for n in columns}).drop("_once")


def point(x: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))


def project(lon: Column, lat: Column, origin: tuple[float, float]) -> Column:
    """Local equirectangular metres from longitude and latitude."""
    return point((lon - origin[0]) * METRES * math.cos(math.radians(origin[1])), -(lat - origin[1]) * METRES)


def project_ring(ring: Column, origin: tuple[float, float]) -> Column:
    """array<[lon, lat]> to a ring."""
    return F.transform(ring, lambda p: project(p[0], p[1], origin))


def rectangle(x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    return F.array(point(x0, z0), point(x1, z0), point(x1, z1), point(x0, z1), point(x0, z0))


def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    """array<struct<a, b>>: each point with the next; the last with the first."""
    return F.zip_with(ring, _next(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def path_edges(line: Column) -> Column:
    """Each point with the next, without the way back."""
    return F.slice(edges(line), 1, F.greatest(F.size(line) - 1, F.lit(0)))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _total(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["z"] - e["b"]["x"] * e["a"]["z"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_area(poly: Column) -> Column:
    """The shell's area less its holes'."""
    return area(poly[0]) - _total(F.transform(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), area))


def bounds(ring: Column) -> Column:
    xs, zs = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["z"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_max(xs).alias("maxx"), F.array_min(zs).alias("minz"), F.array_max(zs).alias("maxz"))


def centre(ring: Column) -> Column:
    b = bounds(ring)
    return point((b["minx"] + b["maxx"]) / 2, (b["minz"] + b["maxz"]) / 2)


def within(p: Column, extent: Column) -> Column:
    """Whether a point lies in an extent, edges included."""
    return p["x"].between(extent["minx"], extent["maxx"]) & p["z"].between(extent["minz"], extent["maxz"])


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes touch or overlap."""
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["minz"] <= b["maxz"]) & (a["maxz"] >= b["minz"])


def inside(p: Column, ring: Column) -> Column:
    """Even-odd containment; an edge counts if it spans the point's z half-open and lies strictly to the right."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        x = F.try_divide((b["x"] - a["x"]) * (p["z"] - a["z"]), b["z"] - a["z"]) + a["x"]
        return ((a["z"] > p["z"]) != (b["z"] > p["z"])) & (p["x"] < x)

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def inside_polygon(p: Column, poly: Column) -> Column:
    """In the shell and in no hole."""
    holes = F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0)))
    return inside(p, poly[0]) & ~F.exists(holes, lambda h: inside(p, h))


def distance(a: Column, b: Column) -> Column:
    dx, dz = a["x"] - b["x"], a["z"] - b["z"]
    return F.sqrt(dx * dx + dz * dz)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """From a point to a segment; a segment of no length is a point."""
    dx, dz = b["x"] - a["x"], b["z"] - a["z"]
    t = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["z"] - a["z"]) * dz, dx * dx + dz * dz), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(p, point(a["x"] + t * dx, a["z"] + t * dz))


def line_distance(p: Column, line: Column) -> Column:
    return F.array_min(F.transform(path_edges(line), lambda e: segment_distance(p, e["a"], e["b"])))


def clip_convex(ring: Column, sides: Column, slack: float = 0.0) -> Column:
    """Cuts a ring with half-planes array<struct<a, b>>, keeping what lies left of each a -> b (Sutherland-Hodgman).
    The rings between passes are an aggregate's state, so the expression doesn't grow with the number of sides."""

    def cut(own: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]
        value = lambda p: (b["x"] - a["x"]) * (p["z"] - a["z"]) - (b["z"] - a["z"]) * (p["x"] - a["x"])
        valued = F.transform(own, lambda p: F.struct(p.alias("p"), value(p).alias("v")))

        def piece(e: Column) -> Column:
            p, q, va, vb = e["a"]["p"], e["b"]["p"], e["a"]["v"], e["b"]["v"]
            t = va / (va - vb)
            mid = F.array(point(p["x"] + t * (q["x"] - p["x"]), p["z"] + t * (q["z"] - p["z"])))
            none = F.array().cast(RING)
            crossed = F.when(va != vb, mid).otherwise(none)
            return F.when(va >= -slack, F.when(vb >= -slack, F.array(p)).otherwise(F.concat(F.array(p), crossed))).otherwise(F.when(vb >= -slack, crossed).otherwise(none))

        return F.flatten(F.transform(edges(valued), piece))

    return F.aggregate(sides, ring.cast(RING), cut)


def open_ring(ring: Column) -> Column:
    """The ring without a last point that repeats the first."""
    return F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def half_plane(ring: Column, ux: Column, uz: Column, mid: Column, side: int, slack: float = 1e-5) -> Column:
    """The part of an open ring on one side (1 or -1) of the line ux * x + uz * z = mid."""
    valued = F.transform(ring, lambda p: F.struct(p.alias("p"), (p["x"] * ux + p["z"] * uz - mid).alias("v")))

    def piece(e: Column) -> Column:
        p, q, va, vb = e["a"]["p"], e["b"]["p"], e["a"]["v"], e["b"]["v"]
        t, none = va / (va - vb), F.array().cast(RING)
        mid_point = F.array(point(p["x"] + t * (q["x"] - p["x"]), p["z"] + t * (q["z"] - p["z"])))
        return F.concat(F.when(va * side >= -slack, F.array(p)).otherwise(none), F.when(va * vb < 0, mid_point).otherwise(none))

    return F.flatten(F.transform(edges(valued), piece))


def _wholly_in(points: Column, extent: Column) -> Column:
    """Whether all points lie in an extent, edges included; null or false where one has no coordinates."""
    return F.coalesce(F.forall(points, lambda p: within(p, extent)), F.lit(False))


def _beyond(points: Column, extent: Column) -> Column:
    """Whether all points lie beyond the same side of an extent."""
    tests = (lambda p: p["x"] < extent["minx"], lambda p: p["x"] > extent["maxx"], lambda p: p["z"] < extent["minz"], lambda p: p["z"] > extent["maxz"])
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(F.forall(points, test), F.lit(False))
    return out


def clip_ring(ring: Column, extent: Column) -> Column:
    """Cuts a ring to a box, edges included; may leave fewer than three points. Rings wholly inside come back as they are,
    those wholly beyond one side have no points left; only the others are cut."""
    e = extent
    cut = clip_convex(ring, edges(F.slice(rectangle(e["minx"], e["minz"], e["maxx"], e["maxz"]), 1, 4)))
    return F.when(_wholly_in(ring, e), ring.cast(RING)).when(_beyond(ring, e), F.array().cast(RING)).otherwise(cut)


def clip_line(line: Column, extent: Column) -> Column:
    """The pieces of a line inside a box (Liang-Barsky per segment); pieces that meet within a centimetre are joined. Lines
    wholly inside come back as they are, those wholly beyond one side have no pieces; only the others are cut."""

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dz = b["x"] - a["x"], b["z"] - a["z"]
        tests = [(-dx, a["x"] - extent["minx"]), (dx, extent["maxx"] - a["x"]), (-dz, a["z"] - extent["minz"]), (dz, extent["maxz"] - a["z"])]
        lo = F.greatest(F.lit(0.0), *[F.when(p < 0, F.try_divide(q, p)) for p, q in tests])
        hi = F.least(F.lit(1.0), *[F.when(p > 0, F.try_divide(q, p)) for p, q in tests])
        out = F.lit(False)
        for p, q in tests:
            out = out | ((p == 0) & (q < 0))
        at = lambda t: point(a["x"] + t * dx, a["z"] + t * dz)
        return F.when(~out & (lo <= hi), F.array(at(lo), at(hi)))

    def join(done: Column, seg: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        meets = F.coalesce(distance(F.element_at(last, -1), seg[0]) < 0.01, F.lit(False))
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.slice(seg, 2, 1))))
        return F.when(meets, longer).otherwise(F.concat(done, F.array(seg)))

    pieces, none = F.filter(F.transform(path_edges(line), cut), lambda s: s.isNotNull()), F.array().cast(f"array<{RING}>")
    whole = (F.size(line) > 1) & _wholly_in(line, extent)
    return F.when(whole, F.array(line.cast(RING))).when(_beyond(line, extent), none).otherwise(F.aggregate(pieces, none, join))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trapezoids(poly: Column) -> Column:
    """A polygon, less its holes, as trapezoids that overlap nowhere: array<struct<z0, z1, l0, l1, r0, r1, minx, maxx>>,
    each between two heights z, from x = l to x = r at both. A sweep over the heights of the vertices: between two that
    follow each other, edges keep their order, and the polygon lies between the first and the second, the third and the
    fourth, and so on. Rings may be open or closed and turn either way, but edges mustn't cross each other. Null or
    flat polygons have none. Takes vertices times heights steps."""
    rising = lambda e: e["a"]["z"] < e["b"]["z"]
    low, high = (lambda e: F.when(rising(e), e["a"]).otherwise(e["b"])), (lambda e: F.when(rising(e), e["b"]).otherwise(e["a"]))
    sides = F.filter(F.flatten(F.transform(poly, edges)), lambda e: e["a"]["z"] != e["b"]["z"])
    sides = F.transform(sides, lambda e: F.struct(low(e).alias("a"), high(e).alias("b")))

    def at(e: Column, z: Column) -> Column:
        return F.when(z == e["b"]["z"], e["b"]["x"]).otherwise(e["a"]["x"] + (z - e["a"]["z"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["z"] - e["a"]["z"]))

    def slab(own: Column, z0: Column, z1: Column) -> Column:
        through = F.transform(F.filter(own, lambda e: (e["a"]["z"] <= z0) & (e["b"]["z"] >= z1)), lambda e: F.struct(at(e, z0).alias("u"), at(e, z1).alias("v")))
        order = F.sort_array(F.transform(through, lambda c: F.struct((c["u"] + c["v"]).alias("m"), c["u"].alias("u"), c["v"].alias("v"))))

        def piece(left: Column, right: Column) -> Column:
            return F.struct(
                z0.alias("z0"), z1.alias("z1"), left["u"].alias("l0"), left["v"].alias("l1"), right["u"].alias("r0"), right["v"].alias("r1"),
                F.least(left["u"], left["v"]).alias("minx"), F.greatest(right["u"], right["v"]).alias("maxx"),
            )

        pairs = lambda c: F.transform(c, lambda left, j: F.when((j % 2 == 0) & (j + 1 < F.size(c)), piece(left, F.get(c, j + 1))))
        return F.array_compact(_let(order, pairs))

    def sweep(own: Column) -> Column:
        heights = F.sort_array(F.array_distinct(F.flatten(F.transform(own, lambda e: F.array(e["a"]["z"], e["b"]["z"])))))
        slabs = lambda zs: F.transform(F.slice(zs, 1, F.greatest(F.size(zs) - 1, F.lit(0))), lambda z, i: slab(own, z, F.get(zs, i + 1)))
        return F.flatten(_let(heights, slabs))

    return _let(sides, sweep)


def triangles(poly: Column) -> Column:
    """A polygon, less its holes, as triangles that overlap nowhere: array of rings of three points. Those of the
    trapezoids, cut along a diagonal; without those of no area."""

    def cut(t: Column) -> Column:
        a, b, c, d = point(t["l0"], t["z0"]), point(t["r0"], t["z0"]), point(t["r1"], t["z1"]), point(t["l1"], t["z1"])
        first, second = F.when(t["l0"] != t["r0"], F.array(a, b, c)), F.when(t["l1"] != t["r1"], F.array(a, c, d))
        return F.array_compact(F.array(first, second))

    return F.flatten(F.transform(trapezoids(poly), cut))


def trapezoid_overlap(t: Column, u: Column) -> Column:
    """The area that two trapezoids have in common, exactly. The width in common is linear in z between the places where
    sides cross, so its value in the middle of each stretch gives the area. Zero if they only touch."""
    z0, z1 = F.greatest(t["z0"], u["z0"]), F.least(t["z1"], u["z1"])
    ends = lambda v, s: [v[f"{s}0"] + (v[f"{s}1"] - v[f"{s}0"]) * ((z - v["z0"]) / (v["z1"] - v["z0"])) for z in (z0, z1)]
    named = {n: end for v, p in ((t, "t"), (u, "u")) for s in "lr" for n, end in zip((f"{p}{s}0", f"{p}{s}1"), ends(v, s), strict=True)}

    def area_of(e: Column) -> Column:
        on = lambda n, f: e[f"{n}0"] + (e[f"{n}1"] - e[f"{n}0"]) * f
        width = lambda f: F.greatest(F.lit(0.0), F.least(on("tr", f), on("ur", f)) - F.greatest(on("tl", f), on("ul", f)))

        def crossing(m: str, n: str) -> Column:
            d0, d1 = e[f"{m}0"] - e[f"{n}0"], e[f"{m}1"] - e[f"{n}1"]
            return F.when(d0 * d1 < 0, d0 / (d0 - d1))

        crossings = F.array_compact(F.array(crossing("tl", "ul"), crossing("tr", "ur"), crossing("tl", "ur"), crossing("ul", "tr")))
        stops = lambda c: F.concat(F.array(F.lit(0.0)), F.sort_array(c), F.array(F.lit(1.0)))
        parts = lambda fs: _total(F.transform(F.slice(fs, 2, F.size(fs) - 1), lambda f, i: (f - F.get(fs, i)) * width((f + F.get(fs, i)) / 2)))
        return e["h"] * _let(crossings, lambda c: F.when(F.size(c) == 0, width(F.lit(0.5))).otherwise(_let(stops(c), parts)))

    return F.when(z1 > z0, _let(F.struct((z1 - z0).alias("h"), *[c.alias(n) for n, c in named.items()]), area_of)).otherwise(F.lit(0.0))


def trapezoids_overlap(a: Column, b: Column) -> Column:
    """The area that two polygons have in common, given their trapezoids: the sum over those that meet. The trapezoids
    should be columns of their own (see once)."""
    near = lambda t: F.filter(b, lambda u: (t["z0"] < u["z1"]) & (t["z1"] > u["z0"]) & (t["minx"] < u["maxx"]) & (t["maxx"] > u["minx"]))
    return _total(F.flatten(F.transform(a, lambda t: F.transform(near(t), lambda u: trapezoid_overlap(t, u)))))


def overlap_area(a: Column, b: Column) -> Column:
    """The area that two polygons have in common."""
    return trapezoids_overlap(trapezoids(a), trapezoids(b))


def roof_axis(ring: Column) -> Column:
    """struct<ux, uz, min, max, area>: the smallest enclosing rectangle over the directions of edges of a metre or
    more (the first of equal ones), the axis along its narrow side. Null without such an edge. Each step's arrays are
    computed once, as the next step's elements."""

    def direction(e: Column, i: Column) -> Column:
        dx, dz = e["b"]["x"] - e["a"]["x"], e["b"]["z"] - e["a"]["z"]
        return F.struct(dx.alias("dx"), dz.alias("dz"), F.hypot(dx, dz).alias("n"), i.alias("i"))

    def spread(d: Column) -> Column:
        along = F.transform(ring, lambda p: p["x"] * d["ux"] + p["z"] * d["uz"])
        across = F.transform(ring, lambda p: p["z"] * d["ux"] - p["x"] * d["uz"])
        return F.struct(d.alias("d"), along.alias("along"), across.alias("across"))

    def box(s: Column) -> Column:
        return F.struct(s["d"].alias("d"), F.array_min(s["along"]).alias("a0"), F.array_max(s["along"]).alias("a1"), F.array_min(s["across"]).alias("c0"), F.array_max(s["across"]).alias("c1"))

    def sized(b: Column) -> Column:
        w, h = b["a1"] - b["a0"], b["c1"] - b["c0"]
        return F.struct((w * h).alias("area"), b["d"]["i"].alias("i"), w.alias("w"), h.alias("h"), b.alias("b"))

    def axis(s: Column) -> Column:
        b, d = s["b"], s["b"]["d"]
        pick = lambda x, y: F.when(s["w"] < s["h"], x).otherwise(y)
        return F.struct(pick(d["ux"], -d["uz"]).alias("ux"), pick(d["uz"], d["ux"]).alias("uz"), pick(b["a0"], b["c0"]).alias("min"), pick(b["a1"], b["c1"]).alias("max"), s["area"].alias("area"))

    long = F.filter(F.transform(path_edges(ring), direction), lambda d: d["n"] >= 1)
    units = F.transform(long, lambda d: F.struct((d["dx"] / d["n"]).alias("ux"), (d["dz"] / d["n"]).alias("uz"), d["i"].alias("i")))
    best = F.array_min(F.transform(F.transform(F.transform(units, spread), box), sized))
    return F.get(F.transform(F.array_compact(F.array(best)), axis), F.lit(0))


def longest_edge_angle(ring: Column) -> Column:
    """The direction of the longest edge, the first of equal ones."""
    got = F.transform(path_edges(ring), lambda e, i: F.struct(F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["z"] - e["a"]["z"]).alias("n"), (-i).alias("i"), F.atan2(e["b"]["z"] - e["a"]["z"], e["b"]["x"] - e["a"]["x"]).alias("angle")))
    return F.array_max(got)["angle"]


def sample_line(line: Column, spacing: float) -> Column:
    """Points at spacing / 2 and every spacing after along a line, across its corners: array<struct<x, z, angle>>."""
    lens = F.transform(path_edges(line), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["z"] - e["a"]["z"]))
    ends = F.aggregate(lens, F.array().cast("array<double>"), lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + v)))
    parts = F.zip_with(path_edges(line), ends, lambda e, t: F.struct(e["a"].alias("a"), e["b"].alias("b"), t.alias("end")))

    def along(p: Column) -> Column:
        dx, dz = p["b"]["x"] - p["a"]["x"], p["b"]["z"] - p["a"]["z"]
        n = F.hypot(dx, dz)
        start = p["end"] - n
        first = F.ceil(F.round((start - spacing / 2) / spacing, 9))
        last = F.floor(F.round((p["end"] - spacing / 2) / spacing, 9))
        first = F.greatest(first, F.lit(0)) + F.when((first >= 0) & (F.round(spacing / 2 + first * spacing - start, 9) <= 0) & (start > 0), 1).otherwise(0)
        at = lambda k: (spacing / 2 + k * spacing - start) / n
        some = F.transform(F.sequence(first, last), lambda k: F.struct((p["a"]["x"] + at(k) * dx).alias("x"), (p["a"]["z"] + at(k) * dz).alias("z"), F.atan2(dx, dz).alias("angle")))
        return F.when((n > 0) & (first <= last), some).otherwise(F.array().cast("array<struct<x:double,z:double,angle:double>>"))

    return F.flatten(F.transform(parts, along))


def halo(p: Column, radius: float = 22.0, sides: int = 32) -> Column:
    """A closed ring around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda k: point(p["x"] + F.cos(k * (2 * math.pi / sides)) * radius, p["z"] + F.sin(k * (2 * math.pi / sides)) * radius))


def strip(line: Column, width: float) -> Column:
    """A polyline as quads: each point moved sideways along the normal of its neighbours' direction."""
    n = F.size(line)

    def shifted(sign: float) -> Column:
        def move(p: Column, i: Column) -> Column:
            a, b = F.get(line, F.greatest(i - 1, F.lit(0))), F.get(line, F.least(i + 1, n - 1))
            dx, dz = b["x"] - a["x"], b["z"] - a["z"]
            m = F.coalesce(F.try_divide(F.lit(sign * width / 2), F.hypot(dx, dz)), F.lit(0.0))
            return point(p["x"] - dz * m, p["z"] + dx * m)

        return F.transform(line, move)

    left, right = shifted(1.0), shifted(-1.0)
    quads = F.zip_with(edges(left), edges(right), lambda u, v: F.array(u["a"], u["b"], v["b"], v["a"]))
    return F.slice(quads, 1, F.greatest(n - 1, F.lit(0)))
