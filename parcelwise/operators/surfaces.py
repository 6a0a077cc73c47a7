"""Surfaces of buildings: walls up to the roof's slope, and the roof's two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geom

# Height of the base, least half span of a roof, least and largest footprint.
BASE, HALF_LEAST, AREA_LEAST, AREA_MOST = 0.35, 0.1, 3.0, 100_000.0


def quad_area(q: Column) -> Column:
    """The area of a wall struct<a, b, low, top_a, top_b>."""
    return geom.distance(q["a"], q["b"]) * ((q["top_a"] + q["top_b"]) / 2 - q["low"])


def _walls(ring: Column, axis: Column, mid: Column, half: Column, wall: Column, roof: Column) -> Column:
    """array<struct<a, b, low, top_a, top_b>>: each edge, cut where it crosses the ridge."""
    value = lambda p: p["x"] * axis["ux"] + p["z"] * axis["uz"] - mid
    sides = F.filter(geom.edges(ring), lambda e: geom.distance(e["a"], e["b"]) > 0)
    valued = F.transform(sides, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), value(e["a"]).alias("va"), value(e["b"]).alias("vb")))

    def cut(e: Column) -> Column:
        a, b, va, vb = e["a"], e["b"], e["va"], e["vb"]
        t = va / (va - vb)
        ridge = geom.point(a["x"] + t * (b["x"] - a["x"]), a["z"] + t * (b["z"] - a["z"]))
        piece = lambda p, q, vp, vq: F.struct(p.alias("a"), q.alias("b"), vp.alias("va"), vq.alias("vb"))
        zero = F.lit(0.0)
        return F.when(va * vb < 0, F.array(piece(a, ridge, va, zero), piece(ridge, b, zero, vb))).otherwise(F.array(piece(a, b, va, vb)))

    top = lambda v: F.lit(BASE) + wall + roof * F.greatest(F.lit(0.0), 1 - F.abs(v) / half)
    return F.transform(F.flatten(F.transform(valued, cut)), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.lit(BASE).alias("low"), top(e["va"]).alias("top_a"), top(e["vb"]).alias("top_b")))


def of(shapes: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, walls, left, right, top, slope) of shapes(id, ring) that have a profile and a plausible footprint; a canopy has no
    walls. left and right: the footprint on either side of the ridge; slope: what gives the roof's height over a point."""
    rows = shapes.join(profiles.select("id", "kind", "size", "wall_height", "roof_height"), "id").where(F.col("size").between(AREA_LEAST, AREA_MOST))
    rows = geom.once(rows, axis=geom.roof_axis(F.col("ring")), flat=geom.open_ring(F.col("ring")))
    rows = geom.once(rows, mid=(F.col("axis.min") + F.col("axis.max")) / 2, half=F.greatest(F.lit(HALF_LEAST), (F.col("axis.max") - F.col("axis.min")) / 2))
    walls = _walls(F.col("flat"), F.col("axis"), F.col("mid"), F.col("half"), F.col("wall_height"), F.col("roof_height"))
    side = lambda k: geom.half_plane(F.col("flat"), F.col("axis.ux"), F.col("axis.uz"), F.col("mid"), k)
    rows = geom.once(rows, walls=F.when(F.col("kind") == "canopy", F.slice(walls, 1, 0)).otherwise(walls), left=side(-1), right=side(1))
    slope = F.struct("axis.ux", "axis.uz", "mid", "half", (F.lit(BASE) + F.col("wall_height")).alias("eaves"), F.col("roof_height").alias("rise"))
    return rows.select("id", "walls", "left", "right", (F.lit(BASE) + F.col("wall_height") + F.col("roof_height")).alias("top"), slope.alias("slope"))


def _corner(p: Column, y: Column) -> Column:
    return F.struct(p["x"].alias("x"), y.cast("double").alias("y"), p["z"].alias("z"))


def triangles(built: DataFrame) -> DataFrame:
    """(id, part, a, b, c): the triangles of buildings as of() gives them, a row each; part is wall or roof, corners are
    struct<x, y, z>. A wall is cut along a diagonal, a roof's side into triangles that overlap nowhere and are lifted to
    its slope, on which each side is a plane. Walls without height have none."""

    def wall(q: Column) -> Column:
        a, b, c, d = _corner(q["a"], q["low"]), _corner(q["b"], q["low"]), _corner(q["b"], q["top_b"]), _corner(q["a"], q["top_a"])
        return F.array_compact(F.array(F.when(q["top_b"] > q["low"], F.array(a, b, c)), F.when(q["top_a"] > q["low"], F.array(a, c, d))))

    slope = F.col("slope")

    def lifted(p: Column) -> Column:
        off = F.abs(p["x"] * slope["ux"] + p["z"] * slope["uz"] - slope["mid"])
        return _corner(p, slope["eaves"] + slope["rise"] * F.greatest(F.lit(0.0), 1 - off / slope["half"]))

    named = lambda part, found: F.transform(found, lambda t: F.struct(F.lit(part).alias("part"), t.alias("t")))
    walls = named("wall", F.flatten(F.transform("walls", wall)))
    roof = named("roof", F.transform(F.concat(geom.triangles(F.array("left")), geom.triangles(F.array("right"))), lambda t: F.transform(t, lifted)))
    rows = built.select("id", F.explode(F.concat(walls, roof)).alias("r"))
    return rows.select("id", "r.part", *[F.col("r.t")[i].alias(n) for i, n in enumerate("abc")])


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """The area of a triangle in space."""
    u, v = ({k: p[k] - a[k] for k in "xyz"} for p in (b, c))
    cross = [u[i] * v[j] - u[j] * v[i] for i, j in ("yz", "zx", "xy")]
    return F.sqrt(sum((n * n for n in cross), F.lit(0.0))) / 2
