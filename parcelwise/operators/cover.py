"""Quadtree covers: what lies in the plane is covered by a few cells of the level that fits it.

A cell of level k is size * 2 ** k wide. A shape takes the lowest level at which its box is not wider than `fit` cells, so
it has at most (fit + 2) ** 2 cells, a few metres or a thousand kilometres wide, and a coordinate that is wrong makes one
large cell, not billions of small ones. A point is looked up once per level in use: a scalar subquery over the shapes, of
which there are as many as shapes differ in size by powers of two. Boxes without finite ends have no cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geom

#: Cells along a shape's longer side, at most.
FIT = 8
KEY = ["_lev", "_cx", "_cz"]
#: Shapes of that many cells or fewer are not looked at cell by cell.
FEW = 4


def sized(df: DataFrame, box: Column, size: float, fit: int = FIT) -> DataFrame:
    """Adds the box, _box, and its level, _lev."""
    out = geom.once(df, _box=box)
    extent = F.greatest(F.col("_box.maxx") - F.col("_box.minx"), F.col("_box.maxz") - F.col("_box.minz"))
    level = F.greatest(F.lit(0), F.ceil(F.coalesce(F.log2(extent / (size * fit)), F.lit(0.0))).cast("int"))
    return out.where(extent < float("inf")).withColumn("_lev", level)


def levels(df: DataFrame) -> Column:
    """The levels in use, as an array: one row, computed where the plan runs."""
    return df.agg(F.collect_set("_lev")).scalar()


def step(size: float) -> Column:
    """How wide cells of the row's level are."""
    return F.lit(size) * F.pow(F.lit(2.0), F.col("_lev"))


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / step(size))


def cells(df: DataFrame, size: float) -> DataFrame:
    """A row per cell of the row's level that its _box touches: _cx, _cz; the box's first cell is _fx, _fz."""
    out = df.withColumn("_fx", _cell(F.col("_box.minx"), size)).withColumn("_fz", _cell(F.col("_box.minz"), size))
    out = out.withColumn("_cx", F.explode(F.sequence("_fx", _cell(F.col("_box.maxx"), size))))
    return out.withColumn("_cz", F.explode(F.sequence("_fz", _cell(F.col("_box.maxz"), size))))


def look_up(points: DataFrame, p: str, used: Column, size: float) -> DataFrame:
    """A row of each point and level in use, with its cell; points without finite coordinates are nowhere."""
    out = points.where((F.abs(F.col(p)["x"]) < float("inf")) & (F.abs(F.col(p)["z"]) < float("inf"))).withColumn("_levels", used).withColumn("_lev", F.explode("_levels")).drop("_levels")
    return out.withColumn("_cx", _cell(F.col(p)["x"], size)).withColumn("_cz", _cell(F.col(p)["z"], size))


def _square(size: float) -> tuple[Column, Column, Column]:
    """A cell's centre and half its width, a little more for rounding."""
    x, z = (F.col("_cx") + 0.5) * step(size), (F.col("_cz") + 0.5) * step(size)
    return x, z, step(size) * (0.5 + 1e-9) + (F.abs(x) + F.abs(z)) * 1e-12


def _many(size: float) -> Column:
    across = lambda k: _cell(F.col(f"_box.max{k}"), size) - _cell(F.col(f"_box.min{k}"), size) + 1
    return across("x") * across("z") > FEW


def polygon_cells(df: DataFrame, poly: str, size: float) -> DataFrame:
    """cells() without those outside the polygon; _whole tells of those wholly inside it, where no point needs a test."""
    x, z, half = _square(size)
    out = geom.once(cells(df, size), _x=x, _z=z, _half=half)

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dz = b["x"] - a["x"], b["z"] - a["z"]
        off = F.abs(dx * (F.col("_z") - a["z"]) - dz * (F.col("_x") - a["x"]))
        side = F.isnan(off) | (off <= (F.abs(dx) + F.abs(dz)) * F.col("_half") * (1 + 1e-9))  # beyond double precision: perhaps
        near = lambda k: (F.least(a[k], b[k]) <= F.col(f"_{k}") + F.col("_half")) & (F.greatest(a[k], b[k]) >= F.col(f"_{k}") - F.col("_half"))
        return near("x") & near("z") & side

    edge = F.when(_many(size), F.exists(F.col(poly), lambda ring: F.exists(geom.edges(ring), touches))).otherwise(True)
    out = geom.once(out, _edge=F.coalesce(edge, F.lit(True)))
    middle = geom.inside_polygon(geom.point(F.col("_x"), F.col("_z")), F.col(poly))
    return out.where(F.col("_edge") | middle).withColumn("_whole", ~F.col("_edge")).drop("_x", "_z", "_half", "_edge", "_box", "_fx", "_fz")


def segment_cells(df: DataFrame, a: Column, b: Column, reach: Column, size: float) -> DataFrame:
    """cells() without those that lie farther than reach from the segment."""
    x, z, half = _square(size)
    far = geom.segment_distance(geom.point(x, z), a, b) > reach + half * 1.4143
    return cells(df, size).where(~F.coalesce(_many(size) & far, F.lit(False))).drop("_box", "_fx", "_fz")
