"""Matching footprints across sources, and the attributes that a match brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem
from parcelwise.operators import spatial

COVERAGE, IOU, MARGIN = 0.65, 0.5, 0.15

# Roof material by its code.
ROOF_CODES = {"1": "tile", "2": "slate", "3": "metal", "4": "concrete"}


def scored(a: DataFrame, b: DataFrame, overlap: Column) -> DataFrame:
    """Pairs of a(a_id, a_box, a_area, ...) and b(b_id, b_box, b_area, ...) with overlap, coverage and iou; overlap:
    a column over both."""
    pairs = geom.once(spatial.grid_join(a, b, "a_box", "b_box"), overlap=overlap)
    return pairs.withColumn("coverage", F.col("overlap") / F.col("a_area")).withColumn("iou", F.col("overlap") / (F.col("a_area") + F.col("b_area") - F.col("overlap")))


def scored_polygons(a: DataFrame, b: DataFrame) -> DataFrame:
    """scored() of polygons a_poly and b_poly: each footprint is cut into trapezoids once, before it meets its candidates."""
    a, b = geom.once(a, a_parts=geom.trapezoids(F.col("a_poly"))), geom.once(b, b_parts=geom.trapezoids(F.col("b_poly")))
    return scored(a, b, geom.trapezoids_overlap(F.col("a_parts"), F.col("b_parts"))).drop("a_parts", "b_parts")


def best_matches(a: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a_id, status, b_id, iou, coverage, runner_up) per row of a: unmatched without a good enough best candidate, else
    ambiguous if the second comes too near, else matched."""
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("iou"), "b_id"))
    top = pairs.select("a_id", "b_id", "iou", "coverage").withColumn("rn", rank).where("rn <= 2")
    one = F.col("rn") == 1
    best = top.groupBy("a_id").agg(F.max(F.when(one, F.col("b_id"))).alias("b_id"), F.max(F.when(one, F.col("iou"))).alias("iou"), F.max(F.when(one, F.col("coverage"))).alias("coverage"), F.coalesce(F.max(F.when(~one, F.col("iou"))), F.lit(0.0)).alias("runner_up"))
    out = a.select("a_id").join(best, "a_id", "left")
    poor = F.col("b_id").isNull() | (F.col("coverage") < COVERAGE) | (F.col("iou") < IOU)
    status = F.when(poor, "unmatched").when(F.col("iou") - F.col("runner_up") < MARGIN, "ambiguous").otherwise("matched")
    return out.select("a_id", status.alias("status"), F.when(status == "matched", F.col("b_id")).alias("b_id"), F.coalesce("iou", F.lit(0.0)).alias("iou"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"))


def rectangle_overlap(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("minx", "maxx") * side("minz", "maxz")


def in_service(df: DataFrame) -> DataFrame:
    """Footprints (state, polys) in service that have an area, with it: the sum of their polygons', less their holes'."""
    area = F.aggregate(F.transform("polys", geom.polygon_area), F.lit(0.0), lambda n, v: n + v)
    return geom.once(df.where(F.col("state") == "En service"), area=area).where("area > 0")


def wall_height(height: Column, accuracy: Column) -> Column:
    """The height if it is plausible and accurate enough."""
    acc = F.coalesce(accuracy.cast("string").try_cast("double"), F.lit(0.0))
    good = (height > 0) & (height < 80) & ~F.isnan(height) & ~F.isnan(acc) & (acc > 0) & (acc <= 5)
    return F.when(good, height)


def roof_rise(wall: Column, roof_top: Column, ground: Column, area: Column, light: Column) -> Column:
    """The roof's height from altitudes, in tenths, within plausible bounds on solid buildings of some size."""
    rise = roof_top - ground - wall
    good = rise.between(0.6, 9) & (area >= 25) & ~F.coalesce(light, F.lit(False))
    return F.when(good, jsem.round_to(rise, 1))


def floors(n: Column) -> Column:
    return F.when((n > 0) & (n < 15), n)


def roof_materials(code: Column) -> Column:
    """Distinct materials of a code's known digits, in their order."""
    known = F.array_distinct(F.filter(F.split(F.coalesce(code, F.lit("")), ""), lambda c: c.isin(*ROOF_CODES)))
    return F.transform(known, lambda c: jsem.lookup(c, ROOF_CODES))


def entries(matches: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(id, entry) of matches(id, source_id, iou, coverage, runner_up, *columns): what a match brings, the match itself as
    a struct with rounded figures, like the columns asked for."""
    figure = lambda c: jsem.round_to(F.col(c), 3).alias(c)
    return matches.select("id", F.struct("source_id", F.struct(figure("iou"), figure("coverage"), figure("runner_up")).alias("match"), *columns).alias("entry"))


def annotated(found: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(id, entry, landmark) of found(id, entry) and landmarks(id, ord, ...): the last landmark of an id is added to its
    entry, or makes a row without one."""
    rest = [c for c in landmarks.columns if c not in ("id", "ord")]
    last = landmarks.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("landmark"))
    return found.join(last, "id", "full")


def enriched(df: DataFrame, extra: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows of df with the columns of extra(key, ...), or their defaults where there is no row."""
    out = df.join(extra.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
