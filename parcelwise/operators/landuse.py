"""Land use, line furniture and planting rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem
from parcelwise.operators import spatial
from parcelwise.operators.rounds import numbered

# Classes of land.
CLASSES = {
    "wood": ("forest", "wood", "scrub"),
    "field": ("farmland", "orchard", "vineyard"),
    "farmyard": ("farmyard",),
    "garden": ("residential",),
    "built": ("industrial", "commercial", "retail", "railway", "military"),
    "grass": ("grass", "meadow", "grassland", "village_green", "recreation_ground", "park", "garden", "cemetery"),
    "sport": ("pitch", "sports_centre"),
}
DASHED = ("primary", "secondary", "tertiary", "trunk")
VILLAGE = ((0.0, 0.0), (1150.0, -600.0))
MAX_TREES, TREE_CELL = 3200, 7.0


def land_class(tags: Column) -> Column:
    """Water first, then the class of landuse, else natural, else leisure; null for other land."""
    kind = F.coalesce(jsem.text_or_null(tags["landuse"]), jsem.text_or_null(tags["natural"]), jsem.text_or_null(tags["leisure"]))
    water = F.coalesce(tags["natural"] == "water", F.lit(False)) | F.coalesce(tags["waterway"] == "riverbank", F.lit(False)) | F.coalesce(tags["landuse"] == "reservoir", F.lit(False))
    out = F.when(water, "water")
    for name, values in CLASSES.items():
        out = out.when(kind.isin(*values), name)
    return out


def is_parking(tags: Column) -> Column:
    return F.coalesce(tags["amenity"] == "parking", F.lit(False))


def is_sports_landmark(tags: Column) -> Column:
    return jsem.text_or_null(tags["name"]).isNotNull() & F.coalesce(tags["leisure"].isin("sports_centre", "stadium"), F.lit(False))


def scene_road(highway: Column) -> Column:
    """Roads that the scene shows; the catalogue takes all."""
    return jsem.text_or_null(highway).isNotNull() & ~highway.isin("proposed", "construction")


def scene_waterway(waterway: Column) -> Column:
    return jsem.text_or_null(waterway).isNotNull() & ~waterway.isin("dam", "weir")


def scene_width(width: Column) -> Column:
    return F.least(F.lit(20.0), F.greatest(F.lit(1.0), width))


def spacing(tags: Column) -> Column:
    """Metres between what stands along a line: sleepers, road dashes, hedge blocks."""
    return F.when(tags["railway"] == "rail", 2.2).when(tags["highway"].isin(*DASHED), 14.0).when(tags["barrier"] == "hedge", 4.0)


def village_distance(p: Column) -> Column:
    return F.least(*[F.hypot(p["x"] - x, p["z"] - z) for x, z in VILLAGE])


def tree_step(scrub: Column, distance: Column) -> Column:
    return F.when(scrub, 62.0).when(distance < 1100, 42.0).when(distance < 1900, 60.0).otherwise(83.0)


def _draw(k: int) -> Column:
    """A number in [0, 1) that hashes a place of a grid: the same at any layout. ids count as text."""
    text = F.concat_ws(":", F.col("id").cast("string"), F.col("i").cast("string"), F.col("j").cast("string"), F.lit(str(k)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _jittered(shapes: DataFrame, step: Column) -> DataFrame:
    """A row per cell of a grid over the box of each of shapes(id, poly, ...): i, j, a point p of the cell that lies in the
    polygon, and two more draws, u and v."""
    b = geom.bounds(F.col("poly")[0])
    out = geom.once(shapes, b=b, step=step)
    cells = lambda lo, hi: F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil((F.col(f"b.{hi}") - F.col(f"b.{lo}")) / F.col("step"))) - 1)
    out = out.withColumn("i", F.explode(cells("minx", "maxx"))).withColumn("j", F.explode(cells("minz", "maxz")))
    p = geom.point(F.col("b.minx") + (F.col("i") + _draw(0)) * F.col("step"), F.col("b.minz") + (F.col("j") + _draw(1)) * F.col("step"))
    return geom.once(out, p=p, u=_draw(2), v=_draw(3)).where(geom.inside_polygon(F.col("p"), F.col("poly")))


def garden_candidates(shapes: DataFrame, step: float = 38.0) -> DataFrame:
    """(id, ord, i, j, p, height): jittered grid points inside gardens (id, ord, poly), about half of the cells."""
    out = _jittered(shapes, F.lit(step)).where("u > 0.48")
    return out.select("id", "ord", "i", "j", "p", (5 + F.col("v") * 5).alias("height"))


def wood_order(woods: DataFrame) -> DataFrame:
    """Adds distance, of the box's centre from the nearer village, and place: woods(ord, poly, added, ...) in the order of
    distance; of equal ones the added source's come first, the last of them in front."""
    out = geom.once(woods, distance=village_distance(geom.centre(F.col("poly")[0])))
    front = F.coalesce("added", F.lit(False))
    out = out.withColumns({"_late": ~front, "_turn": F.when(front, -F.col("ord")).otherwise(F.col("ord"))})
    return numbered(out, [], ["distance", "_late", "_turn"], "place").drop("_late", "_turn")


def wood_candidates(woods: DataFrame) -> DataFrame:
    """(id, place, i, j, p, height): jittered grid points inside woods(id, place, distance, scrub, poplar, poly), sparser
    farther away."""
    scrub, poplar = (F.coalesce(c, F.lit(False)) for c in ("scrub", "poplar"))
    out = _jittered(woods, tree_step(scrub, F.col("distance")))
    height = F.when(scrub, 4 + F.col("v") * 4).when(poplar, 13 + F.col("v") * 5).otherwise(9 + F.col("v") * 7)
    return out.select("id", "place", "i", "j", "p", height.alias("height"))


def unblocked(points: DataFrame, shapes: DataFrame, lines: DataFrame, margin: float = 9.0, size: float = 80.0) -> DataFrame:
    """The points(p, ...) that stand in none of shapes(poly) and not within (width + margin) / 2 of any of lines(line,
    width). Exact, where a drawn mask would be as coarse as its pixels."""
    places = points.select("p").distinct()
    held = spatial.contained(places, shapes.select("poly"), size=size).select("p")
    near = spatial.near_lines(places, lines.select("line", ((F.col("width") + margin) / 2).alias("reach")), size).select("p")
    blocked = held.unionByName(near).distinct().select(F.col("p").alias("_p"))
    return points.join(blocked, (F.col("p.x") == F.col("_p.x")) & (F.col("p.z") == F.col("_p.z")), "left_anti")


def planted(candidates: DataFrame, limit: int = MAX_TREES) -> DataFrame:
    """Trees of candidates(ord, real, p, ...): the first of each cell of 7 m, real ones first and all of them, others up to
    the limit."""
    cell = lambda k: jsem.round_half_up(F.col("p")[k] / TREE_CELL)
    first = candidates.withColumn("ci", cell("x")).withColumn("cj", cell("z")).groupBy("ci", "cj").agg(F.min_by(F.struct(*candidates.columns), F.struct(~F.col("real"), "ord")).alias("t")).select("t.*")
    made = first.where("not real").orderBy("ord").limit(limit)  # the limit is the feature
    have = first.where("real")
    room = have.agg(F.greatest(F.lit(0), F.lit(limit) - F.count("*")).alias("room"))
    ranked = made.withColumn("rn", F.row_number().over(Window.orderBy("ord"))).crossJoin(room).where("rn <= room")  # limit rows at most, one row
    return have.unionByName(ranked.select(*have.columns))
