"""Derived attributes of buildings, each with the source of its value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem

# Lookup tables of the rules.
USAGE_KIND = {"Résidentiel": "house", "Annexe": "annex", "Agricole": "agricultural", "Industriel": "industrial", "Commercial et services": "commercial", "Religieux": "church", "Sportif": "public"}
TAG_KIND = {
    "church": "church", "garage": "garage", "garages": "garage", "shed": "annex", "barn": "agricultural", "farm_auxiliary": "agricultural", "farm": "farm",
    "industrial": "industrial", "warehouse": "industrial", "retail": "commercial", "commercial": "commercial", "school": "public", "public": "public", "greenhouse": "greenhouse",
}
ROOF_TAG = {"roof_tiles": "tile", "tiles": "tile", "slate": "slate", "metal": "metal", "concrete": "concrete"}
ROOF_COLOUR = {"tile": "#b8724e", "slate": "#647789", "metal": "#929e9c", "concrete": "#c5bcaa"}
WALL_COLOUR = {"1": "#d5cdb7", "2": "#c4baa5", "3": "#c3c1b7", "4": "#b98c74", "5": "#d5d0c2", "6": "#b1a085"}
KIND_HEIGHT = {"annex": 2.5, "garage": 2.5, "agricultural": 4.5, "industrial": 6.0, "commercial": 5.5, "large": 5.5, "greenhouse": 2.3, "silo": 9.0, "church": 8.3, "public": 5.3}
PUBLIC_AMENITY = ("school", "townhall", "community_centre", "fire_station")
BULK = ("industrial", "agricultural", "commercial", "large")
NO_USAGE = "Indifférencié"
STOREY = 2.65
# Limits of roofs and walls, in metres or shares of the span.
ROOF_HIGHEST, SPAN_LEAST, SPAN_SHARE, STOREY_LEAST = 9.0, 1.2, {"bulk": 0.5, "other": 0.85}, 3.2
RISE = {"bulk": 0.12, "small": 0.25, "other": 0.34}
ROOF_LEAST, ROOF_MOST = 0.65, {"bulk": 3.0, "other": 3.8}
WALL_LEAST, USUAL_HEIGHT = {"tag": 0.5, "floors": 2.5}, 4.4


def plausible_roof(height: Column, span: Column, n_floors: Column, wall: Column, bulk: Column) -> Column:
    """A roof's height within the bounds that width, floors and wall set; null or 0 floors and wall set none."""
    wide = F.greatest(F.lit(SPAN_LEAST), span * F.when(bulk, SPAN_SHARE["bulk"]).otherwise(SPAN_SHARE["other"]))
    storeys = F.when(n_floors > 0, F.greatest(F.lit(STOREY_LEAST), n_floors * STOREY + 1))
    walls = F.when(wall > 0, F.greatest(F.lit(STOREY_LEAST), wall + 1))
    return F.least(height, F.lit(ROOF_HIGHEST), wide, storeys, walls)


def building_kind(tags: Column, usage: Column, nature: Column, has_landmark: Column, size: Column) -> Column:
    """Tag, else usage, else size; then what overrides them, the last first."""
    basic = F.coalesce(jsem.lookup(tags["building"], TAG_KIND), jsem.lookup(usage, USAGE_KIND), F.when(size < 45, "annex").when(size > 900, "large").otherwise("house"))
    canopy = (tags["wall"] == "no") | tags["building"].isin("roof", "carport")
    public = has_landmark | tags["amenity"].isin(*PUBLIC_AMENITY)
    return F.when(canopy, "canopy").when(public, "public").when(nature == "Serre", "greenhouse").when(nature == "Silo", "silo").otherwise(basic)


def building_profiles(df: DataFrame) -> DataFrame:
    """Profiles of df(id, tags map, ring, wall_height, roof_height, floors, roof_materials, wall_code, usage, nature,
    has_landmark); buildings without an axis go."""
    tag = lambda k: F.col("tags")[k]
    # Each step's columns are evaluated once; the next ones use them by name.
    out = geom.once(
        df, size=geom.area(F.col("ring")), axis=geom.roof_axis(F.col("ring")), bearing=jsem.parse_float(tag("roof:direction")), tag_floors=jsem.positive(tag("building:levels")), tag_roof=jsem.positive(tag("roof:height")),
        tag_height=jsem.positive(tag("height")), shape_tag=jsem.text_or_null(tag("roof:shape")), own_roof=F.nullif(F.col("roof_height"), F.lit(0.0)), own_wall=F.nullif(F.col("wall_height"), F.lit(0.0)),
        mats=F.coalesce("roof_materials", F.array().cast("array<string>")),
    ).where("axis is not null")
    one = F.size("mats") == 1
    angle = F.col("bearing") * (math.pi / 180)
    turned = geom.once(out, turned=F.transform("ring", lambda p: p["x"] * F.sin(angle) - p["z"] * F.cos(angle)))
    out = geom.once(
        turned, kind=building_kind(F.col("tags"), F.col("usage"), F.col("nature"), F.coalesce("has_landmark", F.lit(False)), F.col("size")),
        span=F.when(F.col("bearing").isNotNull(), F.array_max("turned") - F.array_min("turned")).otherwise(F.col("axis.max") - F.col("axis.min")),
        n_floors=F.coalesce("tag_floors", F.nullif(F.col("floors"), F.lit(0)).cast("double")),
    )
    flat = F.coalesce(F.col("shape_tag") == "flat", F.lit(False)) | (F.col("kind") == "canopy") | (F.col("shape_tag").isNull() & one & (F.col("mats")[0] == "concrete") & F.col("own_roof").isNull())
    out = geom.once(out, bulk=F.col("kind").isin(*BULK), roof_shape=F.when(flat, "flat").otherwise("gabled"))
    material = F.coalesce(jsem.lookup(tag("roof:material"), ROOF_TAG), F.when(one, F.col("mats")[0]), F.when(F.col("bulk"), "metal").when(F.col("kind") == "church", "slate").otherwise("tile"))
    share = F.when(F.col("bulk"), RISE["bulk"]).when(F.col("kind").isin("annex", "garage"), RISE["small"]).otherwise(RISE["other"])
    guess = F.least(F.when(F.col("bulk"), ROOF_MOST["bulk"]).otherwise(ROOF_MOST["other"]), F.greatest(F.lit(ROOF_LEAST), F.col("span") * share))
    out = geom.once(out, roof_material=material, source_roof=F.when(F.col("roof_shape") == "flat", 0.0).otherwise(F.coalesce("tag_roof", "own_roof", guess)))
    limited = plausible_roof(F.col("source_roof"), F.col("span"), F.col("n_floors"), F.col("own_wall"), F.col("bulk"))
    out = geom.once(out, roof=F.when(F.col("tag_roof").isNull() & F.col("own_roof").isNotNull(), limited).otherwise(F.col("source_roof")))
    by_floors = F.greatest(F.lit(WALL_LEAST["floors"]), F.col("n_floors") * STOREY)
    known = F.coalesce(F.greatest(F.lit(WALL_LEAST["tag"]), F.col("tag_height") - F.col("roof")) * F.when(F.col("tag_height").isNotNull(), 1.0), F.col("own_wall"))
    wall = F.coalesce(known, by_floors * F.when(F.col("n_floors").isNotNull(), 1.0), jsem.lookup("kind", KIND_HEIGHT), F.lit(USUAL_HEIGHT))
    source = F.when(F.col("tag_height").isNotNull(), "OSM").when(F.col("own_wall").isNotNull(), "IGN BD TOPO").when(F.col("n_floors").isNotNull(), "estimated from floors").otherwise("estimated")
    codes = F.array_distinct(F.filter(F.split(F.regexp_replace(F.coalesce("wall_code", F.lit("")), "[09]", ""), ""), lambda c: c != ""))
    out = geom.once(out, wall=wall, wall_source=source, codes=codes)
    windows = F.least(F.lit(6.0), F.greatest(F.lit(1), F.floor((F.col("wall") - 0.2) / 2.2)), F.coalesce("n_floors", F.greatest(F.lit(1), F.floor(F.col("wall") / STOREY))))
    colour = F.coalesce(F.when(F.size("codes") == 1, jsem.lookup(F.col("codes")[0], WALL_COLOUR)), F.when(F.col("bulk"), "#c7c8bd").when(F.col("kind") == "public", "#eadcc0").otherwise("#eadcc5"))
    return out.select(
        "id", "kind", "bulk", "size", F.col("wall").alias("wall_height"), F.col("roof").alias("roof_height"), F.col("source_roof").alias("source_roof_height"), (F.col("roof") < F.col("source_roof") - 0.001).alias("roof_clamped"),
        "roof_shape", "roof_material", F.coalesce(jsem.lookup("roof_material", ROOF_COLOUR), F.lit(ROOF_COLOUR["tile"])).alias("roof_colour"), colour.alias("wall_colour"), windows.alias("window_floors"),
        (F.coalesce(jsem.lookup(tag("building"), TAG_KIND).isNotNull(), F.lit(False)) | F.coalesce(jsem.text_or_null("usage") != NO_USAGE, F.lit(False))).alias("known_usage"),
        F.col("wall_source").alias("height_source"),
        F.when(F.col("tag_roof").isNotNull(), "OSM").when(F.col("own_roof").isNotNull() & (F.col("roof_shape") != "flat"), "IGN statistical roof maximum").otherwise("estimated").alias("roof_height_source"),
        F.when(F.col("bearing").isNotNull(), "OSM").otherwise("inferred from footprint").alias("roof_direction_source"),
        F.when(jsem.text_or_null(tag("roof:material")).isNotNull(), "OSM").when(one, "IGN cadastral declaration").otherwise("estimated").alias("material_source"),
        shade("id").alias("shade"), F.col("span"),
    )


def shade(id_: str) -> Column:
    """A small tint, from -0.04 to 0.04, that an id's hash sets."""
    return (F.pmod(jsem.unsigned(jsem.text_hash(id_)), F.lit(9)) - 4) / 100
