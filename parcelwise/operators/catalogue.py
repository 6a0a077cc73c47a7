"""The searchable catalogue: records of many sources, the ids that lead to them, and point queries over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem
from parcelwise.operators import spatial
from parcelwise.operators.rounds import cut

# Widths in metres by class, names by amenity.
ROAD_WIDTH = {"trunk": 11.0, "primary": 10.0, "secondary": 8.0, "tertiary": 7.0, "residential": 5.5, "unclassified": 5.5, "service": 3.5, "living_street": 4.0, "track": 2.8, "path": 1.4, "footway": 1.5, "cycleway": 2.0, "steps": 1.5}
WATER_WIDTH = {"river": 13.0, "stream": 4.0, "ditch": 1.5, "canal": 7.0}
AMENITY_NAME = {"townhall": "Mairie", "school": "École primaire", "community_centre": "Salle communale"}


def road_width(width: Column, highway: Column) -> Column:
    """The tagged width, else the class's, else 4; 0 counts as no width."""
    return jsem.number_or(jsem.parse_float(width), F.coalesce(jsem.lookup(highway, ROAD_WIDTH), F.lit(4.0)))


def water_width(width: Column, waterway: Column) -> Column:
    return jsem.number_or(jsem.parse_float(width), F.coalesce(jsem.lookup(waterway, WATER_WIDTH), F.lit(3.0)))


def clipped_roads(roads: DataFrame, extent: Column) -> DataFrame:
    """Roads with the pieces of their paths inside an extent; those without a piece go, named or not."""
    pieces = F.flatten(F.transform("paths", lambda path: geom.clip_line(path, extent)))
    return geom.once(roads, _pieces=pieces).withColumn("paths", F.col("_pieces")).drop("_pieces").where(F.size("paths") > 0)


def unnamed_roads(roads: DataFrame) -> DataFrame:
    """Roads, not rails, without name and number."""
    return roads.where(F.coalesce(jsem.text_or_null(F.trim("name")), jsem.text_or_null("ref")).isNull() & F.col("is_road"))


def road_groups(roads: DataFrame) -> DataFrame:
    """Roads (ord, id, is_road, name, ref, width, paths) with the same title, as one record each: their paths and ids in
    order, the first one's width, and the middle of the path with most points (the last of equal ones)."""
    title = F.coalesce(jsem.text_or_null(F.trim("name")), jsem.text_or_null("ref"))
    named = roads.withColumn("title", title).where("title is not null and size(paths) > 0")
    key = F.concat(F.when(F.col("is_road"), "road:").otherwise("rail:"), "title")
    own = F.transform("paths", lambda path, k: F.struct(F.size(path).alias("size"), k.alias("k"), F.get(path, F.floor(F.size(path) / 2).cast("int")).alias("middle")))
    each = geom.once(named.select(key.alias("key"), "title", "width", "ord", "id", "paths"), n=F.size("paths"), own=F.array_max(own)).drop("paths")
    groups = each.groupBy(F.col("key").alias("id"), "title").agg(
        F.min_by("width", "ord").alias("width"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("source_ids"),
        F.sum("n").alias("n_paths"), F.max_by("own.middle", F.struct("own.size", "ord", "own.k")).alias("position"), F.min("ord").alias("ord"),
    )
    return groups.select("id", F.col("title").alias("name"), "width", "source_ids", "n_paths", "position", "ord")


def id_aliases(records: DataFrame) -> DataFrame:
    """(id, record_id): the ids that lead to records(id, source_ids, ord), its own included; the last one given wins."""
    own = records.select("id", F.col("id").alias("record_id"), "ord")
    other = records.select(F.explode("source_ids").alias("id"), F.col("id").alias("record_id"), "ord")
    return own.unionByName(other).groupBy("id").agg(F.max_by("record_id", "ord").alias("record_id"))


def catalogue_statistics(records: DataFrame, unnamed: DataFrame) -> DataFrame:
    """Counts of records(id, type, source_ids) and of unnamed roads."""
    road = F.col("id").startswith("road:")
    out = records.agg(
        F.count_if(road).alias("named_roads"), F.coalesce(F.sum(F.when(road, F.size("source_ids"))), F.lit(0)).cast("long").alias("named_road_segments"),
        F.count_if(F.col("type") == "building").alias("buildings"), F.count_if(F.col("type") == "zone").alias("zones"), F.count_if(F.col("type") == "point").alias("points"),
    )
    return out.crossJoin(unnamed.agg(F.count("*").alias("unnamed_road_segments")))  # one row each


def building_name(tag_name: Column, landmark: Column, amenity: Column) -> Column:
    return F.coalesce(jsem.text_or_null(tag_name), jsem.text_or_null(landmark), jsem.lookup(amenity, AMENITY_NAME))


def building_source(tag_name: Column, landmark: Column) -> Column:
    return F.when(jsem.text_or_null(tag_name).isNotNull(), "OpenStreetMap").when(landmark.isNotNull(), "IGN BD TOPO").otherwise("Type d’équipement OpenStreetMap")


def pick(queries: DataFrame, buildings: DataFrame, points: DataFrame, lines: DataFrame, zones: DataFrame) -> DataFrame:
    """(query_id, tier, record_id) of queries(query_id, p), answered in tiers, a place once however many queries ask for it: the building that holds the point (its
    record may be null: then nothing is found), the nearest point within 22, the nearest line within 10, the smallest
    zone. buildings(ord, record_id, poly), points(ord, record_id, q), lines(ord, record_id, line), zones(ord,
    record_id, poly)."""
    places = queries.select("p").distinct()
    tiers = (
        spatial.first_container(places, buildings, "p", "ord"), spatial.nearest_point(places, points, "p", "ord"),
        spatial.nearest_segment(places, lines, "p", "ord"), spatial.smallest_container(places, zones, "p", "ord"),
    )
    kind = buildings.schema["record_id"].dataType
    rows = [found.select("p", F.lit(k + 1).alias("tier"), F.col("record_id").cast(kind).alias("record_id")) for k, found in enumerate(tiers)]
    best = reduce(DataFrame.unionByName, rows).groupBy("p").agg(F.min(F.struct("tier", "record_id")).alias("b"))  # one shuffle, not a join each
    return queries.select("query_id", "p").distinct().join(best, "p", "left").select("query_id", F.col("b.tier").alias("tier"), F.col("b.record_id").alias("record_id"))


def landmark_override(buildings: DataFrame, amenities: DataFrame) -> DataFrame:
    """buildings(id, ord, tags, poly) with the amenity and name of the last of amenities(point_id, ord_p, p, amenity,
    name) of which it is the first holder."""
    hit = spatial.first_container(amenities.withColumnRenamed("ord_p", "op"), buildings.select(F.col("id").alias("b_id"), "ord", "poly"), "point_id", "ord")
    new = hit.groupBy(F.col("b_id").alias("id")).agg(F.max_by(F.struct("amenity", "name"), "op").alias("o"))
    out = buildings.join(new, "id", "left")
    kept = F.map_filter("tags", lambda k, v: ~k.isin("amenity", "name"))
    put = F.map_concat(kept, F.map_from_arrays(F.array(F.lit("amenity"), F.lit("name")), F.array("o.amenity", "o.name")))
    return out.withColumn("tags", F.when(F.col("o").isNotNull(), put).otherwise(F.col("tags"))).drop("o")


def in_extent(p: Column, extent: Column) -> Column:
    return geom.within(p, extent)


def _record(df: DataFrame, type_: str, **columns: Column) -> DataFrame:
    fixed = {"id": "string", "name": "string", "kind": "string", "source": "string"}
    got = [columns.get(c, F.col(c)).cast(t).alias(c) for c, t in fixed.items()]
    position = columns.get("position", F.col("position"))
    rest = [position.cast("struct<x:double,z:double>").alias("position"), columns.get("poly", F.lit(None)).cast(f"array<{geom.RING}>").alias("poly"), columns.get("source_ids", F.lit(None)).cast("array<string>").alias("source_ids"), F.col("ord").cast("long")]
    return df.select(*got, F.lit(type_).alias("type"), *rest)


def build(roads: DataFrame, points: DataFrame, areas: DataFrame, zones: DataFrame, buildings: DataFrame, landmarks: DataFrame, extent: Column) -> tuple[DataFrame, DataFrame]:
    """The catalogue's records (id, name, kind, source, type, position, poly, source_ids, ord) and its aliases (id,
    record_id).

    roads: as in road_groups, of which the pieces inside the extent count; points(ord, id, name, place, p); areas(ord, id, name, poly), neither roads nor
    buildings; zones(ord, id, name, nature, poly); buildings(ord, id, tags, poly, landmark), landmark being a
    name or null; landmarks(ord, id, name, kind, p). Later sources come after earlier ones in the records' order: what
    several of them hold goes to the first. A named point in exactly one building that isn't known yet makes that
    building a record; a landmark joins the first record of its name within 45 m, earlier landmarks that became records included, or else
    is a point of its own.
    """
    step = lambda df, k: df.withColumn("ord", F.col("ord").cast("long") + F.lit(k * (1 << 40)))
    named = jsem.text_or_null(F.trim("name"))
    lines = _record(road_groups(clipped_roads(roads, extent)).withColumn("kind", F.when(F.col("id").startswith("road:"), "Rue / voie").otherwise("Voie ferrée")).withColumn("source", F.lit("OpenStreetMap")), "line", source_ids=F.col("source_ids"))
    spots = points.withColumn("name", named).where("name is not null").where(geom.within(F.col("p"), extent))
    spots = _record(step(spots, 0), "point", kind=F.when(jsem.text_or_null("place").isNotNull(), "Lieu-dit / secteur").otherwise("Lieu / équipement"), source=F.lit("OpenStreetMap"), position=F.col("p"))

    def shaped(df: DataFrame) -> DataFrame:
        cut = F.transform("poly", lambda r: geom.clip_ring(r, extent))
        return df.withColumn("poly", cut).where(F.size(F.col("poly")[0]) >= 3)

    surfaces = _record(step(shaped(areas.withColumn("name", named).where("name is not null")), 0), "zone", kind=F.lit("Zone / lieu"), source=F.lit("OpenStreetMap"), position=geom.centre(F.col("poly")[0]), poly=F.col("poly"))
    activity = _record(step(shaped(zones), 1), "zone", kind=F.coalesce(jsem.text_or_null("nature"), F.lit("Zone / lieu")), source=F.lit("IGN BD TOPO"), position=geom.centre(F.col("poly")[0]), poly=F.col("poly"))
    solid = buildings.where(geom.area(F.col("poly")[0]) >= 3)
    tag = lambda k: F.col("tags")[k]
    known = solid.withColumn("name", building_name(tag("name"), F.col("landmark"), tag("amenity"))).where("name is not null")
    house = lambda df, source: _record(df, "building", kind=F.lit("Bâtiment / équipement"), source=source, position=geom.centre(F.col("poly")[0]), poly=F.col("poly"))
    houses = house(step(known, 2), building_source(tag("name"), F.col("landmark")))
    base = cut(lines.unionByName(spots).unionByName(surfaces).unionByName(activity).unionByName(houses))
    # Points that aren't places, in exactly one building.
    asked = spots.where(~F.col("kind").startswith("Lieu-dit")).select(F.col("id").alias("point_id"), F.col("ord").alias("point_ord"), F.col("name").alias("point_name"), F.col("source").alias("point_source"), F.col("position").alias("p"))
    hits = spatial.unique_container(asked, buildings.select(F.col("id").cast("string").alias("id"), "poly"), "point_id")
    hits = hits.join(base.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min(F.struct("point_ord", "point_name", "point_source")).alias("h"), F.first("poly").alias("poly"))
    found = house(step(hits.select("id", F.col("h.point_name").alias("name"), F.col("h.point_source").alias("source"), F.col("h.point_ord").alias("ord"), "poly"), 3), F.col("source"))
    base = base.unionByName(cut(found))
    marks = landmarks.where(geom.within(F.col("p"), extent)).withColumn("id", F.col("id").cast("string")).join(base.select("id").distinct(), "id", "left_anti")
    placed = base.where("type <> 'line'").select(F.col("id").alias("record_id"), F.col("name").alias("record_name"), F.col("position").alias("q"), "ord")
    merged = cut(spatial.merged_by_name(marks.select("id", "name", "p"), placed))
    # A landmark without a record may have an earlier one of its name near by, which is its record then.
    new = cut(marks.join(merged.where("added").select("id"), "id", "left_semi"))
    came = spatial.first_come(new.select("id", "name", "p", "ord"))
    alone, twin = new.join(came.where("id = record_id").select("id"), "id", "left_semi"), came.where("id <> record_id")
    extra = _record(step(alone, 4), "point", kind=F.coalesce(jsem.text_or_null("kind"), F.lit("Lieu / équipement")), source=F.lit("IGN BD TOPO"), position=F.col("p"))
    records = base.unionByName(extra)
    empty = F.array().cast("array<string>")
    own = id_aliases(records.select("id", F.coalesce("source_ids", empty).alias("source_ids"), "ord"))
    aliases = own.unionByName(merged.where("not added").select("id", "record_id")).unionByName(twin)
    return records, aliases
