"""Map labels: their sources, order, and which ones fit a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import jsem
from parcelwise.operators import spatial
from parcelwise.operators.rounds import cut, first_kept

# Names of amenities that have none of their own.
DEFAULT_NAME = {"townhall": "Mairie", "school": "École", "community_centre": "Salle communale"}
BUILDING_NAME = {"townhall": "Mairie", "school": "École primaire"}


def new_names(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels(name, ...) and those of more(ord, name, ...) whose name is new, the first of each."""
    first = more.groupBy("name").agg(F.min_by(F.struct(*[c for c in more.columns if c != "name"]), "ord").alias("x")).select("name", "x.*")
    return labels.unionByName(first.join(labels.select("name").distinct(), "name", "left_anti"), allowMissingColumns=True)


def new_places(labels: DataFrame, more: DataFrame, point_id: str, reach: float = 45.0) -> DataFrame:
    """Those of more(point_id, p, ...) that have no label(q) within reach."""
    return spatial.without_neighbours(more, labels, point_id, reach)


def building_label(kind: Column, landmark: Column, tag_name: Column, amenity: Column) -> Column:
    """The label of a church or public building: its landmark, else its own name, else its amenity's; null for others."""
    name = F.coalesce(jsem.text_or_null(landmark), jsem.text_or_null(tag_name), jsem.lookup(amenity, BUILDING_NAME))
    return F.when(kind.isin("church", "public"), name)


def shields(roads: DataFrame, refs: tuple[str, ...], least: int = 4) -> DataFrame:
    """(ord, name, p): for each ref, in their order, the middle point of the first of roads(ord, ref, line) that has it and
    as many points at least."""
    first = roads.where(F.col("ref").isin(*refs) & (F.size("line") >= least)).groupBy("ref").agg(F.min_by("line", "ord").alias("line"))
    middle = F.get("line", F.floor(F.size("line") / 2).cast("int"))
    return first.select(F.array_position(F.lit(list(refs)), F.col("ref")).cast("long").alias("ord"), F.col("ref").alias("name"), middle.alias("p"))


def joined(buildings: DataFrame, places: DataFrame, landmarks: DataFrame, points: DataFrame, roads: DataFrame) -> DataFrame:
    """(source, ord, name, p, major) of all sources, each new to those before it: places(ord, name, p, major) by name,
    landmarks(ord, id, name, p) by a distance of 45 m from any label, points(ord, name, amenity, place, p) that are
    settlements or amenities, with a default name, by name. buildings and roads(ord, name, p) come as they are."""
    row = lambda df, source, major=None: df.select(F.lit(source).alias("source"), F.col("ord").cast("long").alias("ord"), "name", "p", F.coalesce(F.lit(False) if major is None else major, F.lit(False)).alias("major"))
    out = new_names(row(buildings, "building"), row(places, "place", F.col("major")))
    out = cut(out)
    free = cut(new_places(out.select(F.col("p").alias("q")), landmarks, "id"))
    first = spatial.first_come(free.select("id", "name", "p", "ord"), by_name=False).where("id = record_id").select("id")
    out = out.unionByName(row(free.join(first, "id", "left_semi"), "landmark"))
    asked = points.where(F.col("place").isin("hamlet", "village") | F.col("amenity").isin(*DEFAULT_NAME))
    name = F.coalesce(jsem.text_or_null("name"), jsem.lookup("amenity", DEFAULT_NAME), F.lit(DEFAULT_NAME["community_centre"]))
    out = new_names(out, row(asked.withColumn("name", name), "point", jsem.text_or_null("place").isNotNull()))
    return out.unionByName(row(roads, "shield"))


def in_order(labels: DataFrame) -> DataFrame:
    """Major ones first, else as they came."""
    return labels.orderBy(F.desc(F.coalesce("major", F.lit(False))), "ord")


def fitting(labels: DataFrame, width: float, height: float, local_reach: float = 2200.0) -> DataFrame:
    """(view_id, id, visible) of labels(view_id, id, ord, name, major, local, distance, x, y): within the view's frame,
    local ones from near only, and in order if they don't overlap what is placed. Labels are compared with those that
    share a cell of the screen with them, and decided in rounds, so no view is gathered in one place."""
    on = (~F.coalesce("local", F.lit(False)) | (F.col("distance") < local_reach)) & (F.col("x") > 20) & (F.col("x") < width - 20) & (F.col("y") > 135) & (F.col("y") < height - 80)
    half = (F.length("name") * 7 + 20) / 2
    box = F.struct((F.col("x") - half).alias("minx"), (F.col("x") + half).alias("maxx"), (F.col("y") - 15).alias("minz"), (F.col("y") + 15).alias("maxz"))
    order = F.struct(~F.coalesce("major", F.lit(False)), F.col("ord"), F.col("id"))
    rows = cut(labels.where(on).select(F.struct("view_id", "id").alias("id"), "view_id", order.alias("o"), box.alias("box")))
    others = rows.select("view_id", F.col("id").alias("other"), F.col("o").alias("other_o"), F.col("box").alias("other_box"))
    over = (F.col("box.minx") < F.col("other_box.maxx")) & (F.col("box.maxx") > F.col("other_box.minx")) & (F.col("box.minz") < F.col("other_box.maxz")) & (F.col("box.maxz") > F.col("other_box.minz"))
    pairs = cut(spatial.grid_join(rows, others, "box", "other_box", 128.0, by=("view_id",)).where(over & (F.col("other_o") < F.col("o"))).select(F.col("id"), "other"))
    seen = first_kept(rows.select("id", F.col("o").alias("order")), pairs).select("id.view_id", "id.id", F.col("kept").alias("visible"))
    return labels.join(seen, ["view_id", "id"], "left").select("view_id", "id", F.coalesce("visible", F.lit(False)).alias("visible"))
