"""Open map elements: tag-filtered scans, and geometry of ways from their nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a scan asks for, by element kind.
ANY_KIND = ("building", "landuse", "natural", "waterway", "leisure", "amenity", "place")
WAYS = ("highway", "railway")
AREA_KEYS = ("building", "landuse", "natural", "leisure", "amenity")


def padded_box(df: DataFrame, lon: str, lat: str, pad_lon: float = 0.0015, pad_lat: float = 0.001) -> DataFrame:
    """One row: the bounds of coordinates with a margin, as asked of a remote source."""
    return df.agg((F.min(lat) - pad_lat).alias("south"), (F.min(lon) - pad_lon).alias("west"), (F.max(lat) + pad_lat).alias("north"), (F.max(lon) + pad_lon).alias("east"))


def wanted(kind: Column, tags: Column) -> Column:
    """Whether an element's tags are asked for."""
    has = lambda k: F.coalesce(F.map_contains_key(tags, k), F.lit(False))
    out = F.lit(False)
    for k in ANY_KIND:
        out = out | has(k)
    for k in WAYS:
        out = out | ((kind == "way") & has(k))
    return out | ((kind == "way") & F.coalesce(tags["barrier"] == "hedge", F.lit(False)))


def tag_scan(elements: DataFrame, refs: DataFrame) -> DataFrame:
    """Ids (kind, id) of wanted elements(kind, id, tags) and of the nodes that wanted ways refer to (refs: way_id,
    node_id), each once."""
    hit = elements.where(wanted(F.col("kind"), F.col("tags"))).select("kind", "id")
    nodes = refs.join(hit.where("kind = 'way'").select(F.col("id").alias("way_id")), "way_id", "left_semi").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    return hit.union(nodes).distinct()


def way_geometry(refs: DataFrame, nodes: DataFrame, areas: DataFrame) -> DataFrame:
    """(way_id, kind, n_points, path) of refs(way_id, pos, node_id) and nodes(node_id, lon, lat): a closed way of four
    points or more that areas(way_id) lists is a Polygon, others LineStrings; ways with a missing node are tainted."""
    joined = refs.join(nodes, "node_id", "left").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("s"))
    path = F.transform(F.filter("s", lambda p: p["lon"].isNotNull()), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    closed = (F.size("s") >= 4) & (F.element_at("s", 1)["node_id"] == F.element_at("s", -1)["node_id"])
    listed = areas.select("way_id").distinct().withColumn("listed", F.lit(True))
    out = joined.join(listed, "way_id", "left")
    return out.select("way_id", F.when(closed & F.col("listed"), "Polygon").otherwise("LineString").alias("kind"), F.size(path).alias("n_points"), path.alias("path"), F.exists("s", lambda p: p["lon"].isNull()).alias("tainted"))


def _stitched(ways: list[list[tuple[float, float]]]) -> tuple[list[list[tuple[float, float]]], bool]:
    """Rings that ways make up end to end, either way round, and whether all are closed."""
    left, rings, whole = [w for w in ways if len(w) > 1], [], True
    while left:
        ring = list(left.pop(0))
        while ring[0] != ring[-1]:
            k = next((k for k, w in enumerate(left) if ring[-1] in (w[0], w[-1])), None)
            if k is None:
                whole = False
                break
            w = left.pop(k)
            ring += (w if w[0] == ring[-1] else w[::-1])[1:]
        rings.append(ring)
    return rings, whole


def _holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    """Even-odd containment."""
    hits = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        hits += (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax
    return hits % 2 == 1


def _assembled(members) -> tuple[list, bool]:
    """The polygons of a relation's members (pos, role, path), and whether any way is missing or any ring is open."""
    members = sorted(members, key=lambda m: m["pos"])
    path = lambda inner: [[(p["lon"], p["lat"]) for p in m["path"]] for m in members if (m["role"] == "inner") == inner and m["path"] is not None]
    outer, closed = _stitched(path(False))
    inner, also = _stitched(path(True))
    polys = [[ring] for ring in outer if ring[0] == ring[-1]]
    for ring in inner:
        home = next((p for p in polys if _holds(p[0], ring[0])), None)
        if home is not None:
            home.append(ring)
    return [[[{"lon": x, "lat": y} for x, y in ring] for ring in p] for p in polys], any(m["path"] is None for m in members) or not closed or not also


def _all_assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [_assembled(m) for m in batch.members]
        yield pd.DataFrame({"relation_id": batch.relation_id, "polys": [polys for polys, _ in got], "tainted": [tainted for _, tainted in got]})


def relation_polygons(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(relation_id, polys, tainted) of members(relation_id, pos, role, way_id) and ways(way_id, path): outer ways are
    joined end to end to shells, inner ones to holes of the shell they lie in; a relation with a missing way or an open
    ring is tainted. A relation is one row's list: map data bounds its members (32,000), so none grows with the input.
    Relations are dealt out over a few tasks a core, as their lists are small beside the work in them."""
    rows = members.join(ways.select("way_id", "path"), "way_id", "left").select("relation_id", F.struct("pos", F.coalesce("role", F.lit("outer")).alias("role"), "path").alias("m"))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    lists = rows.repartition(tasks, "relation_id").groupBy("relation_id").agg(F.collect_list("m").alias("members"))
    point = "struct<lon:double,lat:double>"
    return lists.mapInPandas(_all_assembled, f"relation_id long, polys array<array<array<{point}>>>, tainted boolean")
