"""Queries of feature scans, catalogue, lines and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem
from parcelwise.operators import catalogue, labels, landuse, quality
from parcelwise.operators.rounds import numbered
from parcelwise.plans import fixtures as fx
from parcelwise.sources import geojson, osm

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("SELECT vec_id, floor(CAST(embedding[1] AS DOUBLE) * 10000000 + 0.5) / 10000000 AS lon, floor(CAST(embedding[2] AS DOUBLE) * 10000000 + 0.5) / 10000000 AS lat FROM embeddings")
def coord_round(spark, sf_dir):
    e = lambda i: geojson.rounded(F.col("embedding")[i].cast("double"))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", e(0).alias("lon"), e(1).alias("lat"))


@query("SELECT min(CAST(embedding[2] AS DOUBLE)) - CAST(0.001 AS DOUBLE) AS south, min(CAST(embedding[1] AS DOUBLE)) - CAST(0.0015 AS DOUBLE) AS west, max(CAST(embedding[2] AS DOUBLE)) + CAST(0.001 AS DOUBLE) AS north, max(CAST(embedding[1] AS DOUBLE)) + CAST(0.0015 AS DOUBLE) AS east FROM embeddings")
def bbox_pad(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("lon"), F.col("embedding")[1].cast("double").alias("lat"))
    return osm.padded_box(e, "lon", "lat")


@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) - 0.25) * (6371008.8 * pi() / 180) * cos(radians(CAST(0.5 AS DOUBLE))), 3) AS x, round(-(CAST(embedding[2] AS DOUBLE) - 0.5) * (6371008.8 * pi() / 180), 3) AS z FROM embeddings")
def project_points(spark, sf_dir):
    p = geom.project(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), (0.25, 0.5))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.round(p["x"], 3).alias("x"), F.round(p["z"], 3).alias("z"))


# Features from events: an open tag bag of what divides the id.
_TAGS = """f AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_type END AS building, CASE WHEN event_id % 5 = 0 THEN 'residential' WHEN event_id % 50 = 1 THEN '' END AS highway,
    CASE WHEN event_id % 7 = 0 THEN 'rail' WHEN event_id % 7 = 1 THEN 'tram' END AS railway, CASE WHEN event_id % 11 = 0 THEN 'hamlet' END AS place, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END AS name,
    CASE WHEN event_id % 13 = 0 THEN 'hedge' WHEN event_id % 13 = 1 THEN 'wall' END AS barrier, event_id % 17 = 0 AS tainted FROM events)"""


def _features(spark, sf_dir):
    e = F.col("event_id")
    tags = {
        "building": F.when(e % 3 == 0, F.col("event_type")), "highway": F.when(e % 5 == 0, "residential").when(e % 50 == 1, ""), "railway": F.when(e % 7 == 0, "rail").when(e % 7 == 1, "tram"),
        "place": F.when(e % 11 == 0, "hamlet"), "name": F.when(e % 2 == 0, F.concat(F.lit("n"), e)), "barrier": F.when(e % 13 == 0, "hedge").when(e % 13 == 1, "wall"), "@tainted": F.when(e % 17 == 0, "true"),
    }
    bag = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in tags.items()]), lambda x: x["v"].isNotNull()))
    return fx.table(spark, sf_dir, "events").select(e.alias("id"), bag.alias("properties"), F.when(e % 19 != 0, "Point").alias("kind"))


@query(f"WITH {_TAGS} SELECT count(*) AS features, count(building) AS buildings, count(*) FILTER (highway <> '') AS roads, count(*) FILTER (railway = 'rail') AS rail, count(*) FILTER (place IS NOT NULL AND name IS NOT NULL) AS places FROM f")
def feature_counts(spark, sf_dir):
    return geojson.feature_counts(_features(spark, sf_dir))


@query(f"WITH {_TAGS} SELECT id FROM f WHERE id % 19 <> 0 AND NOT tainted")
def drop_tainted(spark, sf_dir):
    return geojson.whole_geometry(_features(spark, sf_dir)).select("id")


def _zones(spark, sf_dir):
    c = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(
        c.alias("id"), F.when(c % 9 != 0, "10220").otherwise("10221").alias("insee"), F.when(c % 5 != 0, "En service").otherwise("En projet").alias("state"), F.when(c % 4 == 0, False).when(c % 4 == 1, True).alias("fictitious"),
        F.when(c % 3 == 0, "").when(c % 3 == 1, F.col("c_name")).alias("name"), F.when(c % 7 == 0, "Caserne de pompiers").otherwise(F.col("c_mktsegment")).alias("nature"), (c % 20).cast("double").alias("precision"),
    )


_ZONE = """z AS (SELECT c_custkey AS id, c_custkey % 9 <> 0 AS here, c_custkey % 5 <> 0 AS service, CASE WHEN c_custkey % 4 = 0 THEN FALSE WHEN c_custkey % 4 = 1 THEN TRUE END AS fictitious,
    CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'Caserne de pompiers' ELSE c_mktsegment END AS nature, CAST(c_custkey % 20 AS DOUBLE) AS precision FROM customer)"""


@query(f"WITH {_ZONE} SELECT id, name, nature, precision FROM z WHERE here AND service AND fictitious IS NOT DISTINCT FROM FALSE AND name <> ''")
def named_zones(spark, sf_dir):
    return geojson.named_zones(_zones(spark, sf_dir), "10220")


@query(f"WITH {_ZONE}, n AS (SELECT *, coalesce(nullif(name, ''), CASE nature WHEN 'Caserne de pompiers' THEN 'Centre de secours' END) AS nm FROM z) SELECT id, nm AS name, nature, precision, fictitious FROM n WHERE here AND service AND nm IS NOT NULL")
def landmarks(spark, sf_dir):
    return geojson.landmarks(_zones(spark, sf_dir), "10220")


@query("SELECT c_custkey AS id, c_mktsegment AS nature, c_acctbal AS precision FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def vegetation_subset(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("nature"), F.col("c_acctbal").alias("precision"), "c_name")
    return geojson.of_nature(rows, ("BUILDING", "MACHINERY"))


def _extent(x0, x1, z0, z1):
    return F.struct(F.lit(float(x0)).alias("minx"), F.lit(float(x1)).alias("maxx"), F.lit(float(z0)).alias("minz"), F.lit(float(z1)).alias("maxz"))


@query(f"{fx.sql('pt')} SELECT point_id FROM pt WHERE x BETWEEN 100.25 AND 600 AND z BETWEEN 200.5 AND 700")
def extent_filter(spark, sf_dir):
    return fx.points(spark, sf_dir).where(geom.within(F.col("p"), _extent(100.25, 600, 200.5, 700))).select("point_id")


_SCAN = f"""WITH {_TAGS}, hit AS (SELECT id, id % 4 <> 0 AS way FROM f WHERE building IS NOT NULL OR place IS NOT NULL OR (id % 4 <> 0 AND (highway IS NOT NULL OR railway IS NOT NULL OR barrier = 'hedge')))
SELECT CASE WHEN way THEN 'way' ELSE 'node' END AS kind, id FROM hit UNION SELECT 'node', l_partkey + 1000000 FROM lineitem JOIN hit ON way AND id = l_orderkey"""


@query(_SCAN)
def tag_scan(spark, sf_dir):
    elements = _features(spark, sf_dir).select(F.when(F.col("id") % 4 != 0, "way").otherwise("node").alias("kind"), "id", F.col("properties").alias("tags"))
    refs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), (F.col("l_partkey") + 1000000).alias("node_id"))
    return osm.tag_scan(elements, refs)


@query("""WITH refs AS (SELECT l_orderkey AS way_id, l_partkey % 40 AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos FROM lineitem),
k AS (SELECT way_id, sum(node_id * CAST(0.5 AS DOUBLE) * rn) AS path FROM (SELECT way_id, node_id, row_number() OVER (PARTITION BY way_id ORDER BY pos) AS rn FROM refs WHERE node_id <> 39) GROUP BY 1),
n AS (SELECT way_id, count(*) AS n, count(*) FILTER (node_id <> 39) AS known, min_by(node_id, pos) AS first, max_by(node_id, pos) AS last FROM refs GROUP BY 1)
SELECT way_id, coalesce(path, 0) AS path, CASE WHEN n >= 4 AND first = last AND way_id % 2 = 0 THEN 'Polygon' ELSE 'LineString' END AS kind, CAST(known AS INTEGER) AS n_points, known < n AS tainted FROM n LEFT JOIN k USING (way_id)""")
def osm_way_geometry(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    refs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.row_number().over(order).alias("pos"), (F.col("l_partkey") % 40).alias("node_id"))
    nodes = spark.range(39).select(F.col("id").alias("node_id"), (F.col("id") * 0.5).alias("lon"), (F.col("id") * 0.25).alias("lat"))
    areas = fx.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("way_id"))
    place = F.aggregate(F.transform("path", lambda p, i: p["lon"] * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return osm.way_geometry(refs, nodes, areas).select("way_id", "kind", "n_points", "tainted", place.alias("path"))


_GROUP = f"""{fx.sql('road')}, t AS (SELECT *, coalesce(nullif(trim(name), ''), ref) AS title FROM road), k AS (SELECT *, CASE WHEN is_road THEN 'road:' ELSE 'rail:' END || title AS key FROM t WHERE title IS NOT NULL)"""


@query(_GROUP + """, l AS (SELECT key, max_by(id, n * 100000000 + ord) AS best, max(n) AS n FROM k GROUP BY 1), g AS (SELECT key, min(title) AS name, min_by(width, ord) AS width, CAST(count(*) AS INTEGER) AS n_ids, min(id) AS first_id FROM k GROUP BY 1)
SELECT key AS id, name, width, n_ids, first_id, CAST(best * 3 + n // 2 AS DOUBLE) AS x, CAST(best % 100 + (n // 2) * (n // 2) AS DOUBLE) AS z FROM g JOIN l USING (key)""")
def road_groups(spark, sf_dir):
    out = catalogue.road_groups(fx.roads(spark, sf_dir))
    return out.select("id", "name", "width", F.size("source_ids").alias("n_ids"), F.col("source_ids")[0].alias("first_id"), "position.x", "position.z")


@query(_GROUP + """, l AS (SELECT key, max_by(id, n * 100000000 + ord) AS best, max(n) AS n FROM k GROUP BY 1) SELECT key AS id, CAST(best * 3 + n // 2 AS DOUBLE) AS x FROM l""")
def longest_path_mid(spark, sf_dir):
    return catalogue.road_groups(fx.roads(spark, sf_dir)).select("id", "position.x")


#: The frame ends between two points of the roads that it cuts; most roads lie outside.
_EDGE = 9000.5
_INSIDE = _GROUP.replace("FROM road)", f"FROM road WHERE id * 3 <= {_EDGE})")


def _frame():
    return F.struct(*[F.lit(v).alias(k) for k, v in (("minx", -1e6), ("maxx", _EDGE), ("minz", -1e6), ("maxz", 1e6))])


@query(_INSIDE + f""", c AS (SELECT *, CASE WHEN id * 3 + n - 1 <= {_EDGE} THEN n ELSE CAST(floor({_EDGE} - id * 3) AS BIGINT) + 2 END AS m FROM k),
l AS (SELECT key, max_by(id, m * 100000000 + ord) AS best, max(m) AS m FROM c GROUP BY 1), w AS (SELECT l.key, l.m, id, n, l.m // 2 AS spot, l.m // 2 = l.m - 1 AND l.m < n + (id * 3 + n - 1 > {_EDGE})::INT AND id * 3 + l.m // 2 > {_EDGE} AS cut_off FROM l JOIN c ON c.id = l.best),
g AS (SELECT key, CAST(count(*) AS INTEGER) AS n_ids, CAST(sum(1) AS BIGINT) AS n_paths FROM k GROUP BY 1)
SELECT key AS id, n_ids, n_paths, CAST(CASE WHEN cut_off THEN {_EDGE} ELSE id * 3 + spot END AS DOUBLE) AS x, round(CAST(CASE WHEN cut_off THEN id % 100 + (spot - 1) * (spot - 1) + ({_EDGE} - id * 3 - (spot - 1)) * (2 * spot - 1) ELSE id % 100 + spot * spot END AS DOUBLE), 6) AS z FROM g JOIN w USING (key)""")
def clipped_roads(spark, sf_dir):
    """A2 within an extent: pieces inside it are grouped, roads outside it go."""
    out = catalogue.road_groups(catalogue.clipped_roads(fx.roads(spark, sf_dir), _frame()))
    return out.select("id", F.size("source_ids").alias("n_ids"), "n_paths", "position.x", F.round("position.z", 6).alias("z"))


@query(_INSIDE + """, g AS (SELECT key, count(*) AS n FROM k GROUP BY 1) SELECT (SELECT count(*) FROM g WHERE key LIKE 'road:%') AS named_roads, (SELECT CAST(sum(n) AS BIGINT) FROM g WHERE key LIKE 'road:%') AS named_road_segments,
(SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0) AS buildings, (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 1) AS zones, (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 2) AS points, (SELECT count(*) FROM t WHERE title IS NULL AND is_road) AS unnamed_road_segments""")
def catalogue_stats(spark, sf_dir):
    roads = catalogue.clipped_roads(fx.roads(spark, sf_dir), _frame())
    lines = catalogue.road_groups(roads).select("id", F.lit("line").alias("type"), "source_ids")
    n = F.col("n_nationkey")
    other = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit("way/"), n).alias("id"), F.when(n % 3 == 0, "building").when(n % 3 == 1, "zone").otherwise("point").alias("type"), F.array().cast("array<bigint>").alias("source_ids"))
    return catalogue.catalogue_statistics(lines.unionByName(other), catalogue.unnamed_roads(roads))


@query(_GROUP + ", g AS (SELECT key, min(ord) AS ord FROM k GROUP BY 1), e AS (SELECT key AS id, key AS record_id, ord FROM g UNION ALL SELECT CAST(k.id AS VARCHAR), k.key, g.ord FROM k JOIN g USING (key)) SELECT id, max_by(record_id, ord) AS record_id FROM e GROUP BY 1")
def id_alias(spark, sf_dir):
    groups = catalogue.road_groups(fx.roads(spark, sf_dir))
    return catalogue.id_aliases(groups.select("id", F.transform("source_ids", lambda x: x.cast("string")).alias("source_ids"), "ord"))


def _corner(spark, sf_dir):
    """A line of two legs per supplier: east, then south."""
    s = F.col("s_suppkey")
    a = s % 10 + 5
    return fx.table(spark, sf_dir, "supplier").select(s.alias("id"), F.array(geom.point(s, F.lit(0)), geom.point(s + a, F.lit(0)), geom.point(s + a, s % 7 + 3)).alias("line"))


@query("""WITH l AS (SELECT s_suppkey AS id, s_suppkey % 10 + 5 AS a, s_suppkey % 7 + 3 AS b FROM supplier), k AS (SELECT id, a, 2 + 4 * unnest(range(0, (a + b + 2) // 4)) AS pos FROM l)
SELECT id, count(*) AS n, sum(CAST(id + least(a, pos) AS DOUBLE)) AS x, sum(CAST(greatest(0, pos - a) AS DOUBLE)) AS z FROM k GROUP BY 1""")
def line_sample(spark, sf_dir):
    out = _corner(spark, sf_dir).select("id", F.explode(geom.sample_line(F.col("line"), 4.0)).alias("p"))
    return out.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("p.x"), 6).alias("x"), F.round(F.sum("p.z"), 6).alias("z"))


@query(f"{fx.sql('pt')}, c AS (SELECT greatest(x, 100) AS lo, least(x + 30, 900) AS hi FROM pt WHERE z BETWEEN 100 AND 900 AND x + 30 >= 100 AND x <= 900) SELECT count(*) AS pieces, sum(hi - lo) AS length FROM c")
def clip_counts(spark, sf_dir):
    line = F.array(F.col("p"), geom.point(F.col("p.x") + 30, F.col("p.z")))
    piece = fx.points(spark, sf_dir).select(F.explode(geom.clip_line(line, _extent(100, 900, 100, 900))).alias("s"))
    return piece.agg(F.count("*").alias("pieces"), F.round(F.sum(F.col("s")[1]["x"] - F.col("s")[0]["x"]), 6).alias("length"))


@query(f"""{fx.sql('pt')}, c AS (SELECT greatest(0, (100 - x) / 30, (100 - z) / 40) AS lo, least(1, (900 - x) / 30, (900 - z) / 40) AS hi FROM pt) SELECT count(*) AS pieces, round(sum(50 * (hi - lo)), 5) AS length FROM c WHERE lo <= hi""")
def clip_slanted(spark, sf_dir):
    line = F.array(F.col("p"), geom.point(F.col("p.x") + 30, F.col("p.z") + 40))
    piece = fx.points(spark, sf_dir).select(F.explode(geom.clip_line(line, _extent(100, 900, 100, 900))).alias("s"))
    return piece.agg(F.count("*").alias("pieces"), F.round(F.sum(geom.distance(F.col("s")[0], F.col("s")[1])), 5).alias("length"))


@query(f"{fx.sql('a')}, c AS (SELECT a_id, least(x1, 700) - greatest(x0, 100) AS w, least(z1, 600) - greatest(z0, 50) AS h FROM a) SELECT a_id, round(w * h, 6) AS area FROM c WHERE w > 0 AND h > 0")
def clip_rings(spark, sf_dir):
    a = fx.spread(fx.footprints(spark, sf_dir)[0], "a_id")
    b = F.col("a_box")
    a = a.withColumn("a_poly", F.array(geom.rectangle(b["minx"], b["minz"], b["maxx"], b["maxz"])))
    area = geom.area(geom.clip_ring(F.col("a_poly")[0], _extent(100, 700, 50, 600)))
    return geom.once(a, area=area).where("area > 0").select("a_id", F.round("area", 6).alias("area"))


_TRI = "t AS (SELECT s_suppkey AS id, CAST(s_suppkey % 30 AS DOUBLE) AS ax, CAST(s_suppkey % 7 AS DOUBLE) AS az, CAST(s_suppkey % 30 + 10 + s_suppkey % 11 AS DOUBLE) AS bx, CAST(s_suppkey % 5 AS DOUBLE) AS bz, CAST(s_suppkey % 13 AS DOUBLE) AS cx, CAST(20 + s_suppkey % 17 AS DOUBLE) AS cz FROM supplier)"


def _triangles(spark, sf_dir):
    s = F.col("s_suppkey")
    a, b, c = geom.point(s % 30, s % 7), geom.point(s % 30 + 10 + s % 11, s % 5), geom.point(s % 13, 20 + s % 17)
    return fx.table(spark, sf_dir, "supplier").select(s.alias("id"), F.array(a, b, c, a).alias("ring"))


@query(f"WITH {_TRI} SELECT id, abs((bx - ax) * (cz - az) - (bz - az) * (cx - ax)) / 2 AS area, least(ax, bx, cx) AS minx, greatest(ax, bx, cx) AS maxx, least(az, bz, cz) AS minz, greatest(az, bz, cz) AS maxz FROM t")
def ring_bounds(spark, sf_dir):
    b = geom.bounds(F.col("ring"))
    return _triangles(spark, sf_dir).select("id", geom.area(F.col("ring")).alias("area"), *[b[k].alias(k) for k in ("minx", "maxx", "minz", "maxz")])


@query(f"""WITH {_TRI}, e AS (SELECT id, unnest([{{'k': 0, 'dx': bx - ax, 'dz': bz - az}}, {{'k': 1, 'dx': cx - bx, 'dz': cz - bz}}, {{'k': 2, 'dx': ax - cx, 'dz': az - cz}}]) AS e FROM t),
r AS (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY e.dx * e.dx + e.dz * e.dz DESC, e.k) AS rn FROM e) SELECT id, round(atan2(e.dz, e.dx), 6) AS angle FROM r WHERE rn = 1""")
def longest_edge(spark, sf_dir):
    return _triangles(spark, sf_dir).select("id", F.round(geom.longest_edge_angle(F.col("ring")), 6).alias("angle"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_custkey % 5 WHEN 0 THEN 'D 619' WHEN 1 THEN 'D 116' WHEN 2 THEN 'A 1' END AS ref, o_orderkey % 6 AS n FROM orders), f AS (SELECT ref, min(id) AS id FROM r WHERE ref IN ('D 619', 'D 116') AND n > 3 GROUP BY 1)
SELECT f.ref, id, n // 2 AS at FROM f JOIN r USING (id)""")
def road_shields(spark, sf_dir):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    line = F.transform(F.sequence(F.lit(1).cast("long"), k % 6), lambda i: geom.point(i - 1, k))
    rows = fx.table(spark, sf_dir, "orders").where(k % 6 > 0).select(k.alias("ord"), F.when(c % 5 == 0, "D 619").when(c % 5 == 1, "D 116").when(c % 5 == 2, "A 1").alias("ref"), line.alias("line"))
    out = labels.shields(rows, ("D 619", "D 116"))
    return out.select(F.col("name").alias("ref"), F.col("p.z").cast("long").alias("id"), F.col("p.x").cast("long").alias("at"))


@query("SELECT n_name AS name, TRUE AS own FROM nation UNION ALL SELECT name, FALSE FROM (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE (SELECT min(n_name) FROM nation) END AS name FROM customer) WHERE name NOT IN (SELECT n_name FROM nation)")
def name_anti(spark, sf_dir):
    nations = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("own"))
    least = nations.agg(F.min("name").alias("least"))
    more = fx.table(spark, sf_dir, "customer").crossJoin(least).select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("least")).alias("name"), F.lit(False).alias("own"))
    return labels.new_names(nations, more).select("name", "own")


@query("SELECT n_nationkey AS ord, n_regionkey = 1 AS major, row_number() OVER (ORDER BY CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END, n_nationkey) AS place FROM nation")
def label_order(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), (F.col("n_regionkey") == 1).alias("major"))
    return labels.in_order(rows).withColumn("place", F.row_number().over(Window.orderBy(F.desc("major"), "ord")).cast("long"))


@query(f"{fx.sql('pt')}, c AS (SELECT floor(x / 7 + 0.5) AS i, floor(z / 7 + 0.5) AS j, min(point_id) AS ord FROM pt GROUP BY 1, 2), r AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rn FROM c) SELECT ord FROM r WHERE rn <= 3200")
def tree_cells(spark, sf_dir):
    rows = fx.points(spark, sf_dir).select(F.col("point_id").alias("ord"), F.lit(False).alias("real"), "p")
    return landuse.planted(rows).select("ord")


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER w AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_id, n, dt FROM n WHERE n > 15""")
def frame_lag(spark, sf_dir):
    rows = numbered(fx.table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))), ["event_type"], ["ts", "event_id"])
    return quality.frame_intervals(rows, ["event_type"], "n", "t").select("event_id", "n", "dt")


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, n, round(m, 6) AS mean, v[CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT) + 1] AS median, v[CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS p95 FROM s""")
def interval_stats(spark, sf_dir):
    return quality.interval_statistics(fx.table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans, (SELECT max(l_quantity) FROM lineitem) AS most, (SELECT count(*) FROM part WHERE p_size <= 0 OR p_size >= 51) AS odd_sizes""")
def dq_counts(spark, sf_dir):
    customers, orders = fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "orders")
    lost = quality.missing(orders.select(F.col("o_custkey").alias("k")), customers.select(F.col("c_custkey").alias("k")), "k")
    orphans = orders.join(lost, orders["o_custkey"] == lost["k"], "left_semi").agg(F.count("*").alias("orphans"))
    most = fx.table(spark, sf_dir, "lineitem").agg(F.max("l_quantity").alias("most"))
    odd = fx.table(spark, sf_dir, "part").agg(F.count_if((F.col("p_size") <= 0) | (F.col("p_size") >= 51)).alias("odd_sizes"))
    return customers.agg(F.count("*").alias("customers")).crossJoin(orphans).crossJoin(most).crossJoin(odd)  # one row each


@query("SELECT count(*) AS violations FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey IS NULL")
def dq_names(spark, sf_dir):
    nation, region = fx.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")), fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    return quality.missing(nation, region, "k").agg(F.count("*").alias("violations"))


@query(f"{fx.sql('a')} SELECT a_id, (x1 - x0) * (z1 - z0) AS area FROM a WHERE (x1 - x0) * (z1 - z0) >= 250")
def dq_areas(spark, sf_dir):
    a, _ = fx.footprints(spark, sf_dir, polygons=True)
    return quality.bad_areas(a.withColumn("ring", F.col("a_poly")[0]), "ring", 250.0).select("a_id", "area")


@query(f"{fx.sql('pt')} SELECT point_id FROM pt WHERE x < 9.99 OR x > 990.01 OR z < 9.99 OR z > 990.01")
def dq_extent(spark, sf_dir):
    return quality.outside(fx.points(spark, sf_dir), _extent(10, 990, 10, 990)).select("point_id")
