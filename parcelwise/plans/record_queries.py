"""Queries of the catalogue as a whole, labels, scenes and surfaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem
from parcelwise.operators import catalogue, labels, landuse, match, profile, spatial, surfaces
from parcelwise.plans import fixtures as fx
from parcelwise.plans.attribute_queries import _BUILD, _KIND, _PROFILE, _buildings
from parcelwise.plans.feature_queries import _GROUP, _extent
from parcelwise.sources import geojson

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# --- The catalogue: roads of orders (three quarters of them inside), points of suppliers, areas of nations, zones of regions, buildings of customers,
# landmarks of parts, in an extent of 50 to 950.
_EXTENT = (50, 950, 50, 950)


def _catalogue(spark, sf_dir):
    s, n, r, c, k = (F.col(x) for x in ("s_suppkey", "n_nationkey", "r_regionkey", "c_custkey", "p_partkey"))
    points = fx.table(spark, sf_dir, "supplier").select(
        s.alias("ord"), F.concat(F.lit("node/"), s).alias("id"), F.when(s % 6 > 0, F.concat(F.lit(" L"), s % 6)).alias("name"), F.when(s % 3 == 0, "hamlet").alias("place"), geom.point(s * 53 % 1000, s * 29 % 1000).alias("p"))
    box = lambda x, z, w, h: F.array(geom.rectangle(x, z, x + w, z + h))
    areas = fx.table(spark, sf_dir, "nation").select(n.alias("ord"), F.concat(F.lit("area/"), n).alias("id"), F.when(n % 4 > 0, F.col("n_name")).alias("name"), box((n % 5) * 200 + 10, F.floor(n / 5) * 200 + 10, 170, 150).alias("poly"))
    zones = fx.table(spark, sf_dir, "region").select(r.alias("ord"), F.concat(F.lit("zone/"), r).alias("id"), F.col("r_name").alias("name"), F.when(r % 2 == 0, "Zone industrielle").alias("nature"), box(r * 150 + 20, r * 120 + 20, 400, 300).alias("poly"))
    tags = F.map_from_entries(F.array_compact(F.array(F.when(c % 5 == 0, F.struct(F.lit("name").alias("k"), F.concat(F.lit("L"), c % 6).alias("v"))), F.when(c % 7 == 0, F.struct(F.lit("amenity").alias("k"), F.lit("school").alias("v"))))))
    side = F.when(c % 13 == 0, 1).otherwise(4)
    buildings = fx.table(spark, sf_dir, "customer").select(
        c.alias("ord"), F.concat(F.lit("way/"), c).alias("id"), tags.alias("tags"), box(c * 37 % 900 + 20, c * 91 % 900 + 20, side, side + c % 3).alias("poly"), F.when(c % 11 == 0, F.concat(F.lit("Mark "), c % 4)).alias("landmark"))
    marks = fx.table(spark, sf_dir, "part").select(
        k.alias("ord"), F.concat(F.lit("mark/"), k).alias("id"), F.concat(F.lit("L"), k % 9).alias("name"), F.when(k % 2 == 0, "Mairie").alias("kind"), geom.point(k * 13 % 1000, k * 7 % 990).alias("p"))
    o = F.col("id")
    moved = lambda p: geom.point(p["x"] - o * 3 + (o % 120) * 10 + 5, p["z"] + 60)  # noqa: E731  whole roads in the extent, or outside
    roads = fx.roads(spark, sf_dir).withColumn("paths", F.transform("paths", lambda path: F.transform(path, moved)))
    return catalogue.build(roads, points, areas, zones, buildings, marks, _extent(*_EXTENT))


_CLIP = "greatest(x0, 50) + least(x0 + w, 950) AS x2, greatest(z0, 50) + least(z0 + h, 950) AS z2"
_CATALOGUE = _GROUP.replace("WITH ", "WITH RECURSIVE ", 1).replace("FROM road)", "FROM road WHERE (id % 120) * 10 + 5 BETWEEN 50 AND 950)") + f""",
gl AS (SELECT key, max_by(id, n * 100000000 + ord) AS best, max(n) AS n FROM k GROUP BY 1),
gr AS (SELECT key AS id, min(title) AS name, CASE WHEN key LIKE 'road:%' THEN 'Rue / voie' ELSE 'Voie ferrée' END AS kind, 'OpenStreetMap' AS source, 'line' AS type,
    CAST((min(best) % 120) * 10 + 5 + min(gl.n) // 2 AS DOUBLE) AS x, CAST(60 + min(best) % 100 + (min(gl.n) // 2) * (min(gl.n) // 2) AS DOUBLE) AS z, min(k.ord) AS ord FROM k JOIN gl USING (key) GROUP BY key),
pt AS (SELECT s_suppkey AS sid, 'L' || (s_suppkey % 6) AS name, s_suppkey % 3 = 0 AS hamlet, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 1000 AS DOUBLE) AS z FROM supplier WHERE s_suppkey % 6 > 0),
pi AS (SELECT * FROM pt WHERE x BETWEEN 50 AND 950 AND z BETWEEN 50 AND 950),
sp AS (SELECT 'node/' || sid AS id, name, CASE WHEN hamlet THEN 'Lieu-dit / secteur' ELSE 'Lieu / équipement' END AS kind, 'OpenStreetMap' AS source, 'point' AS type, x, z, sid AS ord FROM pi),
ar AS (SELECT n_nationkey AS n, n_name, (n_nationkey % 5) * 200 + 10 AS x0, (n_nationkey // 5) * 200 + 10 AS z0, 170 AS w, 150 AS h FROM nation WHERE n_nationkey % 4 > 0),
su AS (SELECT 'area/' || n AS id, n_name AS name, 'Zone / lieu' AS kind, 'OpenStreetMap' AS source, 'zone' AS type, x2 / 2 AS x, z2 / 2 AS z, n AS ord FROM (SELECT *, {_CLIP} FROM ar)),
zo AS (SELECT 'zone/' || r AS id, name, kind, 'IGN BD TOPO' AS source, 'zone' AS type, x2 / 2 AS x, z2 / 2 AS z, r + 1099511627776 AS ord
    FROM (SELECT *, {_CLIP} FROM (SELECT r_regionkey AS r, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'Zone industrielle' ELSE 'Zone / lieu' END AS kind, r_regionkey * 150 + 20 AS x0, r_regionkey * 120 + 20 AS z0, 400 AS w, 300 AS h FROM region))),
bu AS (SELECT c_custkey AS c, c_custkey * 37 % 900 + 20 AS x0, c_custkey * 91 % 900 + 20 AS z0, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 4 END AS w, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 4 END + c_custkey % 3 AS h,
    CASE WHEN c_custkey % 5 = 0 THEN 'L' || (c_custkey % 6) END AS tag, CASE WHEN c_custkey % 11 = 0 THEN 'Mark ' || (c_custkey % 4) END AS mark, c_custkey % 7 = 0 AS school FROM customer),
ho AS (SELECT 'way/' || c AS id, coalesce(tag, mark, 'École primaire') AS name, 'Bâtiment / équipement' AS kind, CASE WHEN tag IS NOT NULL THEN 'OpenStreetMap' WHEN mark IS NOT NULL THEN 'IGN BD TOPO' ELSE 'Type d’équipement OpenStreetMap' END AS source, 'building' AS type,
    x0 + w / 2 AS x, z0 + h / 2 AS z, c + 2199023255552 AS ord FROM bu WHERE w * h >= 3 AND (tag IS NOT NULL OR mark IS NOT NULL OR school)),
known AS (SELECT id FROM sp UNION ALL SELECT id FROM su UNION ALL SELECT id FROM zo UNION ALL SELECT id FROM ho),
hi AS (SELECT pi.sid, pi.name, min(c) AS c FROM pi JOIN bu ON pi.x >= x0 AND pi.x < x0 + w AND pi.z >= z0 AND pi.z < z0 + h WHERE NOT hamlet GROUP BY 1, 2 HAVING count(*) = 1),
fo AS (SELECT 'way/' || c AS id, name, 'Bâtiment / équipement' AS kind, 'OpenStreetMap' AS source, 'building' AS type, x0 + w / 2 AS x, z0 + h / 2 AS z, sid + 3298534883328 AS ord
    FROM (SELECT c, min(sid) AS sid, min_by(name, sid) AS name FROM hi WHERE 'way/' || c NOT IN (SELECT id FROM known) GROUP BY 1) JOIN bu USING (c)),
base AS (SELECT * FROM gr UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM su UNION ALL SELECT * FROM zo UNION ALL SELECT * FROM ho UNION ALL SELECT * FROM fo),
ma AS (SELECT p_partkey AS k, 'mark/' || p_partkey AS id, 'L' || (p_partkey % 9) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Mairie' ELSE 'Lieu / équipement' END AS kind, CAST(p_partkey * 13 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 7 % 990 AS DOUBLE) AS z FROM part),
mi AS (SELECT * FROM ma WHERE x BETWEEN 50 AND 950 AND z BETWEEN 50 AND 950),
ne AS (SELECT mi.id, min_by(b.id, b.ord) AS record_id FROM mi JOIN base b ON b.type <> 'line' AND b.name = mi.name AND sqrt((b.x - mi.x) * (b.x - mi.x) + (b.z - mi.z) * (b.z - mi.z)) < 45 GROUP BY 1),
nw AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS rn FROM mi WHERE id NOT IN (SELECT id FROM ne)),
gd AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id VARCHAR, x DOUBLE, z DOUBLE)[]) AS acc FROM nw
    UNION ALL SELECT gd.name, nw.rn, CASE WHEN len(list_filter(acc, lambda a: sqrt((a.x - nw.x) * (a.x - nw.x) + (a.z - nw.z) * (a.z - nw.z)) < 45)) = 0 THEN list_append(acc, {{'id': nw.id, 'x': nw.x, 'z': nw.z}}) ELSE acc END
    FROM gd JOIN nw ON nw.name = gd.name AND nw.rn = gd.rn + 1),
ac AS (SELECT name, max_by(acc, rn) AS acc FROM gd GROUP BY 1),
tw AS (SELECT nw.id, list_filter(acc, lambda a: sqrt((a.x - nw.x) * (a.x - nw.x) + (a.z - nw.z) * (a.z - nw.z)) < 45)[1].id AS record_id FROM nw JOIN ac USING (name)),
ex AS (SELECT id, name, kind, 'IGN BD TOPO' AS source, 'point' AS type, x, z, k + 4398046511104 AS ord FROM nw JOIN tw USING (id) WHERE id = record_id),
rec AS (SELECT * FROM base UNION ALL SELECT * FROM ex)
"""


@query(_CATALOGUE + "SELECT id, name, kind, source, type, round(x, 6) AS x, round(z, 6) AS z FROM rec")
def catalogue_records(spark, sf_dir):
    records, _ = _catalogue(spark, sf_dir)
    return records.select("id", "name", "kind", "source", "type", F.round("position.x", 6).alias("x"), F.round("position.z", 6).alias("z"))


@query(_CATALOGUE + """, own AS (SELECT id, id AS record_id, ord FROM rec UNION ALL SELECT CAST(k.id AS VARCHAR), k.key, gr.ord FROM k JOIN gr ON gr.id = k.key)
SELECT id, max_by(record_id, ord) AS record_id FROM own GROUP BY 1 UNION ALL SELECT id, record_id FROM ne UNION ALL SELECT id, record_id FROM tw WHERE id <> record_id""")
def catalogue_aliases(spark, sf_dir):
    return _catalogue(spark, sf_dir)[1]


@query(f"""{fx.sql('pt', 'zone', 'hit')}, h AS (SELECT point_id, min(ord) AS ord FROM hit GROUP BY 1), o AS (SELECT ord, max(point_id) AS point_id FROM h GROUP BY 1)
SELECT zone.ord AS id, CASE WHEN point_id IS NULL THEN 'old' WHEN point_id % 3 > 0 THEN 'school' ELSE 'townhall' END AS amenity, CASE WHEN point_id IS NULL THEN 'zone' WHEN point_id % 2 = 0 THEN 'n' || point_id END AS name, 'yes' AS building FROM zone LEFT JOIN o USING (ord)""")
def landmark_override(spark, sf_dir):
    """The last amenity that lies in a building sets its amenity and its name, even to none."""
    pairs = [("amenity", "old"), ("name", "zone"), ("building", "yes")]
    tags = F.create_map(*[F.lit(x) for p in pairs for x in p])
    buildings = fx.zones(spark, sf_dir).select(F.col("ord").alias("id"), "ord", tags.alias("tags"), "poly")
    i = F.col("point_id")
    amenities = fx.points(spark, sf_dir).select("point_id", i.alias("ord_p"), "p", F.when(i % 3 > 0, "school").otherwise("townhall").alias("amenity"), F.when(i % 2 == 0, F.concat(F.lit("n"), i)).alias("name"))
    out = catalogue.landmark_override(buildings, amenities)
    return out.select("id", *[F.col("tags")[k].alias(k) for k in ("amenity", "name", "building")])


# --- Labels of several sources.
_LABELS = f"""
b AS (SELECT id, name, x, z, kind FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'church' WHEN p_partkey % 9 = 1 THEN 'public' ELSE 'house' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'M' || (p_partkey % 40) END AS mark, CASE WHEN p_partkey % 5 = 0 THEN 'T' || (p_partkey % 30) END AS tag,
    CASE p_partkey % 7 WHEN 0 THEN 'townhall' WHEN 1 THEN 'school' WHEN 2 THEN 'pub' END AS amenity, CAST(p_partkey * 17 % 3000 AS DOUBLE) AS x, CAST(p_partkey * 23 % 3000 AS DOUBLE) AS z, coalesce(mark, tag, CASE amenity WHEN 'townhall' THEN 'Mairie' WHEN 'school' THEN 'École primaire' END) AS name
    FROM part WHERE p_partkey <= 200) WHERE kind IN ('church', 'public') AND name IS NOT NULL),
l0 AS (SELECT 'building' AS source, name, x, z, FALSE AS major FROM b),
pl AS (SELECT c_custkey AS ord, 'T' || (c_custkey % 50) AS name, CAST(c_custkey * 31 % 3000 AS DOUBLE) AS x, CAST(c_custkey * 7 % 3000 AS DOUBLE) AS z, c_custkey % 4 = 0 AS major FROM customer WHERE c_custkey <= 150),
l1 AS (SELECT 'place' AS source, name, min_by(x, ord) AS x, min_by(z, ord) AS z, min_by(major, ord) AS major FROM pl WHERE name NOT IN (SELECT name FROM l0) GROUP BY name),
m AS (SELECT s_suppkey AS ord, 'S' || s_suppkey AS name, CAST(s_suppkey * 41 % 3000 AS DOUBLE) AS x, CAST(s_suppkey * 13 % 900 AS DOUBLE) AS z FROM supplier),
l01 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
fr AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM m WHERE NOT EXISTS (SELECT 1 FROM l01 WHERE sqrt((l01.x - m.x) * (l01.x - m.x) + (l01.z - m.z) * (l01.z - m.z)) < 45)),
gd AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(name VARCHAR, x DOUBLE, z DOUBLE)[]) AS acc
    UNION ALL SELECT fr.rn, CASE WHEN len(list_filter(acc, lambda a: sqrt((a.x - fr.x) * (a.x - fr.x) + (a.z - fr.z) * (a.z - fr.z)) < 45)) = 0 THEN list_append(acc, {{'name': fr.name, 'x': fr.x, 'z': fr.z}}) ELSE acc END FROM gd JOIN fr ON fr.rn = gd.rn + 1),
l2 AS (SELECT 'landmark' AS source, a.name, a.x, a.z, FALSE AS major FROM (SELECT unnest(max_by(acc, rn)) AS a FROM gd)),
am AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 3 = 0 THEN 'T' || (o_orderkey % 60) END AS tag, CASE o_orderkey % 5 WHEN 0 THEN 'townhall' WHEN 1 THEN 'community_centre' WHEN 2 THEN 'school' END AS amenity, CASE o_orderkey % 7 WHEN 0 THEN 'hamlet' WHEN 1 THEN 'farm' END AS place,
    CAST(o_orderkey % 3000 AS DOUBLE) AS x, CAST(o_orderkey * 3 % 3000 AS DOUBLE) AS z FROM orders),
an AS (SELECT ord, coalesce(tag, CASE amenity WHEN 'townhall' THEN 'Mairie' WHEN 'school' THEN 'École' ELSE 'Salle communale' END) AS name, x, z, place IS NOT NULL AS major FROM am WHERE place = 'hamlet' OR amenity IS NOT NULL),
l3 AS (SELECT 'point' AS source, name, min_by(x, ord) AS x, min_by(z, ord) AS z, min_by(major, ord) AS major FROM an WHERE name NOT IN (SELECT name FROM l01 UNION ALL SELECT name FROM l2) GROUP BY name),
sh AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'D 619' WHEN 1 THEN 'D 116' ELSE 'A 1' END AS name, s_suppkey AS ord, s_suppkey % 6 AS n, CAST(s_suppkey + (s_suppkey % 6) // 2 AS DOUBLE) AS x, CAST((s_suppkey % 6) // 2 AS DOUBLE) AS z FROM supplier WHERE s_suppkey % 6 > 3),
l4 AS (SELECT 'shield' AS source, name, min_by(x, ord) AS x, min_by(z, ord) AS z, FALSE AS major FROM sh WHERE name LIKE 'D%' GROUP BY name)
"""


@query("WITH RECURSIVE" + _LABELS + "SELECT * FROM l01 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4")
def label_sources(spark, sf_dir):
    """Labels of buildings, places, landmarks, points and road numbers, each new to those before."""
    k, c, s, o = (F.col(x) for x in ("p_partkey", "c_custkey", "s_suppkey", "o_orderkey"))
    kind = F.when(k % 9 == 0, "church").when(k % 9 == 1, "public").otherwise("house")
    amenity = F.when(k % 7 == 0, "townhall").when(k % 7 == 1, "school").when(k % 7 == 2, "pub")
    named = labels.building_label(kind, F.when(k % 4 == 0, F.concat(F.lit("M"), k % 40)), F.when(k % 5 == 0, F.concat(F.lit("T"), k % 30)), amenity)
    buildings = fx.table(spark, sf_dir, "part").where("p_partkey <= 200").select(k.alias("ord"), named.alias("name"), geom.point(k * 17 % 3000, k * 23 % 3000).alias("p")).where("name is not null")
    places = fx.table(spark, sf_dir, "customer").where("c_custkey <= 150").select(c.alias("ord"), F.concat(F.lit("T"), c % 50).alias("name"), geom.point(c * 31 % 3000, c * 7 % 3000).alias("p"), (c % 4 == 0).alias("major"))
    marks = fx.table(spark, sf_dir, "supplier").select(s.alias("ord"), s.alias("id"), F.concat(F.lit("S"), s).alias("name"), geom.point(s * 41 % 3000, s * 13 % 900).alias("p"))
    points = fx.table(spark, sf_dir, "orders").select(
        o.alias("ord"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("T"), o % 60)).alias("name"), F.when(o % 5 == 0, "townhall").when(o % 5 == 1, "community_centre").when(o % 5 == 2, "school").alias("amenity"),
        F.when(o % 7 == 0, "hamlet").when(o % 7 == 1, "farm").alias("place"), geom.point(o % 3000, o * 3 % 3000).alias("p"))
    path = F.transform(F.sequence(F.lit(0).cast("long"), s % 6 - 1), lambda i: geom.point(s + i, i))
    roads = fx.table(spark, sf_dir, "supplier").where("s_suppkey % 6 > 0").select(s.alias("ord"), F.when(s % 3 == 0, "D 619").when(s % 3 == 1, "D 116").otherwise("A 1").alias("ref"), path.alias("line"))
    out = labels.joined(buildings, places, marks, points, labels.shields(roads, ("D 619", "D 116")))
    return out.select("source", "name", "p.x", "p.z", "major")


_FIT = """r AS (SELECT s_suppkey % 4 AS view_id, s_suppkey AS id, s_name AS name, s_suppkey % 5 = 0 AS major, s_suppkey % 3 = 0 AS local, s_suppkey * 40.0 AS distance, CAST(s_suppkey * 53 % 1400 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 900 AS DOUBLE) AS y FROM supplier),
s AS (SELECT *, length(name) * 7 + 20 AS w, row_number() OVER (PARTITION BY view_id ORDER BY major DESC, id) AS rn FROM r WHERE (NOT local OR distance < 2200) AND x > 20 AND x < 1260 AND y > 135 AND y < 720),
g AS (SELECT DISTINCT view_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w BIGINT)[]) AS acc FROM s
    UNION ALL SELECT g.view_id, s.rn, CASE WHEN len(list_filter(acc, lambda a: abs(a.x - s.x) < (a.w + s.w) / 2 AND abs(a.y - s.y) < 30)) = 0 THEN list_append(acc, {'id': s.id, 'x': s.x, 'y': s.y, 'w': s.w}) ELSE acc END FROM g JOIN s ON s.view_id = g.view_id AND s.rn = g.rn + 1),
v AS (SELECT view_id, unnest(max_by(acc, rn)).id AS id FROM g GROUP BY 1)"""


@query(f"WITH RECURSIVE {_FIT} SELECT r.view_id, r.id, v.id IS NOT NULL AS visible FROM r LEFT JOIN v USING (view_id, id)")
def label_fit(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = fx.table(spark, sf_dir, "supplier").select((s % 4).alias("view_id"), s.alias("id"), s.alias("ord"), F.col("s_name").alias("name"), (s % 5 == 0).alias("major"), (s % 3 == 0).alias("local"), (s * 40.0).alias("distance"), (s * 53 % 1400).cast("double").alias("x"), (s * 29 % 900).cast("double").alias("y"))
    return labels.fitting(rows, 1280.0, 800.0)


# --- Planting.
def _draw(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({' || \":\" || '.join(parts)}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496".replace('"', "'")


_GRID = f"""jit AS (SELECT *, x0 + (i + {_draw('ord', 'i', 'j', "'0'")}) * step AS x, z0 + (j + {_draw('ord', 'i', 'j', "'1'")}) * step AS z, {_draw('ord', 'i', 'j', "'2'")} AS u, {_draw('ord', 'i', 'j', "'3'")} AS v FROM cell),
ins AS (SELECT * FROM jit WHERE x >= x0 AND x < x0 + w AND z >= z0 AND z < z0 + h AND NOT (hole > 0 AND x >= x0 + hole AND x < x0 + w - hole AND z >= z0 + hole AND z < z0 + h - hole))"""
_CELL = "cell AS (SELECT *, unnest(range(0, CAST(ceil(h / step) AS BIGINT))) AS j FROM (SELECT *, unnest(range(0, CAST(ceil(w / step) AS BIGINT))) AS i FROM stepped))"


@query(f"{fx.sql('zone')}, stepped AS (SELECT *, CAST(38 AS DOUBLE) AS step FROM zone), {_CELL}, {_GRID} SELECT ord AS id, i, j, round(x, 6) AS x, round(z, 6) AS z, round(5 + v * 5, 6) AS height FROM ins WHERE u > 0.48")
def garden_points(spark, sf_dir):
    shapes = fx.zones(spark, sf_dir).withColumn("id", F.col("ord"))
    return landuse.garden_candidates(shapes).select("id", "i", "j", F.round("p.x", 6).alias("x"), F.round("p.z", 6).alias("z"), F.round("height", 6).alias("height"))


_WOOD = f"""d AS (SELECT *, ord % 3 = 0 AS scrub, ord % 4 = 1 AS poplar, ord % 2 = 1 AS late, least(sqrt((x0 + w / 2) * (x0 + w / 2) + (z0 + h / 2) * (z0 + h / 2)), sqrt((x0 + w / 2 - 1150) * (x0 + w / 2 - 1150) + (z0 + h / 2 + 600) * (z0 + h / 2 + 600))) AS dist FROM zone),
stepped AS (SELECT *, CASE WHEN scrub THEN 62 WHEN dist < 1100 THEN 42 WHEN dist < 1900 THEN 60 ELSE 83 END::DOUBLE AS step, row_number() OVER (ORDER BY dist, CASE WHEN late THEN 0 ELSE 1 END, CASE WHEN late THEN -ord ELSE ord END) AS place FROM d), {_CELL}, {_GRID}"""


@query(f"{fx.sql('zone')}, {_WOOD} SELECT ord AS id, i, j, place, round(x, 6) AS x, round(z, 6) AS z, round(CASE WHEN scrub THEN 4 + v * 4 WHEN poplar THEN 13 + v * 5 ELSE 9 + v * 7 END, 6) AS height FROM ins")
def woodland_points(spark, sf_dir):
    """Woods in the order of their distance, the later source's first and reversed, with step and height."""
    o = F.col("ord")
    woods = fx.zones(spark, sf_dir).select(o.alias("id"), "ord", "poly", (o % 3 == 0).alias("scrub"), (o % 4 == 1).alias("poplar"), (o % 2 == 1).alias("added"))
    return landuse.wood_candidates(landuse.wood_order(woods)).select("id", "i", "j", "place", F.round("p.x", 6).alias("x"), F.round("p.z", 6).alias("z"), F.round("height", 6).alias("height"))


_TREES = f"""real AS (SELECT s_suppkey AS id, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 1000 AS DOUBLE) AS z FROM supplier),
stepped AS (SELECT *, CAST(38 AS DOUBLE) AS step FROM zone), {_CELL}, {_GRID},
gard AS (SELECT ord, i, j, x, z FROM ins WHERE u > 0.48),
every AS (SELECT 'real' AS source, id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, x, z, id AS k FROM real UNION ALL SELECT 'garden', ord, i, j, x, z, 1000000000 + ord * 1000000 + i * 1000 + j FROM gard),
blk AS (SELECT CAST(c_custkey * 37 % 900 + 20 AS DOUBLE) AS x0, CAST(c_custkey * 91 % 900 + 20 AS DOUBLE) AS z0 FROM customer WHERE c_custkey <= 300),
lin AS (SELECT CAST(n_nationkey * 40 + 5 AS DOUBLE) AS zz FROM nation),
open AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM blk WHERE e.x >= x0 AND e.x < x0 + 12 AND e.z >= z0 AND e.z < z0 + 9) AND NOT EXISTS (SELECT 1 FROM lin WHERE e.x BETWEEN 100 AND 800 AND abs(e.z - zz) < 5.5)
    AND NOT EXISTS (SELECT 1 FROM lin WHERE (e.x < 100 AND sqrt((e.x - 100) * (e.x - 100) + (e.z - zz) * (e.z - zz)) < 5.5) OR (e.x > 800 AND sqrt((e.x - 800) * (e.x - 800) + (e.z - zz) * (e.z - zz)) < 5.5))),
cel AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 7 + 0.5), floor(z / 7 + 0.5) ORDER BY k) AS rn FROM open),
one AS (SELECT * FROM cel WHERE rn = 1),
lim AS (SELECT *, row_number() OVER (ORDER BY k) AS place FROM one WHERE source <> 'real')
SELECT source, id, i, j, round(x, 6) AS x, round(z, 6) AS z FROM one WHERE source = 'real' UNION ALL SELECT source, id, i, j, round(x, 6), round(z, 6) FROM lim WHERE place <= 150 - (SELECT count(*) FROM one WHERE source = 'real')"""


@query(f"{fx.sql('zone')}, {_TREES}")
def planted_trees(spark, sf_dir):
    """Real trees and garden ones where nothing stands, the first of each cell, capped."""
    s, c, n = F.col("s_suppkey"), F.col("c_custkey"), F.col("n_nationkey")
    real = fx.table(spark, sf_dir, "supplier").select(F.lit("real").alias("source"), s.alias("id"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), geom.point(s * 53 % 1000, s * 29 % 1000).alias("p"), F.lit(True).alias("real"), s.alias("ord"))
    made = landuse.garden_candidates(fx.zones(spark, sf_dir).withColumn("id", F.col("ord")))
    made = made.select(F.lit("garden").alias("source"), "id", "i", "j", "p", F.lit(False).alias("real"), (F.lit(1_000_000_000) + F.col("ord") * 1_000_000 + F.col("i") * 1000 + F.col("j")).alias("ord"))
    shapes = fx.table(spark, sf_dir, "customer").where("c_custkey <= 300").select(F.array(geom.rectangle(c * 37 % 900 + 20, c * 91 % 900 + 20, c * 37 % 900 + 32, c * 91 % 900 + 29)).alias("poly"))
    lines = fx.table(spark, sf_dir, "nation").select(F.array(geom.point(F.lit(100), n * 40 + 5), geom.point(F.lit(800), n * 40 + 5)).alias("line"), F.lit(2.0).alias("width"))
    free = landuse.unblocked(real.unionByName(made), shapes, lines)
    return landuse.planted(free, 150).select("source", "id", "i", "j", F.round("p.x", 6).alias("x"), F.round("p.z", 6).alias("z"))


# --- Shapes and surfaces.
@query("""WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey % 10 + 5 AS DOUBLE) AS a, CAST(s_suppkey % 7 + 3 AS DOUBLE) AS b, CAST(2 + s_suppkey % 3 AS DOUBLE) AS w FROM supplier),
h AS (SELECT *, w / 2 AS r, sqrt(a * a + b * b) AS d FROM s), q AS (SELECT *, [{'x': CAST(0 AS DOUBLE), 'z': r}, {'x': a - b / d * r, 'z': a / d * r}, {'x': a - r, 'z': b}] AS l, [{'x': CAST(0 AS DOUBLE), 'z': -r}, {'x': a + b / d * r, 'z': -a / d * r}, {'x': a + r, 'z': b}] AS m FROM h),
e AS (SELECT id, w, a, b, unnest([1, 2]) AS k, l, m FROM q),
t AS (SELECT id, min(a) AS a, min(b) AS b, sum(abs((l[k].x * l[k+1].z - l[k+1].x * l[k].z) + (l[k+1].x * m[k+1].z - m[k+1].x * l[k+1].z) + (m[k+1].x * m[k].z - m[k].x * m[k+1].z) + (m[k].x * l[k].z - l[k].x * m[k].z)) / 2) AS area FROM e GROUP BY 1)
SELECT id, 2 AS quads, round(area, 6) AS strip_area, a / 2 AS cx, b / 2 AS cz, 33 AS halo_points, round(16 * 22 * 22 * sin(2 * pi() / 32), 6) AS halo_area, 3 AS open_points FROM t""")
def line_shapes(spark, sf_dir):
    """Strips of two legs, box centres, halos, open rings."""
    s = F.col("s_suppkey")
    a, b = s % 10 + 5, s % 7 + 3
    line = F.array(geom.point(F.lit(0), F.lit(0)), geom.point(a, F.lit(0)), geom.point(a, b))
    rows = fx.table(spark, sf_dir, "supplier").select(s.alias("id"), line.alias("line"), geom.strip(line, 2.0).alias("two"), geom.strip(line, 3.0).alias("three"), geom.strip(line, 4.0).alias("four"))
    quads = F.when(s % 3 == 0, F.col("two")).when(s % 3 == 1, F.col("three")).otherwise(F.col("four"))
    rows = rows.withColumn("s_suppkey", F.col("id")).withColumn("quads", quads).withColumn("halo", geom.halo(F.col("line")[1]))
    total = F.aggregate(F.transform("quads", geom.area), F.lit(0.0), lambda n, v: n + v)
    centre = geom.centre(F.col("line"))
    return rows.select("id", F.size("quads").alias("quads"), F.round(total, 6).alias("strip_area"), centre["x"].alias("cx"), centre["z"].alias("cz"), F.size("halo").alias("halo_points"), F.round(geom.area(F.col("halo")), 6).alias("halo_area"), F.size(geom.open_ring(F.concat("line", F.slice("line", 1, 1)))).alias("open_points"))


@query(f"""WITH {_BUILD.replace("b AS (SELECT", "b0 AS (SELECT", 1)}, b AS (SELECT *, least(w, d) AS narrow, greatest(w, d) AS wide FROM b0), {_KIND}, {_PROFILE.split(_KIND + ",")[1].replace("FROM u)", "FROM u)", 1)}
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN kind = 'canopy' THEN 0 ELSE 6 END AS quads, round(CASE WHEN kind = 'canopy' THEN 0 ELSE 2 * narrow * (wall + roof / 2) + 2 * wide * wall END, 5) AS wall_area, round(size / 2, 6) AS left_area, round(size / 2, 6) AS right_area, round(0.35 + wall + roof, 6) AS top FROM o WHERE size >= 3 AND size <= 100000""")
def building_surfaces(spark, sf_dir):
    """Walls up to the roof's slope, cut at the ridge, and the roof's two halves."""
    rows = _buildings(spark, sf_dir)
    out = surfaces.of(rows.select("id", "ring"), profile.building_profiles(rows))
    area = F.aggregate(F.transform("walls", surfaces.quad_area), F.lit(0.0), lambda n, v: n + v)
    return out.select("id", F.size("walls").alias("quads"), F.round(area, 5).alias("wall_area"), *[F.round(geom.area(F.col(c)), 6).alias(f"{c}_area") for c in ("left", "right")], F.round("top", 6).alias("top"))


@query(f"""WITH {_BUILD.replace("b AS (SELECT", "b0 AS (SELECT", 1)}, b AS (SELECT *, least(w, d) AS narrow, greatest(w, d) AS wide FROM b0), {_KIND}, {_PROFILE.split(_KIND + ",")[1].replace("FROM u)", "FROM u)", 1)}
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN kind = 'canopy' THEN 0 ELSE 12 END AS wall_triangles, round(CASE WHEN kind = 'canopy' THEN 0 ELSE 2 * narrow * (wall + roof / 2) + 2 * wide * wall END, 5) AS wall_area,
    round(2 * wide * sqrt(narrow * narrow / 4 + roof * roof), 5) AS roof_area, round(0.35 + wall + roof, 6) AS top FROM o WHERE size >= 3 AND size <= 100000""")
def surface_triangles(spark, sf_dir):
    """The triangles of walls and roofs, a row each, summed up a building."""
    rows = _buildings(spark, sf_dir)
    found = surfaces.triangles(surfaces.of(rows.select("id", "ring"), profile.building_profiles(rows)))
    wall, area = F.col("part") == "wall", surfaces.triangle_area(F.col("a"), F.col("b"), F.col("c"))
    top = F.max(F.greatest("a.y", "b.y", "c.y"))
    return found.groupBy("id").agg(F.count_if(wall).alias("wall_triangles"), F.round(F.sum(F.when(wall, area).otherwise(0.0)), 5).alias("wall_area"), F.round(F.sum(F.when(~wall, area)), 5).alias("roof_area"), F.round(top, 6).alias("top"))


@query("""WITH s AS (SELECT c_custkey AS id, c_custkey % 4 AS k, CAST(5 + c_custkey % 7 AS DOUBLE) AS h FROM customer)
SELECT id, CASE k WHEN 0 THEN 8 WHEN 2 THEN 4 ELSE 2 END AS triangles, CASE k WHEN 0 THEN 4 * h * h - 4 WHEN 1 THEN 2 * h * h WHEN 2 THEN 3 * h * h ELSE 4 * h * h END AS area,
    CASE k WHEN 0 THEN h - 1 WHEN 1 THEN h * h WHEN 2 THEN h * h / 2 ELSE 2 * h * h END AS smallest, CASE k WHEN 0 THEN h * (h - 1) WHEN 1 THEN h * h WHEN 2 THEN h * h ELSE 2 * h * h END AS largest FROM s""")
def triangulation(spark, sf_dir):
    """Polygons with a yard, on a corner, with a notch, and plain ones that turn the other way, as triangles."""
    c = F.col("c_custkey")
    h = (5 + c % 7).cast("double")
    ring = lambda *points: F.array(*[geom.point(x if hasattr(x, "cast") else F.lit(x), z if hasattr(z, "cast") else F.lit(z)) for x, z in points])
    yard = F.array(geom.rectangle(-h, -h, h, h), geom.rectangle(F.lit(-1), F.lit(-1), F.lit(1), F.lit(1)))
    corner, notch, plain = ring((-h, 0), (0, -h), (h, 0), (0, h), (-h, 0)), ring((0, 0), (2 * h, 0), (2 * h, h), (h, h), (h, 2 * h), (0, 2 * h)), ring((-h, -h), (-h, h), (h, h), (h, -h))
    poly = F.when(c % 4 == 0, yard).when(c % 4 == 1, F.array(corner)).when(c % 4 == 2, F.array(notch)).otherwise(F.array(plain))
    rows = fx.table(spark, sf_dir, "customer").select(c.alias("id"), F.explode(geom.triangles(poly)).alias("t"))
    return rows.groupBy("id").agg(F.count("*").alias("triangles"), *[f(geom.area(F.col("t"))).alias(n) for f, n in ((F.sum, "area"), (F.min, "smallest"), (F.max, "largest"))])


# --- Enrichment entries.
@query(f"{fx.sql('a')} SELECT a_id, (x1 - x0) * (z1 - z0) * CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS area FROM a WHERE a_id % 4 > 0 AND p_size % 5 > 0")
def in_service(spark, sf_dir):
    """footprints in service, of one or two polygons or none."""
    rows, _ = fx.footprints(spark, sf_dir, polygons=True)
    sizes = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a_id"), "p_size")
    poly, size = F.col("a_poly"), F.col("p_size")
    polys = F.when(size % 5 == 0, F.slice(F.array(poly), 1, 0)).when(size % 3 == 0, F.array(poly, poly)).otherwise(F.array(poly))
    rows = rows.join(sizes, "a_id").select("a_id", F.when(F.col("a_id") % 4 > 0, "En service").otherwise("En projet").alias("state"), polys.alias("polys"))
    return match.in_service(rows).select("a_id", "area")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders WHERE o_orderkey % 3 > 0), m AS (SELECT c_custkey AS c, c_acctbal AS h, c_mktsegment AS usage FROM customer WHERE c_custkey % 2 = 0),
e AS (SELECT id, m.* FROM o JOIN m USING (c)), l AS (SELECT l_orderkey AS id, 'P' || max(l_partkey) AS mark FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 5 = 0 GROUP BY 1)
SELECT coalesce(e.id, l.id) AS id, e.c AS matched, round(CAST(0.5 AS DOUBLE) + e.c % 50 * CAST(0.01 AS DOUBLE), 3) AS iou, e.h AS wall, e.usage, l.mark AS landmark FROM e FULL JOIN l ON l.id = e.id""")
def enrichment_entries(spark, sf_dir):
    """A match's entry as a struct, a landmark added to it, or to a new entry where there is none."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    matched = fx.table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").join(fx.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), F.col("o_custkey") == c)
    rows = matched.select(o.alias("id"), c.alias("source_id"), (F.lit(0.5) + c % 50 * 0.01).alias("iou"), F.lit(0.9).alias("coverage"), F.lit(0.0).alias("runner_up"), F.col("c_acctbal").alias("wall_height"), F.col("c_mktsegment").alias("usage"))
    marks = fx.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_partkey % 5 = 0").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("ord"), F.concat(F.lit("P"), F.col("l_partkey")).alias("name"))
    out = match.annotated(match.entries(rows, ("wall_height", "usage")), marks)
    return out.select("id", F.col("entry.source_id").alias("matched"), F.col("entry.match.iou").alias("iou"), F.col("entry.wall_height").alias("wall"), F.col("entry.usage").alias("usage"), F.col("landmark.name").alias("landmark"))


@query("""WITH s AS (SELECT s_suppkey AS id, CAST(5 + s_suppkey % 7 AS DOUBLE) AS h, CASE WHEN s_suppkey % 2 = 0 THEN CAST(4 AS DOUBLE) ELSE 0 END AS hole FROM supplier), a AS (SELECT *, 4 * h * h - 2 * (h / 2) * (h / 2) - hole AS o, 4 * h * h - hole AS p, 4.5 * h * h AS q FROM s)
SELECT id, round(o, 5) AS overlap, round(o / p, 6) AS coverage, round(o / (p + q - o), 6) AS iou FROM a""")
def overlap_holes(spark, sf_dir):
    """Squares, some with a yard, against squares that stand on a corner."""
    s = F.col("s_suppkey")
    x, h = s * 100.0, (5 + s % 7).cast("double")
    square, yard = geom.rectangle(x - h, -h, x + h, h), geom.rectangle(x - 1, F.lit(-1.0), x + 1, F.lit(1.0))
    a = h * 1.5
    turned = F.array(geom.point(x - a, F.lit(0)), geom.point(x, -a), geom.point(x + a, F.lit(0)), geom.point(x, a), geom.point(x - a, F.lit(0)))
    rows = fx.table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 2 == 0, F.array(square, yard)).otherwise(F.array(square)).alias("a_poly"), F.array(turned).alias("b_poly"))
    side = lambda c: rows.select(F.col("id").alias(f"{c}_id"), f"{c}_poly", geom.bounds(F.col(f"{c}_poly")[0]).alias(f"{c}_box"), geom.polygon_area(F.col(f"{c}_poly")).alias(f"{c}_area"))
    out = match.scored_polygons(side("a"), side("b")).where("a_id = b_id")
    return out.select(F.col("a_id").alias("id"), F.round("overlap", 5).alias("overlap"), F.round("coverage", 6).alias("coverage"), F.round("iou", 6).alias("iou"))


@query("""WITH b AS (SELECT p_partkey AS id, CAST(4 + p_size % 13 AS DOUBLE) AS w, CAST(5 + p_partkey % 40 AS DOUBLE) AS d, CASE WHEN p_partkey % 3 > 0 THEN p_size % 180 END AS t FROM part)
SELECT CAST(id AS VARCHAR) AS id, round(CASE WHEN t IS NULL THEN least(w, d) ELSE w * abs(sin(radians(t))) + d * abs(cos(radians(t))) END, 5) AS span, CASE WHEN t IS NULL THEN 'inferred from footprint' ELSE 'OSM' END AS source FROM b""")
def roof_direction(spark, sf_dir):
    """A tagged direction decides over which width a roof spans."""
    k, s = F.col("p_partkey"), F.col("p_size")
    tags = F.create_map(F.lit("building"), F.lit("yes"), F.lit("roof:direction"), F.when(k % 3 > 0, F.concat(s % 180, F.lit("°"))).otherwise("N"))
    rows = fx.table(spark, sf_dir, "part").select(k.cast("string").alias("id"), tags.alias("tags"), geom.rectangle(F.lit(0), F.lit(0), 4 + s % 13, 5 + k % 40).alias("ring"), *[F.lit(None).cast(t).alias(c) for c, t in (("wall_height", "double"), ("roof_height", "double"), ("floors", "int"), ("roof_materials", "array<string>"), ("wall_code", "string"), ("usage", "string"), ("nature", "string"), ("has_landmark", "boolean"))])
    return profile.building_profiles(rows).select("id", F.round("span", 5).alias("span"), F.col("roof_direction_source").alias("source"))
