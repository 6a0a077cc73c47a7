"""Queries of derived attributes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import geom, jsem
from parcelwise.operators import catalogue, landuse, match, profile, quality
from parcelwise.plans import fixtures as fx

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _case(column: str, table: dict) -> str:
    """A fixed table as SQL."""
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in table.items()) + " END"


def _isin(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_NUMBER = r"try_cast(nullif(regexp_extract({0}, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE)"
# Texts that hold numbers, or nearly.
_TEXT = "t AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_size || '.5 m' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN p_name WHEN 4 THEN ' -' || p_size WHEN 5 THEN '.' || p_size || 'e1x' WHEN 6 THEN '0' ELSE p_size || '' END AS v FROM part)"


def _texts(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    cases = [F.concat(s, F.lit(".5 m")), F.lit(""), F.lit(None).cast("string"), F.col("p_name"), F.concat(F.lit(" -"), s), F.concat(F.lit("."), s, F.lit("e1x")), F.lit("0"), s]
    v = cases[7]
    for i in range(6, -1, -1):
        v = F.when(k % 8 == i, cases[i]).otherwise(v)
    return fx.table(spark, sf_dir, "part").select(k.alias("id"), v.alias("v"))


@query(f"WITH {_TEXT} SELECT id, {_NUMBER.format('v')} AS number, CASE WHEN {_NUMBER.format('v')} > 0 THEN {_NUMBER.format('v')} END AS positive, coalesce(nullif({_NUMBER.format('v')}, 0), 4) AS fallback FROM t")
def parse_float(spark, sf_dir):
    n = jsem.parse_float("v")
    return _texts(spark, sf_dir).select("id", n.alias("number"), jsem.positive("v").alias("positive"), jsem.number_or(n, F.lit(4.0)).alias("fallback"))


@query("SELECT p_partkey AS id, CAST(list_reduce(list_concat([CAST(0 AS BIGINT)], [CAST(ascii(c) AS BIGINT) FOR c IN list_filter(string_split('way/' || p_partkey, ''), lambda c: c <> '')]), lambda n, c: (n * 31 + c + 2147483648) % 4294967296 + CASE WHEN (n * 31 + c + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END - 2147483648) AS BIGINT) AS hash FROM part")
def id_hash(spark, sf_dir):
    k = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select(k.alias("id"), jsem.text_hash(F.concat(F.lit("way/"), k)).alias("hash"))


_U32 = "& 4294967295"


def _imul(a: str, b: str) -> str:
    """The low 32 bits of a product, unsigned."""
    return f"CAST(CAST(({a}) {_U32} AS HUGEINT) * CAST(({b}) {_U32} AS HUGEINT) % 4294967296 AS BIGINT)"


@query(f"""WITH a AS (SELECT p_partkey AS id, (10220 + {_imul('p_partkey + 1', '1831565813')}) {_U32} AS s FROM part), b AS (SELECT id, {_imul('xor(s, s >> 15)', 's | 1')} AS t FROM a),
c AS (SELECT id, t, (t + {_imul('xor(t, t >> 7)', 't | 61')}) {_U32} AS m FROM b), d AS (SELECT id, xor(m, t) AS t FROM c) SELECT id, xor(t, t >> 14) / CAST(4294967296 AS DOUBLE) AS value FROM d""")
def seeded_random(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), jsem.seeded_random(F.col("p_partkey") + 1).alias("value"))


@query(f"""WITH {_TEXT}, k AS (SELECT id, v, CASE id % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'track' WHEN 2 THEN 'other' WHEN 3 THEN 'residential' END AS h, CASE id % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'ditch' WHEN 2 THEN 'brook' END AS r FROM t),
w AS (SELECT id, coalesce(nullif({_NUMBER.format('v')}, 0), {_case('h', catalogue.ROAD_WIDTH)}, 4) AS road, coalesce(nullif({_NUMBER.format('v')}, 0), {_case('r', catalogue.WATER_WIDTH)}, 3) AS water FROM k) SELECT id, road, least(20, greatest(1, road)) AS scene, water FROM w""")
def road_width(spark, sf_dir):
    i = F.col("id")
    h = F.when(i % 5 == 0, "primary").when(i % 5 == 1, "track").when(i % 5 == 2, "other").when(i % 5 == 3, "residential")
    r = F.when(i % 4 == 0, "river").when(i % 4 == 1, "ditch").when(i % 4 == 2, "brook")
    road = catalogue.road_width(F.col("v"), h)
    return _texts(spark, sf_dir).select("id", road.alias("road"), landuse.scene_width(road).alias("scene"), catalogue.water_width(F.col("v"), r).alias("water"))


_PROPS = """p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) * 1.9 AS h, CASE p_partkey % 6 WHEN 0 THEN '1.5' WHEN 1 THEN NULL WHEN 2 THEN 'abc' WHEN 3 THEN '5' WHEN 4 THEN '5.1' ELSE '0' END AS acc, CAST(p_size * 1.9 + p_partkey % 11 + 100 AS DOUBLE) AS top, CAST(100 AS DOUBLE) AS ground,
    p_partkey % 7 = 0 AS light, CAST(p_partkey % 60 AS DOUBLE) AS area, CAST(p_partkey % 20 AS INTEGER) AS n, substr(p_brand, 7) || CAST(p_size AS VARCHAR) AS code, CASE WHEN p_partkey % 3 = 0 THEN 'Indifférencié' WHEN p_partkey % 3 = 1 THEN 'Agricole' END AS usage FROM part)"""
_WALL = "CASE WHEN h > 0 AND h < 80 AND try_cast(acc AS DOUBLE) > 0 AND try_cast(acc AS DOUBLE) <= 5 THEN h END"


def _props(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    acc = F.when(k % 6 == 0, "1.5").when(k % 6 == 2, "abc").when(k % 6 == 3, "5").when(k % 6 == 4, "5.1").when(k % 6 == 5, "0")
    return fx.table(spark, sf_dir, "part").select(
        k.alias("id"), (s.cast("double") * 1.9).alias("h"), acc.alias("acc"), (s.cast("decimal(10,1)") * F.lit(1.9).cast("decimal(2,1)") + k % 11 + 100).cast("double").alias("top"), F.lit(100.0).alias("ground"), (k % 7 == 0).alias("light"),
        (k % 60).cast("double").alias("area"), (k % 20).cast("int").alias("n"), F.concat(F.substring("p_brand", 7, 9), s.cast("string")).alias("code"), F.when(k % 3 == 0, "Indifférencié").when(k % 3 == 1, "Agricole").alias("usage"),
    )


def _derived(spark, sf_dir):
    rows = _props(spark, sf_dir).withColumn("wall", match.wall_height(F.col("h"), F.col("acc")))
    return rows.withColumn("roof", match.roof_rise(F.col("wall"), F.col("top"), F.col("ground"), F.col("area"), F.col("light"))).withColumn("floors", match.floors(F.col("n"))).withColumn("materials", match.roof_materials(F.col("code")))


_DERIVED = f"""WITH {_PROPS}, w AS (SELECT *, {_WALL} AS wall FROM p), r AS (SELECT *, top - ground - wall AS rise FROM w),
d AS (SELECT *, CASE WHEN rise BETWEEN 0.6 AND 9 AND area >= 25 AND NOT light THEN floor(rise * 10 + 0.5) / 10 END AS roof, CASE WHEN n > 0 AND n < 15 THEN n END AS floors FROM r)
"""


@query(_DERIVED + "SELECT id, round(wall, 6) AS wall, roof, floors FROM d")
def ign_attributes(spark, sf_dir):
    return _derived(spark, sf_dir).select("id", F.round("wall", 6).alias("wall"), "roof", "floors")


@query(_DERIVED + "SELECT count(*) AS source, count(wall) AS wall_heights, count(roof) AS roof_heights, count(floors) AS floors, count(*) FILTER (regexp_matches(code, '[1-4]')) AS roof_materials, count(*) FILTER (usage <> 'Indifférencié') AS usage FROM d")
def attribute_stats(spark, sf_dir):
    return _derived(spark, sf_dir).agg(F.count("*").alias("source"), F.count("wall").alias("wall_heights"), F.count("roof").alias("roof_heights"), F.count("floors").alias("floors"), F.count_if(F.size("materials") > 0).alias("roof_materials"), F.count_if(F.col("usage") != profile.NO_USAGE).alias("usage"))


@query(f"""WITH {_PROPS}, c AS (SELECT id, list_filter(string_split(code, ''), lambda x: x IN ('1', '2', '3', '4')) AS c FROM p), u AS (SELECT id, list_filter(c, lambda x, i: list_position(c, x) = i) AS u FROM c)
SELECT id, array_to_string([{_case('x', match.ROOF_CODES)} FOR x IN u], ',') AS materials FROM u""")
def material_set(spark, sf_dir):
    return _derived(spark, sf_dir).select("id", F.array_join("materials", ",").alias("materials"))


@query("""WITH r AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 4 AS h, CAST(p_size % 17 AS DOUBLE) AS span, CAST(p_partkey % 4 AS DOUBLE) AS f, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size % 9 AS DOUBLE) END AS wall, p_partkey % 3 = 0 AS bulk FROM part),
l AS (SELECT id, h, least(h, 9, greatest(1.2, span * CASE WHEN bulk THEN 0.5 ELSE 0.85 END), CASE WHEN f > 0 THEN greatest(3.2, f * 2.65 + 1) END, CASE WHEN wall > 0 THEN greatest(3.2, wall + 1) END) AS r FROM r) SELECT id, round(r, 6) AS roof, r < h - 0.001 AS reduced FROM l""")
def roof_clamp(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    roof = profile.plausible_roof(s / 4.0, (s % 17).cast("double"), (k % 4).cast("double"), F.when(k % 5 > 0, (s % 9).cast("double")), k % 3 == 0)
    return fx.table(spark, sf_dir, "part").select(k.alias("id"), F.round(roof, 6).alias("roof"), (roof < s / 4.0 - 0.001).alias("reduced"))


# Buildings from parts: rectangles, with tags and attributes by residue.
_W = "CAST(4 + p_size % 13 AS DOUBLE)"
_D = "CAST(5 + p_partkey % 40 AS DOUBLE)"
_BUILD = f"""b AS (SELECT p_partkey AS id, {_W} AS w, {_D} AS d, {_W} * {_D} AS size, least({_W}, {_D}) AS span,
    CASE p_partkey % 9 WHEN 0 THEN 'church' WHEN 1 THEN 'garage' WHEN 2 THEN 'barn' WHEN 3 THEN 'roof' ELSE 'yes' END AS building, CASE WHEN p_partkey % 31 = 0 THEN 'no' END AS wall_tag, CASE WHEN p_partkey % 23 = 0 THEN 'school' END AS amenity,
    CASE p_partkey % 10 WHEN 0 THEN 'slate' WHEN 1 THEN 'thatch' END AS roof_tag, CASE p_partkey % 14 WHEN 0 THEN 'flat' WHEN 1 THEN 'gabled' END AS shape_tag, CASE WHEN p_partkey % 12 = 0 THEN CAST(p_size % 5 AS DOUBLE) END AS roof_t,
    CASE WHEN p_partkey % 15 = 0 THEN CAST(3 + p_size % 9 AS DOUBLE) END AS height_t, CASE WHEN p_partkey % 8 = 0 THEN CAST(p_size % 4 AS DOUBLE) END AS levels_t,
    CASE p_partkey % 6 WHEN 0 THEN 'Agricole' WHEN 1 THEN 'Résidentiel' WHEN 2 THEN 'Indifférencié' WHEN 3 THEN 'Religieux' END AS usage, CASE p_partkey % 29 WHEN 0 THEN 'Silo' WHEN 1 THEN 'Serre' END AS nature, p_partkey % 37 = 0 AS mark,
    CASE WHEN p_partkey % 4 > 0 THEN CAST(2 + p_size % 8 AS DOUBLE) END AS wall_i, CASE WHEN p_partkey % 5 > 1 THEN CAST(1 + p_size % 7 AS DOUBLE) END AS roof_i, CASE WHEN p_partkey % 7 > 2 THEN p_size % 4 END AS floors_i,
    CASE p_partkey % 11 WHEN 0 THEN 'concrete' WHEN 1 THEN 'slate' WHEN 2 THEN 'tile' END AS mat, CASE p_partkey % 13 WHEN 0 THEN '10' WHEN 1 THEN '12' WHEN 2 THEN '50' END AS code FROM part)"""


def _buildings(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    tags = {
        "building": F.when(k % 9 == 0, "church").when(k % 9 == 1, "garage").when(k % 9 == 2, "barn").when(k % 9 == 3, "roof").otherwise("yes"), "wall": F.when(k % 31 == 0, "no"), "amenity": F.when(k % 23 == 0, "school"),
        "roof:material": F.when(k % 10 == 0, "slate").when(k % 10 == 1, "thatch"), "roof:shape": F.when(k % 14 == 0, "flat").when(k % 14 == 1, "gabled"), "roof:height": F.when(k % 12 == 0, F.concat(text(s % 5), F.lit(" m"))),
        "height": F.when(k % 15 == 0, text(3 + s % 9)), "building:levels": F.when(k % 8 == 0, text(s % 4)),
    }
    bag = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(a).alias("k"), v.alias("v")) for a, v in tags.items()]), lambda x: x["v"].isNotNull()))
    mat = F.when(k % 11 == 0, "concrete").when(k % 11 == 1, "slate").when(k % 11 == 2, "tile")
    return fx.spread(fx.table(spark, sf_dir, "part").select(k, s), "p_partkey").select(
        text(k).alias("id"), bag.alias("tags"), geom.rectangle(F.lit(0), F.lit(0), 4 + s % 13, 5 + k % 40).alias("ring"), F.when(k % 4 > 0, (2 + s % 8).cast("double")).alias("wall_height"), F.when(k % 5 > 1, (1 + s % 7).cast("double")).alias("roof_height"),
        F.when(k % 7 > 2, s % 4).alias("floors"), F.when(mat.isNotNull(), F.array(mat)).alias("roof_materials"), F.when(k % 13 == 0, "10").when(k % 13 == 1, "12").when(k % 13 == 2, "50").alias("wall_code"),
        F.when(k % 6 == 0, "Agricole").when(k % 6 == 1, "Résidentiel").when(k % 6 == 2, "Indifférencié").when(k % 6 == 3, "Religieux").alias("usage"), F.when(k % 29 == 0, "Silo").when(k % 29 == 1, "Serre").alias("nature"), (k % 37 == 0).alias("has_landmark"),
    )


_KIND = f"""k AS (SELECT *, CASE WHEN wall_tag = 'no' OR building IN ('roof', 'carport') THEN 'canopy' WHEN mark OR amenity IN {_isin(profile.PUBLIC_AMENITY)} THEN 'public' WHEN nature = 'Serre' THEN 'greenhouse' WHEN nature = 'Silo' THEN 'silo'
    ELSE coalesce({_case('building', profile.TAG_KIND)}, {_case('usage', profile.USAGE_KIND)}, CASE WHEN size < 45 THEN 'annex' WHEN size > 900 THEN 'large' ELSE 'house' END) END AS kind FROM b),
u AS (SELECT *, kind IN {_isin(profile.BULK)} AS bulk FROM k)"""
_PROFILE = f"""WITH {_BUILD}, {_KIND},
f AS (SELECT *, coalesce({_case('roof_tag', profile.ROOF_TAG)}, mat, CASE WHEN bulk THEN 'metal' WHEN kind = 'church' THEN 'slate' ELSE 'tile' END) AS material, coalesce(nullif(levels_t, 0), nullif(floors_i, 0)) AS n,
    CASE WHEN shape_tag = 'flat' OR kind = 'canopy' OR (shape_tag IS NULL AND mat = 'concrete' AND roof_i IS NULL) THEN 'flat' ELSE 'gabled' END AS shape FROM u),
s AS (SELECT *, CASE WHEN shape = 'flat' THEN 0 ELSE coalesce(nullif(roof_t, 0), roof_i, least(CASE WHEN bulk THEN 3 ELSE 3.8 END, greatest(0.65, span * CASE WHEN bulk THEN 0.12 WHEN kind IN ('annex', 'garage') THEN 0.25 ELSE 0.34 END))) END AS source FROM f),
r AS (SELECT *, CASE WHEN nullif(roof_t, 0) IS NULL AND roof_i IS NOT NULL THEN least(source, 9, greatest(1.2, span * CASE WHEN bulk THEN 0.5 ELSE 0.85 END), CASE WHEN n > 0 THEN greatest(3.2, n * 2.65 + 1) END, CASE WHEN wall_i > 0 THEN greatest(3.2, wall_i + 1) END) ELSE source END AS roof FROM s),
w AS (SELECT *, CASE WHEN height_t IS NOT NULL THEN greatest(0.5, height_t - roof) WHEN wall_i IS NOT NULL THEN wall_i WHEN n IS NOT NULL THEN greatest(2.5, n * 2.65) ELSE coalesce({_case('kind', profile.KIND_HEIGHT)}, 4.4) END AS wall FROM r),
o AS (SELECT *, least(6, greatest(1, floor((wall - 0.2) / 2.2)), coalesce(n, greatest(1, floor(wall / 2.65)))) AS windows FROM w)
"""


@query(_PROFILE + """SELECT CAST(id AS VARCHAR) AS id, kind, bulk, size, round(wall, 6) AS wall_height, round(roof, 6) AS roof_height, roof < source - 0.001 AS roof_clamped, shape AS roof_shape, material AS roof_material, round(windows, 6) AS window_floors,
    CASE WHEN height_t IS NOT NULL THEN 'OSM' WHEN wall_i IS NOT NULL THEN 'IGN BD TOPO' WHEN n IS NOT NULL THEN 'estimated from floors' ELSE 'estimated' END AS height_source,
    CASE WHEN roof_t > 0 THEN 'OSM' WHEN roof_i IS NOT NULL AND shape <> 'flat' THEN 'IGN statistical roof maximum' ELSE 'estimated' END AS roof_height_source,
    CASE WHEN roof_tag IS NOT NULL THEN 'OSM' WHEN mat IS NOT NULL THEN 'IGN cadastral declaration' ELSE 'estimated' END AS material_source,
    CASE code WHEN '10' THEN '#d5cdb7' WHEN '50' THEN '#d5d0c2' ELSE CASE WHEN bulk THEN '#c7c8bd' WHEN kind = 'public' THEN '#eadcc0' ELSE '#eadcc5' END END AS wall_colour,
    building IN ('church', 'garage', 'barn') OR coalesce(usage <> 'Indifférencié', FALSE) AS known_usage FROM o""")
def building_profile(spark, sf_dir):
    out = profile.building_profiles(_buildings(spark, sf_dir))
    keep = ("id", "kind", "bulk", "size", "wall_height", "roof_height", "roof_clamped", "roof_shape", "roof_material", "window_floors", "height_source", "roof_height_source", "material_source", "wall_colour", "known_usage")
    rounded = {c: F.round(c, 6) for c in ("wall_height", "roof_height", "window_floors")}
    return out.withColumns(rounded).select(*keep)


@query(f"WITH {_BUILD}, {_KIND} SELECT kind, count(*) AS n, count(*) FILTER (bulk) AS bulk, count(wall_i) AS walls FROM u GROUP BY 1")
def category_counts(spark, sf_dir):
    rows = _buildings(spark, sf_dir)
    kind = profile.building_kind(F.col("tags"), F.col("usage"), F.col("nature"), F.col("has_landmark"), geom.area(F.col("ring")))
    return rows.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(*profile.BULK)).alias("bulk"), F.count("wall_height").alias("walls"))


@query("SELECT o_orderkey AS id, coalesce(c_mktsegment, 'none') AS usage, coalesce(c_acctbal, 0) AS height FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0")
def enrich_left_join(spark, sf_dir):
    extra = fx.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("usage"), F.col("c_acctbal").alias("height"))
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    return match.enriched(rows, extra, "key", {"usage": "none", "height": 0.0}).select("id", "usage", "height")


_LAND = """t AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'forest' WHEN 1 THEN 'vineyard' WHEN 2 THEN 'reservoir' WHEN 3 THEN '' WHEN 4 THEN 'railway' WHEN 5 THEN 'odd' END AS landuse, CASE event_id % 5 WHEN 0 THEN 'water' WHEN 1 THEN 'scrub' WHEN 2 THEN 'grassland' END AS nat,
    CASE event_id % 3 WHEN 0 THEN 'pitch' WHEN 1 THEN 'stadium' END AS leisure, CASE WHEN event_id % 11 = 0 THEN 'parking' END AS amenity, CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '' END AS name, CASE WHEN event_id % 13 = 0 THEN 'rail' END AS railway,
    CASE event_id % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'proposed' WHEN 2 THEN 'track' END AS highway FROM events)"""


@query(f"""WITH {_LAND}, k AS (SELECT *, coalesce(nullif(landuse, ''), nullif(nat, ''), nullif(leisure, '')) AS kind FROM t) SELECT id,
    CASE WHEN nat = 'water' OR landuse = 'reservoir' THEN 'water' {' '.join(f"WHEN kind IN {_isin(v)} THEN '{n}'" for n, v in landuse.CLASSES.items())} END AS class, coalesce(amenity = 'parking', FALSE) AS parking, coalesce(name <> '' AND leisure = 'stadium', FALSE) AS sports,
    coalesce(highway <> 'proposed', FALSE) AS scene, CAST(CASE WHEN railway = 'rail' THEN 2.2 WHEN highway = 'primary' THEN 14 END AS DOUBLE) AS spacing FROM k""")
def land_use(spark, sf_dir):
    e = F.col("event_id")
    pick = lambda m, *v: F.coalesce(*[F.when(e % m == i, x) for i, x in enumerate(v) if x is not None])
    tags = {
        "landuse": pick(7, "forest", "vineyard", "reservoir", "", "railway", "odd"), "natural": pick(5, "water", "scrub", "grassland"), "leisure": pick(3, "pitch", "stadium"), "amenity": F.when(e % 11 == 0, "parking"),
        "name": pick(4, "x", ""), "railway": F.when(e % 13 == 0, "rail"), "highway": pick(6, "primary", "proposed", "track"),
    }
    bag = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(a).alias("k"), v.alias("v")) for a, v in tags.items()]), lambda x: x["v"].isNotNull()))
    rows = fx.table(spark, sf_dir, "events").select(e.alias("id"), bag.alias("tags"))
    t = F.col("tags")
    return rows.select("id", landuse.land_class(t).alias("class"), landuse.is_parking(t).alias("parking"), landuse.is_sports_landmark(t).alias("sports"), F.coalesce(landuse.scene_road(t["highway"]), F.lit(False)).alias("scene"), landuse.spacing(t).alias("spacing"))


@query(f"{fx.sql('pt')}, d AS (SELECT point_id, least(sqrt(x * x + z * z), sqrt((x - 1150) * (x - 1150) + (z + 600) * (z + 600))) AS d FROM pt) SELECT point_id, round(d, 6) AS d, CASE WHEN point_id % 4 = 0 THEN 62.0 WHEN d < 1100 THEN 42 WHEN d < 1900 THEN 60 ELSE 83 END::DOUBLE AS step FROM d")
def tree_step(spark, sf_dir):
    d = landuse.village_distance(F.col("p"))
    return fx.points(spark, sf_dir).select("point_id", F.round(d, 6).alias("d"), landuse.tree_step(F.col("point_id") % 4 == 0, d).alias("step"))


@query("""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'fluid' END AS mode, CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) / 2 END AS dpr, CASE WHEN p_partkey % 4 > 0 THEN p_size % 9 END AS cores, CASE WHEN p_partkey % 7 > 0 THEN p_size % 17 END AS mem FROM part)
SELECT id, CAST(CASE WHEN mode = 'high' THEN least(greatest(coalesce(dpr, 1), 1.25), 1.5) ELSE least(coalesce(dpr, 1), CASE WHEN cores <= 4 OR mem <= 4 THEN 1 ELSE 1.25 END) END AS DOUBLE) AS pixel_ratio, CASE WHEN mode = 'high' THEN 2048 ELSE 1024 END AS shadow_size FROM v""")
def quality_settings(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    got = quality.render_settings(F.when(k % 3 == 0, "high").when(k % 3 == 1, "fluid"), F.when(s % 5 > 0, (s % 5) / 2.0), F.when(k % 4 > 0, s % 9), F.when(k % 7 > 0, s % 17))
    return fx.table(spark, sf_dir, "part").select(k.alias("id"), got["pixel_ratio"].alias("pixel_ratio"), got["shadow_size"].alias("shadow_size"))
