"""Queries of the spatial joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import geom
from parcelwise.operators import catalogue, match, quality, spatial
from parcelwise.plans import fixtures as fx

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


_META = "a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.z0 <= b.z1 AND a.z1 >= b.z0"
_OVER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0))"
_PAIRS = f"""{fx.sql("a", "b")},
p AS (SELECT a_id, b_id, {_OVER} AS o, (a.x1 - a.x0) * (a.z1 - a.z0) AS s, (b.x1 - b.x0) * (b.z1 - b.z0) AS t FROM a JOIN b ON {_META}),
s AS (SELECT a_id, b_id, o / s AS coverage, o / (s + t - o) AS iou FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, b_id) AS rn FROM s),
m AS (SELECT a.a_id, one.b_id AS best, coalesce(one.iou, 0) AS iou, coalesce(one.coverage, 0) AS coverage, coalesce(two.iou, 0) AS runner_up
    FROM a LEFT JOIN r one ON one.a_id = a.a_id AND one.rn = 1 LEFT JOIN r two ON two.a_id = a.a_id AND two.rn = 2),
d AS (SELECT *, CASE WHEN best IS NULL OR coverage < 0.65 OR iou < 0.5 THEN 'unmatched' WHEN iou - runner_up < 0.15 THEN 'ambiguous' ELSE 'matched' END AS status FROM m)
"""


def _matches(spark, sf_dir):
    a, b = fx.footprints(spark, sf_dir)
    pairs = match.scored(a, b, match.rectangle_overlap(F.col("a_box"), F.col("b_box")))
    return match.best_matches(a, pairs)


@query(_PAIRS + "SELECT a_id, status, CASE WHEN status = 'matched' THEN best END AS b_id, round(iou, 6) AS iou, round(coverage, 6) AS coverage, round(runner_up, 6) AS runner_up FROM d")
def entity_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("a_id", "status", "b_id", *[F.round(c, 6).alias(c) for c in ("iou", "coverage", "runner_up")])


@query(_PAIRS + "SELECT count(*) AS footprints, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (best IS NULL) AS alone FROM d")
def match_stats(spark, sf_dir):
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = _matches(spark, sf_dir)
    return out.agg(F.count("*").alias("footprints"), status("matched"), status("ambiguous"), status("unmatched"), F.count_if((F.col("iou") == 0) & (F.col("coverage") == 0) & (F.col("status") == "unmatched")).alias("alone"))


# A candidate that touches without overlap has no overlap either; the fixture has none such as the only one.


@query(f"{fx.sql('a', 'b')} SELECT a_id, b_id FROM a JOIN b ON {_META}")
def grid_join(spark, sf_dir):
    a, b = fx.footprints(spark, sf_dir)
    return spatial.grid_join(a, b, "a_box", "b_box").select("a_id", "b_id")


@query(f"{fx.sql('a', 'b')} SELECT a_id, count(*) AS candidates, CAST(sum(b_id) AS BIGINT) AS ids FROM a JOIN b ON {_META} GROUP BY 1")
def bbox_join(spark, sf_dir):
    a, b = fx.footprints(spark, sf_dir)
    return spatial.grid_join(a, b, "a_box", "b_box", size=37.0).groupBy("a_id").agg(F.count("*").alias("candidates"), F.sum("b_id").alias("ids"))


@query(f"{fx.sql('a', 'b')}, p AS (SELECT a_id, b_id, {_OVER} AS o, (a.x1 - a.x0) * (a.z1 - a.z0) AS s, (b.x1 - b.x0) * (b.z1 - b.z0) AS t FROM a JOIN b ON {_META}) SELECT a_id, b_id, round(o, 6) AS overlap, round(o / s, 6) AS coverage, round(o / (s + t - o), 6) AS iou FROM p")
def overlap_iou(spark, sf_dir):
    a, b = fx.footprints(spark, sf_dir, polygons=True)
    out = match.scored_polygons(a, b)
    return out.select("a_id", "b_id", *[F.round(c, 6).alias(c) for c in ("overlap", "coverage", "iou")])


@query(f"{fx.sql('pt', 'zone', 'hit')} SELECT point_id, min(ord) AS ord FROM hit GROUP BY 1")
def pip_first(spark, sf_dir):
    return spatial.first_container(fx.points(spark, sf_dir), fx.zones(spark, sf_dir), "point_id", "ord").select("point_id", "ord")


@query(f"{fx.sql('pt', 'zone', 'hit')} SELECT point_id, min(ord) AS ord FROM hit GROUP BY 1 HAVING count(*) = 1")
def landmark_unique_pip(spark, sf_dir):
    return spatial.unique_container(fx.points(spark, sf_dir), fx.zones(spark, sf_dir), "point_id").select("point_id", "ord")


@query(f"{fx.sql('pt', 'zone', 'hit')}, u AS (SELECT point_id, min(ord) AS ord FROM hit GROUP BY 1 HAVING count(*) = 1) SELECT ord, min(point_id) AS point_id FROM u WHERE ord % 3 <> 0 GROUP BY 1")
def pip_unique_anti(spark, sf_dir):
    zones = fx.zones(spark, sf_dir)
    hits = spatial.unique_container(fx.points(spark, sf_dir), zones, "point_id").select("point_id", "ord")
    known = zones.where("ord % 3 = 0").select("ord")
    return hits.join(known, "ord", "left_anti").groupBy("ord").agg(F.min("point_id").alias("point_id"))


@query(f"{fx.sql('pt', 'zone', 'hit')}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY area, ord) AS rn FROM hit) SELECT point_id, ord FROM r WHERE rn = 1")
def smallest_container(spark, sf_dir):
    return spatial.smallest_container(fx.points(spark, sf_dir), fx.zones(spark, sf_dir), "point_id", "ord").select("point_id", "ord")


@query(f"{fx.sql('pt', 'zone', 'hit')} SELECT count(DISTINCT point_id) FILTER (h.point_id IS NOT NULL) AS inside, (SELECT count(*) FROM events) - count(DISTINCT h.point_id) AS outside FROM hit h")
def commune_split(spark, sf_dir):
    points = fx.points(spark, sf_dir)
    hits = spatial.contained(points, fx.zones(spark, sf_dir)).select("point_id").distinct().withColumn("hit", F.lit(True))
    return points.join(hits, "point_id", "left").agg(F.count_if(F.col("hit")).alias("inside"), F.count_if(F.col("hit").isNull()).alias("outside"))


_NEAR = f"{fx.sql('pt', 'sp')}, d AS (SELECT point_id, sid, sqrt((pt.x - sp.x) * (pt.x - sp.x) + (pt.z - sp.z) * (pt.z - sp.z)) AS d FROM pt JOIN sp ON abs(pt.x - sp.x) < {{0}} AND abs(pt.z - sp.z) < {{0}})"


@query(_NEAR.format(22) + ", r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, sid) AS rn FROM d WHERE d < 22) SELECT point_id, sid, round(d, 6) AS d FROM r WHERE rn = 1")
def nearest_point(spark, sf_dir):
    out = spatial.nearest_point(fx.points(spark, sf_dir), fx.places(spark, sf_dir), "point_id", "sid")
    return out.select("point_id", "sid", F.round("d", 6).alias("d"))


@query(_NEAR.format(45) + " SELECT point_id FROM pt WHERE point_id NOT IN (SELECT point_id FROM d WHERE d < 45)")
def distance_anti(spark, sf_dir):
    return spatial.without_neighbours(fx.points(spark, sf_dir), fx.places(spark, sf_dir), "point_id").select("point_id")


def _lines(spark, sf_dir):
    n = F.col("n_nationkey")
    x, z = (n % 5) * 200 + 10, F.floor(n / 5) * 200 + 10
    return fx.table(spark, sf_dir, "nation").select(n.cast("long").alias("ord"), F.array(geom.point(x, z), geom.point(x + 170, z), geom.point(x + 170, z + 150), geom.point(x + 20, z + 70)).alias("line"))


_SEGS = """seg AS (SELECT ord, unnest([{'ax': x0, 'az': z0, 'bx': x0 + 170, 'bz': z0}, {'ax': x0 + 170, 'az': z0, 'bx': x0 + 170, 'bz': z0 + 150}, {'ax': x0 + 170, 'az': z0 + 150, 'bx': x0 + 20, 'bz': z0 + 70}]) AS s FROM zone WHERE ord < 100),
t AS (SELECT point_id, ord, x, z, s, greatest(0, least(1, ((x - s.ax) * (s.bx - s.ax) + (z - s.az) * (s.bz - s.az)) / ((s.bx - s.ax) * (s.bx - s.ax) + (s.bz - s.az) * (s.bz - s.az)))) AS t FROM pt, seg),
d AS (SELECT point_id, ord, sqrt((x - (s.ax + t * (s.bx - s.ax))) * (x - (s.ax + t * (s.bx - s.ax))) + (z - (s.az + t * (s.bz - s.az))) * (z - (s.az + t * (s.bz - s.az)))) AS d FROM t)"""


@query(f"{fx.sql('pt', 'zone')}, {_SEGS}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, ord) AS rn FROM d WHERE d < 10) SELECT point_id, ord, round(d, 6) AS d FROM r WHERE rn = 1")
def nearest_segment(spark, sf_dir):
    out = spatial.nearest_segment(fx.points(spark, sf_dir), _lines(spark, sf_dir), "point_id", "ord")
    return out.select("point_id", "ord", F.round("d", 6).alias("d"))


def _named(spark, sf_dir):
    marks = fx.points(spark, sf_dir).select(F.col("point_id").alias("id"), F.concat(F.lit("n"), F.col("point_id") % 7).alias("name"), "p")
    records = fx.places(spark, sf_dir).select((F.col("sid") + 10_000_000).alias("record_id"), F.concat(F.lit("n"), F.col("sid") % 7).alias("record_name"), "q", F.col("sid").alias("ord"))
    return marks, records


@query(_NEAR.format(45) + ", f AS (SELECT point_id, min(sid) AS sid FROM d WHERE d < 45 AND point_id % 7 = sid % 7 GROUP BY 1) SELECT pt.point_id AS id, 'n' || (pt.point_id % 7) AS name, coalesce(f.sid + 10000000, pt.point_id) AS record_id, f.sid IS NULL AS added FROM pt LEFT JOIN f USING (point_id)")
def near_dup_merge(spark, sf_dir):
    return spatial.merged_by_name(*_named(spark, sf_dir))


@query(f"{fx.sql('pt', 'sp')}, d AS (SELECT point_id, sid, sqrt((pt.x - sp.x) * (pt.x - sp.x) + (pt.z - sp.z) * (pt.z - sp.z)) AS d FROM pt JOIN sp ON point_id % 7 = sid % 7), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, sid) AS rn FROM d) SELECT point_id AS id, sid + 10000000 AS record_id FROM r WHERE rn = 1")
def nearest_by_name(spark, sf_dir):
    return spatial.nearest_by_name(*_named(spark, sf_dir))


@query(f"{fx.sql('rng')} SELECT l_orderkey, ord, \"end\" - n AS start, \"end\" FROM rng WHERE n > 0")
def running_ranges(spark, sf_dir):
    return quality.running_ranges(fx.item_counts(spark, sf_dir), ["l_orderkey"], "ord", "n").select("l_orderkey", "ord", "start", "end")


@query(f"{fx.sql('rng')} SELECT o_orderkey AS point_id, (o_orderkey * 7) % 120 AS pos, r.ord AS range_id FROM orders LEFT JOIN rng r ON l_orderkey = o_orderkey AND (o_orderkey * 7) % 120 >= \"end\" - n AND (o_orderkey * 7) % 120 < \"end\"")
def interval_lookup(spark, sf_dir):
    ranges = quality.running_ranges(fx.item_counts(spark, sf_dir), ["l_orderkey"], "ord", "n").withColumnRenamed("ord", "id")
    asked = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") * 7 % 120).alias("pos"))
    return spatial.interval_lookup(asked, ranges, ["l_orderkey"]).select("point_id", "pos", "range_id")


@query(f"{fx.sql('rng')}, g AS (SELECT \"end\" - n AS s, coalesce(lag(\"end\") OVER (PARTITION BY l_orderkey ORDER BY ord), 0) AS e FROM rng) SELECT count(*) FILTER (s <> e) AS violations FROM g")
def dq_contiguous(spark, sf_dir):
    ranges = quality.running_ranges(fx.item_counts(spark, sf_dir), ["l_orderkey"], "ord", "n")
    return quality.gaps(ranges, ["l_orderkey"]).agg(F.count("*").alias("violations"))


@query(f"""{fx.sql('pt', 'sp', 'zone', 'hit')}, {_SEGS},
b AS (SELECT point_id, min(ord) AS ord FROM hit WHERE ord < 100 AND ord % 2 = 0 GROUP BY 1),
q AS (SELECT point_id, sid, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((pt.x - sp.x) * (pt.x - sp.x) + (pt.z - sp.z) * (pt.z - sp.z)), sid) AS rn FROM pt JOIN sp ON sqrt((pt.x - sp.x) * (pt.x - sp.x) + (pt.z - sp.z) * (pt.z - sp.z)) < 22),
l AS (SELECT point_id, ord, row_number() OVER (PARTITION BY point_id ORDER BY d, ord) AS rn FROM d WHERE d < 10),
z AS (SELECT point_id, ord, row_number() OVER (PARTITION BY point_id ORDER BY area, ord) AS rn FROM hit WHERE ord >= 100)
SELECT pt.point_id AS query_id, CASE WHEN b.ord IS NOT NULL THEN 1 WHEN q.sid IS NOT NULL THEN 2 WHEN l.ord IS NOT NULL THEN 3 WHEN z.ord IS NOT NULL THEN 4 END AS tier,
    CASE WHEN b.ord IS NOT NULL THEN CASE WHEN b.ord % 4 = 0 THEN b.ord + 1000 END ELSE coalesce(q.sid + 2000, l.ord + 3000, z.ord + 4000) END AS record_id
FROM pt LEFT JOIN b USING (point_id) LEFT JOIN q ON q.point_id = pt.point_id AND q.rn = 1 LEFT JOIN l ON l.point_id = pt.point_id AND l.rn = 1 LEFT JOIN z ON z.point_id = pt.point_id AND z.rn = 1""")
def pick_tiers(spark, sf_dir):
    zones, o = fx.zones(spark, sf_dir), F.col("ord")
    buildings = zones.where("ord < 100 and ord % 2 = 0").withColumn("record_id", F.when(o % 4 == 0, o + 1000))  # the others have no record
    points = fx.places(spark, sf_dir).select(F.col("sid").alias("ord"), (F.col("sid") + 2000).alias("record_id"), "q")
    lines = _lines(spark, sf_dir).withColumn("record_id", o + 3000)
    return catalogue.pick(fx.points(spark, sf_dir).withColumnRenamed("point_id", "query_id"), buildings, points, lines, zones.where("ord >= 100").withColumn("record_id", o + 4000))
