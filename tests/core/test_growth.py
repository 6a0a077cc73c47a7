"""What lies at the same place, or outside, is looked at once, so work doesn't grow with the square of the copies."""

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import geom
from parcelwise.operators import catalogue, spatial

POINT = "struct<x:double,z:double>"
POLY = f"array<array<{POINT}>>"


def watched(monkeypatch, name):
    """The numbers of rows that a function of spatial gets, call by call."""
    sizes, plain = [], getattr(spatial, name)

    def counting(*frames, **options):
        sizes.append(max(f.count() for f in frames if hasattr(f, "count") and hasattr(f, "columns")))
        return plain(*frames, **options)

    monkeypatch.setattr(spatial, name, counting)
    return sizes


def marks_of(spark, n=400, places=8):
    rows = [(i, f"n{i % 2}", (float(i % places * 30), 0.0), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"id long, name string, p {POINT}, ord long")


def square(x, z, n):
    return [[(float(x), float(z)), (float(x + n), float(z)), (float(x + n), float(z + n)), (float(x), float(z + n)), (float(x), float(z))]]


@pytest.mark.parametrize("by_name", [True, False])
def test_copies_of_marks_are_decided_once(spark, monkeypatch, by_name):
    rows, marks = marks_of(spark)
    odd = [(1000, "n0", None, 3), (1001, "n0", (float("nan"), 0.0), 4), (1002, None, (0.0, 0.0), 500)]
    records, want = [], {}
    for i, name, p, _ in rows:
        near = [j for j, other, x in records if (other == name or not by_name) and abs(x - p[0]) < 45]
        want[i] = near[0] if near else i
        if not near:
            records.append((i, name, p[0]))
    want |= {1000: 1000, 1001: 1001, 1002: 1002 if by_name else 0}
    sizes = watched(monkeypatch, "near_pairs")
    found = spatial.first_come(marks.unionByName(spark.createDataFrame(odd, marks.schema)), by_name=by_name)
    assert {r.id: r.record_id for r in found.collect()} == want and max(sizes) <= 8


def test_copies_of_records_are_merged_with_once(spark, monkeypatch):
    rows, marks = marks_of(spark)
    records = marks.select((F.col("id") + 5000).alias("record_id"), F.col("name").alias("record_name"), F.col("p").alias("q"), (-F.col("ord")).alias("ord")).where("q.x < 60")
    want = {i: max((5000 + j for j, other, q, _ in rows if other == name and q[0] < 60 and abs(q[0] - p[0]) < 45), default=i) for i, name, p, _ in rows}
    sizes = watched(monkeypatch, "near_pairs")
    assert {r.id: r.record_id for r in spatial.merged_by_name(marks.select("id", "name", "p"), records).collect()} == want and max(sizes) <= 8


def test_equal_shapes_hold_a_place_once(spark, monkeypatch):
    points = spark.createDataFrame([(i, (float(i % 2 * 100 + 1), 1.0)) for i in range(300)], f"id long, p {POINT}")
    shapes = spark.createDataFrame([(j, square(0, 0, 5)) for j in range(300)] + [(1000, square(100, 0, 5))], f"ord long, poly {POLY}")
    sizes = watched(monkeypatch, "contained")
    got = {r.id: r.ord for r in spatial.unique_container(points, shapes, "id").collect()}
    assert got == {i: 1000 for i in range(1, 300, 2)} and max(sizes) == 2


def test_roads_of_a_title_are_read_once(spark):
    roads = spark.createDataFrame([("a", 1, True, "A", None, 5.0, [[(0.0, 0.0)], [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]]), ("b", 2, True, "A", None, 6.0, [[(4.0, 0.0), (5.0, 0.0), (6.0, 0.0)], []])], f"id string, ord long, is_road boolean, name string, ref string, width double, paths {POLY}")
    groups = catalogue.road_groups(roads)
    (g,) = groups.collect()
    assert (g.width, g.source_ids, g.n_paths, g.position.x) == (5.0, ["a", "b"], 4, 5.0)
    assert "Join" not in groups._jdf.queryExecution().optimizedPlan().toString()


def test_marks_of_a_name_at_a_place_are_asked_about_once(spark, monkeypatch):
    rows, marks = marks_of(spark)
    records = marks.select((F.col("id") + 5000).alias("record_id"), F.col("name").alias("record_name"), geom.point(F.col("p.x") + 7, F.lit(3)).alias("q"), F.col("ord"))
    sizes = watched(monkeypatch, "cut")
    got = {r.id: r.record_id for r in spatial.nearest_by_name(marks.select("id", "name", "p"), records).collect()}
    assert got == {i: 5000 + i % 8 for i, *_ in rows} and max(sizes) <= 8


def test_others_at_a_place_are_looked_at_once(spark, monkeypatch):
    rows, marks = marks_of(spark)
    others = marks.select(F.col("id").alias("other"), F.col("ord").alias("k"), geom.point(F.col("p.x") + 5, F.lit(0)).alias("q"))
    sizes = watched(monkeypatch, "near_pairs")
    got = {r.id: (r.other, r.d) for r in spatial.nearest_point(marks.select("id", "p"), others, "id", "k").collect()}
    assert got == {i: (i % 8, 5.0) for i, *_ in rows} and max(sizes) <= 8


def test_places_are_picked_once(spark, monkeypatch):
    queries = spark.createDataFrame([(i, (float(i % 3 * 100 + 1), 1.0) if i < 300 else None) for i in range(301)], f"query_id long, p {POINT}")
    boxes = spark.createDataFrame([(1, 10, square(0, 0, 5))], f"ord long, record_id long, poly {POLY}")
    points = spark.createDataFrame([(k, 1000 + k, (101.0, 2.0)) for k in range(50)], f"ord long, record_id long, q {POINT}")
    none = boxes.where("false")
    sizes = watched(monkeypatch, "first_container")
    got = {r.query_id: (r.tier, r.record_id) for r in catalogue.pick(queries, boxes, points, none.select("ord", "record_id", F.col("poly")[0].alias("line")), none).collect()}
    assert got == {i: ((1, 10), (2, 1000), (None, None))[i % 3 if i < 300 else 2] for i in range(301)} and max(sizes) <= 4


def test_places_near_others_go_once(spark, monkeypatch):
    rows, marks = marks_of(spark)
    others = marks.where("p.x < 60").select(F.col("p").alias("q"))
    sizes = watched(monkeypatch, "near_pairs")
    got = {r.id for r in spatial.without_neighbours(marks, others, "id").collect()}
    assert got == {i for i, _, p, _ in rows if p[0] >= 75} and max(sizes) <= 8


def test_rings_inside_and_beyond_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(geom, "clip_convex", lambda *a, **k: F.raise_error(F.lit("cut")).cast(geom.RING))
    rings = spark.createDataFrame([(1, square(2, 2, 5)[0]), (2, square(0, 0, 10)[0]), (3, square(11, 0, 5)[0]), (4, square(2, -9, 5)[0]), (5, [])], f"id long, ring array<{POINT}>")
    extent = F.struct(*[F.lit(v).alias(k) for k, v in (("minx", 0.0), ("maxx", 10.0), ("minz", 0.0), ("maxz", 10.0))])
    assert {r.id: len(r.c) for r in rings.select("id", geom.clip_ring(F.col("ring"), extent).alias("c")).collect()} == {1: 5, 2: 5, 3: 0, 4: 0, 5: 0}


def test_buildings_are_shaped_by_several_tasks_a_core(spark, sf_dir):
    from parcelwise.plans.attribute_queries import _buildings
    from parcelwise.plans.feature_queries import QUERIES

    cores = spark.sparkContext.defaultParallelism
    assert _buildings(spark, sf_dir).rdd.getNumPartitions() >= 2 * cores
    assert QUERIES["clip_rings"][0](spark, sf_dir).rdd.getNumPartitions() >= 2 * cores


def test_any_number_of_pages_is_read(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from parcelwise.plans import feeds
    from parcelwise.plans.rule_queries import QUERIES
    from parcelwise.sources import paged

    n = 13_001  # more than the reader's usual limit
    pq.write_table(pa.table({"s_suppkey": pa.array(range(n), pa.int64()), "s_name": [f"s{i}" for i in range(n)]}), tmp_path / "supplier.parquet", row_group_size=1000)
    got = QUERIES["paged_scan"][0](spark, str(tmp_path))
    assert sorted((r.id, r.name, r.lon) for r in got.collect()) == sorted((f"supplier/{i}", f"s{i}", i * 0.5) for i in range(n))
    read, plain = [], feeds._group
    monkeypatch.setattr(feeds, "_group", lambda *a: read.append(a[1]) or plain(*a))
    reader = paged.PagedReader({"endpoints": str(tmp_path), "layer": "supplier", "page": "17", "limit": "none", "transport": "parcelwise.plans.feeds:pages"})
    parts = reader.partitions()
    assert len(parts) <= paged.PARTITIONS and sum(p.rows for p in parts) == n and (plain.cache_clear() or len(list(reader.read(parts[-1])))) == parts[-1].rows
    assert set(read[1:]) == {12, 13}  # the row groups of the last pages only
    with pytest.raises(RuntimeError):
        paged.PagedReader({"endpoints": str(tmp_path), "layer": "supplier", "transport": "parcelwise.plans.feeds:pages"}).partitions()


def test_relations_are_assembled_by_several_tasks_a_core(spark):
    from parcelwise.sources import osm

    way = lambda *ps: [(float(x), float(y)) for x, y in ps]
    members = [(r, pos, role, r * 10 + pos) for r in range(40) for pos, role in ((1, None), (0, "outer"), (2, "inner"))]
    ways = [(r * 10 + pos, p) for r in range(40) for pos, p in ((0, way((0, 0), (4, 0), (4, 4))), (1, way((0, 0), (0, 4), (4, 4))), (2, way((1, 1), (2, 1), (2, 2), (1, 1)))) if r % 5 or pos != 1]
    got = osm.relation_polygons(spark.createDataFrame(members, "relation_id long, pos int, role string, way_id long"), spark.createDataFrame(ways, "way_id long, path array<struct<lon:double,lat:double>>"))
    assert {r.relation_id: (r.tainted, [len(p) for p in r.polys]) for r in got.collect()} == {r: (False, [2]) if r % 5 else (True, []) for r in range(40)}
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_ranges_of_files_are_scanned_by_several_tasks_a_core(spark, tmp_path):
    from parcelwise.sources import feature_files

    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join('{"type":"Feature","id":"%d","properties":{},"geometry":null}' % i for i in range(500)) + "]}")
    got = feature_files.texts(spark, str(tmp_path / "*.geojson"), split=101)
    assert got.count() == 500 and got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
