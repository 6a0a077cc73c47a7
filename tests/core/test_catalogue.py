"""The whole catalogue on a small hand-made map."""

from pyspark.sql import functions as F

from parcelwise.operators import catalogue

RING = "array<struct<x:double,z:double>>"
POINT = "struct<x:double,z:double>"


def square(x, z, n):
    return [[(float(x), float(z)), (float(x + n), float(z)), (float(x + n), float(z + n)), (float(x), float(z + n))]]


def test_build(spark):
    path = [[(0.0, 0.0), (50.0, 0.0), (90.0, 0.0)]]
    roads = spark.createDataFrame([("w1", 1, True, "Main", None, 5.0, path), ("w2", 2, True, "Main", None, 9.0, path), ("w3", 3, True, None, None, 1.0, path), ("w4", 4, False, None, "L1", 1.0, path)], f"id string, ord long, is_road boolean, name string, ref string, width double, paths array<{RING}>")
    points = spark.createDataFrame([(5, "n1", "Village", "village", (10.0, 10.0)), (6, "n2", "Shop", None, (205.0, 205.0)), (7, "n3", "Far", None, (9999.0, 0.0)), (8, "n4", " ", None, (1.0, 1.0)), (9, "n5", "Second", None, (206.0, 206.0))], f"ord long, id string, name string, place string, p {POINT}")
    areas = spark.createDataFrame([(10, "a1", "Park", square(-50, -50, 100)), (11, "a2", "Away", square(5000, 5000, 10))], f"ord long, id string, name string, poly array<{RING}>")
    zones = spark.createDataFrame([(1, "z1", "Works", None, square(300, 300, 50))], f"ord long, id string, name string, nature string, poly array<{RING}>")
    buildings = spark.createDataFrame([(1, "b1", {"building": "yes"}, square(200, 200, 10), None), (2, "b2", {"amenity": "townhall"}, square(400, 400, 10), None), (3, "b3", {"name": "Hall"}, square(500, 500, 10), None), (4, "b4", {"name": "Tiny"}, square(600, 600, 1), None), (5, "b5", {}, square(700, 700, 10), "Church")], f"ord long, id string, tags map<string,string>, poly array<{RING}>, landmark string")
    marks = spark.createDataFrame([(1, "m1", "Hall", "x", (520.0, 505.0)), (2, "m2", "New", None, (800.0, 800.0)), (3, "m3", "New", None, (810.0, 800.0)), (4, "m4", "Hall", "y", (900.0, 0.0)), (5, "m5", "Out", None, (-900.0, 0.0))], f"ord long, id string, name string, kind string, p {POINT}")
    extent = F.struct(F.lit(-100.0).alias("minx"), F.lit(1000.0).alias("maxx"), F.lit(-100.0).alias("minz"), F.lit(1000.0).alias("maxz"))
    records, aliases = catalogue.build(roads, points, areas, zones, buildings, marks, extent)
    got = {r.id: r for r in records.collect()}
    assert {k: (r.type, r.name, r.kind) for k, r in got.items()} == {
        "road:Main": ("line", "Main", "Rue / voie"), "rail:L1": ("line", "L1", "Voie ferrée"), "n1": ("point", "Village", "Lieu-dit / secteur"), "n2": ("point", "Shop", "Lieu / équipement"), "n5": ("point", "Second", "Lieu / équipement"),
        "a1": ("zone", "Park", "Zone / lieu"), "z1": ("zone", "Works", "Zone / lieu"), "b1": ("building", "Shop", "Bâtiment / équipement"), "b2": ("building", "Mairie", "Bâtiment / équipement"), "b3": ("building", "Hall", "Bâtiment / équipement"),
        "b5": ("building", "Church", "Bâtiment / équipement"), "m2": ("point", "New", "Lieu / équipement"), "m4": ("point", "Hall", "y"),
    }
    assert got["road:Main"].source_ids == ["w1", "w2"] and got["b5"].source == "IGN BD TOPO" and got["road:Main"].position.x == 50
    lead = {r.id: r.record_id for r in aliases.collect()}
    assert lead["w2"] == "road:Main" and lead["m1"] == "b3" and lead["m3"] == "m2" and lead["m4"] == "m4" and "m5" not in lead
    stats = catalogue.catalogue_statistics(records, roads.where("name is null and ref is null")).first()
    assert tuple(stats) == (1, 2, 4, 2, 5, 1)


def test_roads_are_clipped_to_the_extent(spark):
    line = lambda *xs: [(float(x), 5.0) for x in xs]
    rows = [("in", 1, True, "A", None, 5.0, [line(10, 50, 90)]), ("cut", 2, True, "A", None, 5.0, [line(-50, 50, 150, 50, 40)]), ("out", 3, True, "A", None, 5.0, [line(200, 300)]), ("gone", 4, True, "Far", None, 5.0, [line(-10, -5), line(101, 200)]),
            ("bare", 5, True, " ", "", 5.0, [line(10, 20)]), ("bare out", 6, True, None, None, 5.0, [line(500, 600)]), ("rail", 7, False, None, None, 5.0, [line(1, 2)])]
    roads = spark.createDataFrame(rows, f"id string, ord long, is_road boolean, name string, ref string, width double, paths array<{RING}>")
    extent = F.struct(*[F.lit(v).alias(k) for k, v in (("minx", 0.0), ("maxx", 100.0), ("minz", 0.0), ("maxz", 100.0))])
    inside = catalogue.clipped_roads(roads, extent)
    assert {r.id: [[p.x for p in path] for path in r.paths] for r in inside.collect()} == {"in": [[10, 50, 90]], "cut": [[0, 50, 100, 50, 40]], "bare": [[10, 20]], "rail": [[1, 2]]}  # both ends of a bend outside meet
    (group,) = catalogue.road_groups(inside).collect()
    assert (group.id, group.source_ids, group.n_paths) == ("road:A", ["in", "cut"], 2) and [r.id for r in catalogue.unnamed_roads(inside).collect()] == ["bare"]
