"""Snapshots that are whole or absent, feature collections written by tasks, scans of any byte range."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelwise.sources import feature_files, geojson, snapshot


def tables(spark, n):
    return {name: spark.range(n * k).withColumn("v", F.lit(name)) for k, name in enumerate(("a", "b", "c", "d", "e"), 1)}


def counts(spark, folder, **more):
    return {n: df.count() for n, df in snapshot.read(spark, folder, **more).items()}


def test_a_broken_commit_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        snapshot.read(spark, folder)
    broken = tables(spark, 9) | {"c": spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))}
    with pytest.raises(PySparkException):
        snapshot.commit(broken, folder)
    assert snapshot.version_of(spark, folder) == 0
    assert snapshot.write_once(tables(spark, 2), folder, {"bbox": "a", "licence": "open"}) == 1  # what broke off is no snapshot
    for again in (broken, tables(spark, 7)):
        assert snapshot.write_once(again, folder, {"bbox": "b"}) == 1
    with pytest.raises(PySparkException):
        snapshot.commit(broken, folder)
    want = {"a": 2, "b": 4, "c": 6, "d": 8, "e": 10}
    assert counts(spark, folder) == want and snapshot.manifest(spark, folder)["provenance"] == {"bbox": "a", "licence": "open"}
    assert {n: t["rows"] for n, t in snapshot.manifest(spark, folder)["tables"].items()} == want
    assert len(list((tmp_path / "s").glob("data-*"))) == 1 and not list((tmp_path / "s").glob("_draft*"))


def test_a_stale_writer_loses(spark, tmp_path):
    folder = str(tmp_path)
    assert [snapshot.commit(tables(spark, n), folder) for n in (1, 2)] == [1, 2]
    held = snapshot.read(spark, folder)  # a reader goes on with what it has
    assert snapshot.commit(tables(spark, 3), folder, base=2) == 3
    with pytest.raises(snapshot.Conflict):
        snapshot.commit(tables(spark, 4), folder, base=2)
    assert counts(spark, folder)["a"] == 3 and held["a"].count() == 2 and counts(spark, folder, version=1)["a"] == 1
    assert len(list(tmp_path.glob("data-*"))) == 3
    with pytest.raises(FileNotFoundError, match="f, g"):
        snapshot.read(spark, folder, ("a", "g", "f"))


ODD = ['"features":[{', "\\", '\\"', 'a"b', "é{]}", '"features" : [ {"type"', "\\\\\\", "", "\n\t", "🙂"]
KINDS = "id string, properties map<string,string>, kind string, coordinates string"


def features(n=60):
    rng = random.Random(3)
    kind = lambda i: (None, "Point", "LineString", "Polygon")[i % 4]
    shape = {None: None, "Point": "[1.23456789, 2]", "LineString": "[[1, 2.5], [3.00000004, 4]]", "Polygon": "[[[0,0],[1,0],[1,1],[0,0]]]"}
    return [(f"{i}{ODD[i % 10]}", {ODD[rng.randrange(10)]: rng.choice(ODD) for _ in range(rng.randrange(4))}, kind(i), shape[kind(i)]) for i in range(n)]


def test_collections_come_back_as_they_were(spark, tmp_path):
    rows, path = features(), str(tmp_path / "f")
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    feature_files.write(df, path)
    files = sorted((tmp_path / "f").iterdir())
    assert len(files) == 3 and all(f.suffix == ".geojson" for f in files)
    found = [x for f in files for x in json.loads(f.read_text())["features"]]
    assert next(x for x in found if x["id"] == rows[1][0])["geometry"] == {"type": "Point", "coordinates": [1.2345679, 2]}
    assert next(x for x in found if x["id"] == rows[0][0])["geometry"] is None
    key = lambda r: (r[0], sorted(r[1].items()), r[2], json.loads(r[3] or "null"))
    rounded = [(i, p, k, c and c.replace("1.23456789", "1.2345679").replace("3.00000004", "3.0")) for i, p, k, c in rows]
    for got in (geojson.features(spark, f"{path}/*.geojson"), *[feature_files.scan(spark, f"{path}/*.geojson", split) for split in (61, 1000, 1 << 20)]):
        assert sorted(map(key, got.select("id", "properties", "kind", "coordinates").collect()), key=str) == sorted(map(key, rounded), key=str)
    feature_files.write(df.limit(2), path)
    assert feature_files.texts(spark, path, 99).count() == 62
    feature_files.write(df.limit(5), path, "overwrite")
    assert feature_files.texts(spark, path, 99).count() == 5


def test_failed_attempts_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame(features(), KINDS).repartition(4)
    feature_files.write(df.limit(3), path)
    before = sorted(f.name for f in (tmp_path / "f").iterdir())
    bad = df.withColumn("id", F.when(F.col("id").startswith("41"), F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(PySparkException):
        feature_files.write(bad, path, "overwrite")
    assert sorted(f.name for f in (tmp_path / "f").iterdir()) == before


def document(head, tail, rows, gap):
    return "{" + head + f'"features"{gap}:{gap}[{gap}' + f"{gap},{gap}".join(json.dumps(r, ensure_ascii=False, indent=len(gap) or None) for r in rows) + f"{gap}]{tail}" + "}"


@pytest.mark.parametrize("head, tail, gap, bom", [("", "", "", ""), ('"type":"FeatureCollection","crs":{"a":[{"features":[{"no":1}]}]},', ',"more":[{"x":[{"y":1}]}],"note":"\\"features\\":[{"', " \n", "﻿"), ('"name":"\\\\","bbox":[1,2],', ',"other":{"features":[{"no":2}]}', " " * 40, "")])
def test_any_split_finds_each_feature_once(spark, tmp_path, head, tail, gap, bom):
    rows = [{"type": "Feature", "id": f"f{i}", "properties": {"name": ODD[i % 10], "in": [{"features": [{"a": "}"}]}]}, "geometry": {"type": "Point", "coordinates": [i, 0.5]}} for i in range(25)]
    for n in (25, 0, 1):
        path = tmp_path / f"d{n}.geojson"
        path.write_bytes((bom + document(head, tail, rows[:n], gap)).encode())
        for split in (1, 7, 64, 501, 1 << 20) if n < 25 else (13, 64, 501, 1 << 20):
            got = [json.loads(r.value) for r in feature_files.texts(spark, str(path), split).orderBy("offset").collect()]
            assert got == rows[:n], split


def test_single_features_and_cut_files(spark, tmp_path):
    one = {"type": "Feature", "id": "x", "properties": {"a": "é"}, "geometry": None}
    (tmp_path / "one.geojson").write_text("﻿ " + json.dumps(one), encoding="utf-8")
    (r,) = feature_files.texts(spark, str(tmp_path / "one.geojson"), 9).collect()
    assert json.loads(r.value) == one and feature_files.scan(spark, str(tmp_path / "one.geojson")).first().id == "x"
    (tmp_path / "cut.geojson").write_text('{"features":[{"id":"a"},{"id":"b')
    with pytest.raises(PySparkException, match="cut short"):
        feature_files.texts(spark, str(tmp_path / "cut.geojson"), 9).collect()
    (tmp_path / "empty.geojson").write_text("")
    assert feature_files.texts(spark, str(tmp_path / "empty.geojson")).count() == 0


def test_only_what_is_used_is_parsed(spark, tmp_path):
    feature_files.write(spark.createDataFrame(features(4), KINDS), str(tmp_path / "f"))
    plan = feature_files.scan(spark, str(tmp_path / "f")).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(id" in plan and "StructField(properties" not in plan and "coordinates,StringType" not in plan
