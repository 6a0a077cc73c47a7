"""Queries that write files and read them back, with their SQL over the tables they were made of."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelwise.operators.rounds import shared_folder
from parcelwise.plans import fixtures as fx
from parcelwise.sources import feature_files, snapshot

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Table and key of the five that make up a snapshot.
_FIVE = {"buildings": ("part", "p_partkey"), "places": ("supplier", "s_suppkey"), "points": ("events", "event_id"), "roads": ("orders", "o_orderkey"), "zones": ("nation", "n_nationkey")}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, {v} AS version, count(*) AS rows, CAST(sum({k}) AS BIGINT) AS ids, {'true' if v == 2 else 'false'} AS newest FROM {t}{' WHERE ' + k + ' % 2 = 0' if v == 2 else ''}" for v in (1, 2) for n, (t, k) in _FIVE.items()))
def snapshots(spark, sf_dir):
    """Five tables committed together; a commit that breaks off between the second and the third of them and one
    that starts from a version that isn't the newest leave no trace."""
    folder = _folder(spark, "snapshots")
    five = {n: fx.table(spark, sf_dir, t).select(F.col(k).cast("long").alias("id")) for n, (t, k) in _FIVE.items()}
    broken = five | {"points": five["points"].withColumn("id", F.raise_error(F.lit("broken off")).cast("long"))}
    for first in (True, False):
        try:
            snapshot.commit(broken, folder)
        except PySparkException:
            assert snapshot.version_of(spark, folder) == (0 if first else 1)
        if first:
            assert snapshot.write_once(five, folder, {"licence": "open"}) == snapshot.write_once(broken, folder) == 1
    assert snapshot.commit({n: df.where("id % 2 = 0") for n, df in five.items()}, folder, base=1) == 2
    try:
        snapshot.commit(five, folder, base=1)
    except snapshot.Conflict:
        pass
    out = None
    for version in (1, 2):
        for n, df in snapshot.read(spark, folder, tuple(five), version).items():
            row = df.agg(F.count("*").alias("rows"), F.sum("id").alias("ids")).select(F.lit(n).alias("name"), F.lit(version).alias("version"), "rows", "ids", F.lit(version == snapshot.version_of(spark, folder)).alias("newest"))
            out = row if out is None else out.unionByName(row)
    return out


#: A name that looks like structure.
_ODD = '\\"features":[{"id": "\\\\'


def _features(spark, sf_dir):
    k = F.col("p_partkey")
    x, z = (k % 1000) * 0.12345678, (k % 7) * 0.5
    line = F.to_json(F.array(F.array(x, z), F.array(x + 1, z + 0.25)))
    kind = F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "Point").otherwise("LineString")
    shape = F.when(kind == "Point", F.to_json(F.array(x, z))).when(kind == "LineString", line)
    name = F.when(k % 3 == 0, F.lit(_ODD)).otherwise(F.col("p_name"))
    return fx.table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), k).alias("id"), F.create_map(F.lit("name"), name, F.lit("n"), k.cast("string")).alias("properties"), kind.alias("kind"), shape.alias("coordinates"))


@query(f"""SELECT 'part/' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'Point' ELSE 'LineString' END AS kind,
    CASE WHEN p_partkey % 3 = 0 THEN '{_ODD}' ELSE p_name END AS name, CAST(p_partkey AS VARCHAR) AS n,
    CASE WHEN p_partkey % 5 <> 0 THEN round(floor((p_partkey % 1000) * CAST(0.12345678 AS DOUBLE) * 1e7 + 0.5) / 1e7, 7) END AS x, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 7) * CAST(0.5 AS DOUBLE) END AS z FROM part""")
def feature_collections(spark, sf_dir):
    """Features written as collections and scanned again in byte ranges far smaller than a file."""
    folder = _folder(spark, "features")
    feature_files.write(_features(spark, sf_dir).repartition(3), folder)
    got = feature_files.scan(spark, f"{folder}/*.geojson", split=4099)
    first = F.when(F.col("kind") == "Point", F.from_json("coordinates", "array<double>")).otherwise(F.from_json("coordinates", "array<array<double>>")[0])
    return got.select("id", "kind", F.col("properties")["name"].alias("name"), F.col("properties")["n"].alias("n"), F.round(first[0], 7).alias("x"), first[1].alias("z"))
