from pyspark.sql import functions as F

from parcelwise.functions import geom
from parcelwise.plans import fixtures
from parcelwise.streaming import live


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("t", F.col("ts").cast("timestamp"))


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_counts_in_cells(spark, sf_dir):
    p = geom.point(F.col("event_id") * 37 % 1000, F.col("event_id") * 91 % 1000)
    got = _run(live.counts_in_cells(_stream(spark, sf_dir), p, "t"), "cells", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_inside_is_the_batch_result(spark, sf_dir):
    p = geom.point(F.col("event_id") * 37 % 1000 + 0.25, F.col("event_id") * 91 % 1000 + 0.5)
    zones = fixtures.zones(spark, sf_dir)
    got = _run(live.inside(_stream(spark, sf_dir), p, zones).select("event_id", "ord"), "held", "append")
    from parcelwise.operators import spatial

    want = spatial.contained(fixtures.points(spark, sf_dir), zones).select("point_id", "ord")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
