"""An extra: the engine's sources are files and paged services without streams. These apply its batch operators to
streams of events where that is useful; nothing else depends on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_in_cells(events: DataFrame, point: Column, ts: str, window: str = "5 minutes", late: str = "10 minutes", size: float = 80.0) -> DataFrame:
    """Events per grid cell and time window; a window is emitted once events later than the allowed delay have come."""
    cell = lambda k: F.floor(point[k] / size).cast("int")
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, window), cell("x").alias("cx"), cell("z").alias("cz")).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "cx", "cz", "n")


def inside(events: DataFrame, point: Column, zones: DataFrame) -> DataFrame:
    """Events with the zones (ord, poly) that hold their point; zones are a static table, joined by grid cells."""
    from parcelwise.operators import spatial

    return spatial.contained(events.withColumn("p", point), zones)
