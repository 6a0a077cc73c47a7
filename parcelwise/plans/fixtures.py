"""Geometry derived from the driver's tables by integer arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geom

#: The same derivations as common table expressions.
SQL = {
    "a": """a AS (SELECT p_partkey AS a_id, p_size, CAST((p_partkey % 40) * 25 AS DOUBLE) AS x0, CAST((p_partkey // 40) * 25 AS DOUBLE) AS z0,
    CAST((p_partkey % 40) * 25 + 8 + p_size % 13 AS DOUBLE) AS x1, CAST((p_partkey // 40) * 25 + 8 + p_size % 11 AS DOUBLE) AS z1 FROM part)""",
    "b": """b AS (SELECT a_id AS b_id, x0 + (a_id % 7) * CAST(0.5 AS DOUBLE) AS x0, z0 + (a_id % 5) * CAST(0.5 AS DOUBLE) AS z0, x1 + (a_id % 7) * CAST(0.5 AS DOUBLE) AS x1, z1 + (a_id % 5) * CAST(0.5 AS DOUBLE) AS z1 FROM a WHERE a_id % 10 <> 3
    UNION ALL SELECT 1000000 + a_id, x0 + 1, z0, x1 + 1, z1 FROM a WHERE a_id % 9 = 0)""",
    "pt": "pt AS (SELECT event_id AS point_id, (event_id * 37) % 1000 + CAST(0.25 AS DOUBLE) AS x, (event_id * 91) % 1000 + CAST(0.5 AS DOUBLE) AS z FROM events)",
    "sp": "sp AS (SELECT s_suppkey AS sid, CAST((s_suppkey * 53) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 29) % 1000 AS DOUBLE) AS z FROM supplier)",
    "zone": """zone AS (SELECT CAST(n_nationkey AS BIGINT) AS ord, CAST((n_nationkey % 5) * 200 + 10 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 200 + 10 AS DOUBLE) AS z0, CAST(170 AS DOUBLE) AS w, CAST(150 AS DOUBLE) AS h, CAST(40 AS DOUBLE) AS hole FROM nation
    UNION ALL SELECT 100 + r_regionkey, CAST(r_regionkey * 150 AS DOUBLE), CAST(r_regionkey * 120 AS DOUBLE), CAST(400 + 10 * r_regionkey AS DOUBLE), CAST(300 AS DOUBLE), CAST(0 AS DOUBLE) FROM region)""",
    "hit": """hit AS (SELECT point_id, ord, w * h AS area FROM pt JOIN zone ON x >= x0 AND x < x0 + w AND z >= z0 AND z < z0 + h
    AND NOT (hole > 0 AND x >= x0 + hole AND x < x0 + w - hole AND z >= z0 + hole AND z < z0 + h - hole))""",
    "rng": """rng AS (SELECT l_orderkey, row_number() OVER w AS ord, CAST(l_quantity AS BIGINT) AS n,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))""",
    "road": """road AS (SELECT o_orderkey AS id, o_orderkey AS ord, o_orderstatus <> 'F' AS is_road, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE ' R' || (o_custkey % 97) || ' ' END AS name,
    CASE WHEN o_custkey % 22 = 0 THEN 'D' || (o_custkey % 13) END AS ref, CAST(o_orderkey % 9 + 1 AS DOUBLE) AS width, o_orderkey % 4 + 2 AS n FROM orders)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box(x0, z0, x1, z1):
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x0, "minx"), (x1, "maxx"), (z0, "minz"), (z1, "maxz"))])


def footprints(spark: SparkSession, sf_dir: str, polygons: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two sources of footprints, a and b, with runners-up and gaps."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, z0 = (k % 40) * 25, F.floor(k / 40) * 25
    a = table(spark, sf_dir, "part").select(k.alias("a_id"), _box(x0, z0, x0 + 8 + s % 13, z0 + 8 + s % 11).alias("a_box"))

    def moved(df: DataFrame, id_, dx, dz) -> DataFrame:
        b = F.col("a_box")
        return df.select(id_.alias("b_id"), _box(b["minx"] + dx, b["minz"] + dz, b["maxx"] + dx, b["maxz"] + dz).alias("b_box"))

    i = F.col("a_id")
    b = moved(a.where("a_id % 10 <> 3"), i, (i % 7) * 0.5, (i % 5) * 0.5).unionAll(moved(a.where("a_id % 9 = 0"), i + 1000000, F.lit(1), F.lit(0)))
    size = lambda c: (F.col(c)["maxx"] - F.col(c)["minx"]) * (F.col(c)["maxz"] - F.col(c)["minz"])
    a, b = a.withColumn("a_area", size("a_box")), b.withColumn("b_area", size("b_box"))
    if polygons:
        poly = lambda c: F.array(geom.rectangle(F.col(c)["minx"], F.col(c)["minz"], F.col(c)["maxx"], F.col(c)["maxz"]))
        a, b = a.withColumn("a_poly", poly("a_box")), b.withColumn("b_poly", poly("b_box"))
    return a, b


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, p) from events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("point_id"), geom.point((e * 37) % 1000 + 0.25, (e * 91) % 1000 + 0.5).alias("p"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, q) from suppliers."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("sid"), geom.point((s * 53) % 1000, (s * 29) % 1000).alias("q"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, poly): rectangles with a hole from nations, whole ones from regions."""
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    x, z = (n % 5) * 200 + 10, F.floor(n / 5) * 200 + 10
    holed = F.array(geom.rectangle(x, z, x + 170, z + 150), geom.rectangle(x + 40, z + 40, x + 130, z + 110))
    whole = F.array(geom.rectangle(r * 150, r * 120, r * 150 + 400 + 10 * r, r * 120 + 300))
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("ord"), holed.alias("poly")).unionAll(table(spark, sf_dir, "region").select((r + 100).cast("long").alias("ord"), whole.alias("poly")))


def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, ord, n): an order's lines, numbered by a total order, with their quantity."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).cast("long").alias("ord"), F.col("l_quantity").cast("long").alias("n"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, is_road, name, ref, width, paths) from orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(c % 11 == 0, "").otherwise(F.concat(F.lit(" R"), c % 97, F.lit(" ")))
    ref = F.when(c % 22 == 0, F.concat(F.lit("D"), c % 13))
    path = F.transform(F.sequence(F.lit(0).cast("long"), k % 4 + 1), lambda i: geom.point(k * 3 + i, k % 100 + i * i))
    return table(spark, sf_dir, "orders").select(k.alias("id"), k.alias("ord"), (F.col("o_orderstatus") != "F").alias("is_road"), name.alias("name"), ref.alias("ref"), (k % 9 + 1).cast("double").alias("width"), F.array(path).alias("paths"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over a few tasks a core. Where shapes made of narrow rows are costly, the size of a file tells little of
    the work in it: a scan would make a few tasks only."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
