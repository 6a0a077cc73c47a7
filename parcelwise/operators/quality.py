"""Data-quality rules as queries that return violations, statistics of intervals, device settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import geom
from parcelwise.operators.rounds import cut, preceding, running


def running_ranges(df: DataFrame, keys: list[str], ord_: str, n: str) -> DataFrame:
    """Adds start and end: contiguous half-open ranges of n in order; empty ones go. Without keys, one list of ranges."""
    out = running(df, keys, [ord_], n, "end")
    return out.withColumn("start", F.col("end") - F.col(n)).where("start < end")


def gaps(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges that don't start where the one before ends (the first one: at 0)."""
    out = preceding(ranges, keys, "start", "end", "expected")
    return out.withColumn("expected", F.coalesce("expected", F.lit(0))).where("start <> expected")


def missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys that the other table doesn't have."""
    return df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti")


def bad_areas(shapes: DataFrame, ring: str, most: float = 100_000.0) -> DataFrame:
    area = geom.area(F.col(ring))
    return shapes.withColumn("area", area).where(F.isnan("area") | (F.col("area") <= 0) | (F.col("area") >= most))


def outside(points: DataFrame, extent: Column, slack: float = 0.01) -> DataFrame:
    """Points that aren't finite or lie outside an extent."""
    x, z = F.col("p.x"), F.col("p.z")
    bad = F.isnan(x) | F.isnan(z) | x.isNull() | z.isNull() | ~x.between(extent["minx"] - slack, extent["maxx"] + slack) | ~z.between(extent["minz"] - slack, extent["maxz"] + slack)
    return points.where(bad)


def wrong_code(df: DataFrame, column: str, code: str) -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(code)))


def origin_outside(borders: DataFrame) -> DataFrame:
    """One row if none of borders(poly) holds the origin."""
    here = geom.inside_polygon(geom.point(F.lit(0), F.lit(0)), F.col("poly"))
    return borders.agg(F.count_if(here).alias("n")).where("n = 0")


def too_wide(extents: DataFrame, most: float = 7000.0) -> DataFrame:
    """Extents (minx, maxx, minz, maxz) of that size or more."""
    return extents.where((F.col("maxx") - F.col("minx") >= most) | (F.col("maxz") - F.col("minz") >= most))


def too_few(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """(name, n): the counts of a one-row table that aren't above their bound."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n"), F.lit(n).alias("least")) for c, n in least.items()])
    return counts.select(F.inline(pairs)).where("n <= least").select("name", "n")


def without(df: DataFrame, required: list[dict[str, str]], tags: str = "properties") -> DataFrame:
    """(k): the numbers of required tag sets that no feature has."""
    has = [F.max(F.when(F.coalesce(reduce(lambda a, b: a & b, [F.col(tags)[k] == v for k, v in want.items()]), F.lit(False)), 1).otherwise(0)).alias(f"r{k}") for k, want in enumerate(required)]
    there = df.agg(*has)
    return there.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"r{k}", F.lit(0)).alias("n")) for k in range(len(required))]))).where("n = 0").select("k")


def misoriented(origins: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Origins (lon, lat) from which a thousandth of a degree east isn't more than 70 m to the east, or north 110 m to the
    north, in the projection around origin."""
    here = geom.project(F.col("lon"), F.col("lat"), origin)
    east, north = geom.project(F.col("lon") + 0.001, F.col("lat"), origin), geom.project(F.col("lon"), F.col("lat") + 0.001, origin)
    return origins.where(~((east["x"] - here["x"] > 70) & (north["z"] - here["z"] < -110)))


def changed(found: DataFrame, expected: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Keys whose digest isn't the expected one, or isn't there."""
    f, e = found.select(key, F.col(digest).alias("_now")), expected.select(key, F.col(digest).alias("_then"))
    return e.join(f, key, "left").where(~F.col("_now").eqNullSafe(F.col("_then"))).select(key)


def altered_walls(profiles: DataFrame, source: DataFrame, tags: str = "tags") -> DataFrame:
    """Ids of buildings whose given wall height isn't kept though no height is tagged."""
    given = source.where(F.col("wall_height").isNotNull() & (F.col("wall_height") != 0) & F.coalesce(F.col(tags)["height"], F.lit("")).eqNullSafe(F.lit("")))
    both = profiles.select("id", F.col("wall_height").alias("_now")).join(given.select("id", F.col("wall_height").alias("_then")), "id")
    return both.where(~F.col("_now").eqNullSafe(F.col("_then"))).select("id")


def invented_names(records: DataFrame, features: DataFrame) -> DataFrame:
    """(id, source_id): records (id, name, source_ids) whose name isn't that of a source feature (id, name, ref), or whose
    source isn't there."""
    own = records.select("id", "name", F.explode("source_ids").alias("source_id"))
    title = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.col("ref"), F.lit("")))
    known = features.select(F.col("id").alias("source_id"), title.alias("_title"))
    return own.join(known, "source_id", "left").where(~F.col("name").eqNullSafe(F.col("_title"))).select("id", "source_id")


def bad_vertices(built: DataFrame, extent: Column, slack: float = 0.1, most: float = 90.0) -> DataFrame:
    """Corners of built(id, walls) that aren't finite, lie outside the extent, or are below 0 or not below 90 m."""
    corner = lambda p, y: F.struct(F.col(f"w.{p}").alias("p"), F.col(f"w.{y}").alias("y"))
    rows = built.select("id", F.explode("walls").alias("w")).select("id", F.explode(F.array(corner("a", "low"), corner("b", "low"), corner("b", "top_b"), corner("a", "top_a"))).alias("c")).select("id", "c.p", "c.y")
    high = F.isnan("y") | F.col("y").isNull() | (F.col("y") < 0) | (F.col("y") >= most)
    return rows.where(high).select("id").unionByName(outside(rows.where(~high), extent, slack).select("id"))


def unresolved(picks: DataFrame) -> DataFrame:
    """Of picks(query_id, record_id, want): queries that don't lead to the record they were made for."""
    return picks.where(~F.col("record_id").eqNullSafe(F.col("want")))


def report(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations): how many rows each rule's query returns."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in rules.items()])


def weak_matches(matches: DataFrame, coverage: float = 0.65, iou: float = 0.5, margin: float = 0.149) -> DataFrame:
    """Matches that don't hold the thresholds (the margin allows for values rounded to three digits)."""
    return matches.where((F.col("coverage") < coverage) | (F.col("iou") < iou) | (F.col("iou") - F.col("runner_up") < margin))


#: Buckets into which a range of values is cut, and how many values are sorted at once.
BUCKETS, SORTED = 256, 1024


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """The bucket of a value of the range: by sign, then zero apart, then by magnitude where the range is wide, else by
    value; what isn't finite is apart. Larger values have no smaller bucket, and lo and hi have different ones."""
    share = lambda at, a, b: F.least(F.lit(BUCKETS - 1), F.floor(F.coalesce(F.try_divide(at - a, b - a), F.lit(0.0)) * BUCKETS)).cast("int")
    size = lambda x: F.log2(F.abs(x))
    wide = F.greatest(F.abs(lo), F.abs(hi)) > F.least(F.abs(lo), F.abs(hi)) * 65536
    by_size = F.when(lo > 0, share(size(v), size(lo), size(hi))).otherwise(share(-size(v), -size(lo), -size(hi)))
    inner = F.when((lo < 0) & (hi > 0), F.signum(v).cast("int") + 1).when((lo == 0) | (hi == 0), F.when(v == 0, F.when(lo == 0, 0).otherwise(1)).otherwise(F.when(lo == 0, 1).otherwise(0)))
    inner = inner.when(wide, by_size).otherwise(share(v, lo, hi))
    return F.when(F.isnan(v), BUCKETS + 1).when(v == float("inf"), BUCKETS).when(v == float("-inf"), -1).otherwise(inner)


def _beside(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of another table of the same keys, which may be null."""
    r, o = rows.alias("r"), other.alias("o")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return r.join(o, same).select("r.*", *[F.col(f"o.{c}") for c in other.columns if c not in keys])


def interval_statistics(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95), sort: int = SORTED) -> DataFrame:
    """Count, mean, and nearest-rank quantiles sorted[floor(n * q)] (not those of percentile functions), exact, by radix
    selection. A range of values is cut into buckets, which are counted; the one that holds a rank is the next range, down
    to one value, or to so few that they are sorted in the aggregation. So rows are counted and never ranked, whether a key
    has most of them, or a value. A range narrows by a factor of BUCKETS a round, at any magnitude."""
    names = ["median", "p95"] if shares == (0.5, 0.95) else [f"q{k}" for k in range(len(shares))]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    stats = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_q"), F.floor(F.col("n") * q).cast("long").alias("_rank")) for k, q in enumerate(shares)]))
    none = F.lit(None).cast("double")
    open_ = stats.select(*keys, "_lo", "_hi", each.alias("e")).select(*keys, "_lo", "_hi", "e.*", F.lit(True).alias("_all"))
    found = []
    while True:
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        held = _beside(rows, open_, keys).where(F.col("_all") | v.between(lo, hi))
        some = held.groupBy(*keys, "_q", _bucket(v, F.coalesce(lo, none), hi).alias("_b")).agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_rank").alias("_rank"))
        upto = F.sum("_m").over(Window.partitionBy(*keys, "_q").orderBy("_b"))  # a row a bucket
        some = some.withColumn("_upto", upto).where((F.col("_rank") >= F.col("_upto") - F.col("_m")) & (F.col("_rank") < F.col("_upto")))
        some = cut(some.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_m")))
        found.append(some.where("_lo = _hi").select(*keys, "_q", F.col("_lo").alias("_x")))
        left = some.where("_lo <> _hi")
        small = left.where(F.col("_m") <= sort)
        if not small.isEmpty():
            last = _beside(rows, small.select(*keys, "_q", "_lo", "_hi", "_rank"), keys).where(v.between(lo, hi))
            last = last.groupBy(*keys, "_q").agg(F.sort_array(F.collect_list("_v")).alias("_x"), F.first("_rank").alias("_rank"))  # sort values at most
            found.append(cut(last.select(*keys, "_q", F.get("_x", F.col("_rank").cast("int")).alias("_x"))))
        open_ = left.where(F.col("_m") > sort).select(*keys, "_q", "_lo", "_hi", "_rank", F.lit(False).alias("_all"))
        if open_.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == k, F.col("_x"))).alias(n) for k, n in enumerate(names)])
    return _beside(stats.select(*keys, "n", "mean"), every, keys)


def frame_intervals(df: DataFrame, keys: list[str], n: str, t: str, warm_up: int = 15) -> DataFrame:
    """Adds dt, the time since the frame before, for frames after the warm-up; n counts a key's frames without gaps. The
    frame before is looked up by its number, so a key with most of the frames is no single task's."""
    before = df.select(*keys, (F.col(n) + 1).alias(n), F.col(t).alias("_before")).alias("b")
    out = df.where(F.col(n) > warm_up).alias("f").join(before, [F.col(f"f.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, n)], "left")
    return out.select(*[F.col(f"f.{c}") for c in df.columns], (F.col(f"f.{t}") - F.col("_before")).alias("dt"))


def render_settings(mode: Column, dpr: Column, cores: Column, memory: Column) -> Column:
    """struct<pixel_ratio, shadow_size> for a device."""
    weak = F.coalesce(cores <= 4, F.lit(False)) | F.coalesce(memory <= 4, F.lit(False))
    ratio = F.when(dpr.isNull() | (dpr == 0), 1.0).otherwise(dpr)
    high = F.coalesce(mode, F.lit("fluid")) == "high"
    best = F.when(high, F.least(F.greatest(ratio, F.lit(1.25)), F.lit(1.5))).otherwise(F.least(ratio, F.when(weak, 1.0).otherwise(1.25)))
    return F.struct(best.alias("pixel_ratio"), F.when(high, 2048).otherwise(1024).alias("shadow_size"))
