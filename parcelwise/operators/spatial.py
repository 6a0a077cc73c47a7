"""Spatial joins. Everything is an equi-join on cells of quadtree covers with the exact test as condition, so no nested-loop
join is planned, and a pair is kept in one cell only, so duplicates never need a shuffle to go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import geom
from parcelwise.operators import cover
from parcelwise.operators.rounds import cut, first_kept

CELL = 80.0


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def grid_join(a: DataFrame, b: DataFrame, box_a: str, box_b: str, size: float = CELL, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs whose boxes touch or overlap, and that agree in the columns `by`. Boxes lie in the few cells of the level
    that fits them; a pair meets at the level of its larger box, where the smaller one is looked up, and is kept in the cell
    that is the larger of both first cells."""
    left, right = cover.sized(a, F.col(box_a), size, 1), cover.sized(b, F.col(box_b), size, 1)
    mine, theirs = cover.levels(left), cover.levels(right)
    own = F.col("_lev")
    row = lambda lev, larger: F.struct(lev.alias("lev"), F.lit(larger).alias("larger"))
    above = lambda used, least: F.filter(used, lambda k: least(k))
    # whose level it is: b's, with a looked up at all of b's levels from a's own on, or a's, above b's own
    at_a = F.concat(F.transform(above(F.col("_used"), lambda k: k >= own), lambda k: row(k, "b")), F.when(F.array_min("_used") < own, F.array(row(own, "a"))).otherwise(F.array().cast("array<struct<lev:int,larger:string>>")))
    at_b = F.concat(F.array(row(own, "b")), F.transform(above(F.col("_used"), lambda k: k > own), lambda k: row(k, "a")))
    spread = lambda df, used, at: df.withColumn("_used", used).withColumn("_at", F.explode(at)).withColumn("_lev", F.col("_at.lev")).withColumn("_larger", F.col("_at.larger")).drop("_used", "_at")
    left = cover.cells(spread(left, theirs, at_a), size).drop("_box").withColumnsRenamed({"_fx": "_ax", "_fz": "_az"})
    right = cover.cells(spread(right, mine, at_b), size).drop("_box").withColumnsRenamed({"_fx": "_bx", "_fz": "_bz"})
    first = (F.col("_cx") == F.greatest("_ax", "_bx")) & (F.col("_cz") == F.greatest("_az", "_bz"))
    out = left.join(right, [*by, "_larger", *cover.KEY]).where(first & geom.boxes_meet(F.col(box_a), F.col(box_b)))
    return out.drop("_larger", *cover.KEY, "_ax", "_az", "_bx", "_bz")


def contained(points: DataFrame, shapes: DataFrame, poly: str = "poly", size: float = CELL) -> DataFrame:
    """All (point, polygon) pairs with the point p in the polygon. Points in cells that lie wholly inside need no test."""
    known = cover.sized(shapes, geom.bounds(F.col(poly)[0]), size)
    at = cover.look_up(points, "p", cover.levels(known), size)
    hit = at.join(cover.polygon_cells(known, poly, size), cover.KEY)
    return hit.where(F.col("_whole") | geom.inside_polygon(F.col("p"), F.col(poly))).drop(*cover.KEY, "_whole")


def first_container(points: DataFrame, shapes: DataFrame, point_id: str, ord_: str, size: float = CELL) -> DataFrame:
    """Each point with the first shape (by ord) that holds it."""
    hits = contained(points, shapes, size=size)
    rest = [c for c in hits.columns if c != point_id]
    return hits.groupBy(point_id).agg(F.min_by(F.struct(*rest), ord_).alias("_h")).select(point_id, "_h.*")


def at_places(points: DataFrame, answer, by: tuple[str, ...] = ()) -> DataFrame:
    """Points beside what `answer` gives for their places: it takes the distinct places (p, and the columns `by`) and returns
    a row for each that has an answer. So however many points lie at a place, it is asked about once."""
    return points.distinct().join(answer(points.select("p", *by).distinct()), ["p", *by])


def unique_container(points: DataFrame, shapes: DataFrame, point_id: str, size: float = CELL) -> DataFrame:
    """Each point that exactly one shape holds, with it. Equal shapes, like points at the same place, are tested once."""
    once = cut(shapes.groupBy(F.xxhash64("poly"), "poly").agg(F.count("*").alias("_n"), F.first(F.struct(*shapes.columns)).alias("_h")).select("_h.*", "_n"))  # the hash sorts fast
    rest = [c for c in points.columns if c not in (point_id, "p")] + shapes.columns

    def answer(places: DataFrame) -> DataFrame:
        hits = contained(places, once, size=size).groupBy("p").agg(F.sum("_n").alias("_n"), F.first(F.struct(*shapes.columns)).alias("_h"))
        return hits.where("_n = 1").select("p", "_h.*")

    return at_places(points, answer).select(point_id, "p", *rest)


def smallest_container(points: DataFrame, shapes: DataFrame, point_id: str, ord_: str, size: float = CELL) -> DataFrame:
    """Each point with the shape of smallest shell area that holds it; the first of equal ones."""
    hits = contained(points, shapes.withColumn("_area", geom.area(F.col("poly")[0])), size=size)
    rest = [c for c in hits.columns if c not in (point_id, "_area")]
    return hits.groupBy(point_id).agg(F.min_by(F.struct(*rest), F.struct("_area", ord_)).alias("_h")).select(point_id, "_h.*")


def near_pairs(points: DataFrame, others: DataFrame, reach: float, p: str = "p", q: str = "q", by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a point and another less than reach apart that agree in the columns `by`, with their distance d: cells
    of the reach's size, each point looked up in its own and the eight around."""
    at = points.withColumn("cx", F.explode(F.sequence(_cell(F.col(p)["x"], reach) - 1, _cell(F.col(p)["x"], reach) + 1))).withColumn("cz", F.explode(F.sequence(_cell(F.col(p)["z"], reach) - 1, _cell(F.col(p)["z"], reach) + 1)))
    there = others.withColumn("cx", _cell(F.col(q)["x"], reach)).withColumn("cz", _cell(F.col(q)["z"], reach))
    return at.join(there, [*by, "cx", "cz"]).withColumn("d", geom.distance(F.col(p), F.col(q))).where(F.col("d") < reach).drop("cx", "cz")


def nearest_point(points: DataFrame, others: DataFrame, point_id: str, ord_: str, reach: float = 22.0) -> DataFrame:
    """Each point with the nearest other one within reach; the first of equal ones. Of others at the same place only the
    first is looked at, and points at the same place are asked about once."""
    first = others.groupBy("q").agg(F.min_by(F.struct(*others.columns), ord_).alias("_h")).select("_h.*")
    rest = [*others.columns, "d"]
    near = lambda places: near_pairs(places, first, reach).groupBy("p").agg(F.min_by(F.struct(*rest), F.struct("d", ord_)).alias("_h")).select("p", "_h.*")
    return at_places(points, near).select(point_id, *[c for c in points.columns if c != point_id], *rest)


def nearest_segment(points: DataFrame, lines: DataFrame, point_id: str, ord_: str, reach: float = 10.0, size: float = CELL) -> DataFrame:
    """Each point with the nearest line (column line) within reach over all of its segments."""
    hits = near_lines(points, lines.withColumn("reach", F.lit(reach)), size).drop("reach")
    rest = [c for c in hits.columns if c != point_id]
    return hits.groupBy(point_id).agg(F.min_by(F.struct(*rest), F.struct("d", ord_)).alias("_h")).select(point_id, "_h.*")


def near_lines(points: DataFrame, lines: DataFrame, size: float = CELL) -> DataFrame:
    """All pairs of a point p and a segment of lines(line, reach, ...) less than the line's reach apart, with their distance
    d; the line itself goes."""
    segs = lines.withColumn("_seg", F.explode(geom.path_edges(F.col("line")))).drop("line")
    a, b = F.col("_seg.a"), F.col("_seg.b")
    lo, hi = lambda k: F.least(a[k], b[k]) - F.col("reach"), lambda k: F.greatest(a[k], b[k]) + F.col("reach")
    known = cover.sized(segs, F.struct(lo("x").alias("minx"), hi("x").alias("maxx"), lo("z").alias("minz"), hi("z").alias("maxz")), size)
    at = cover.look_up(points, "p", cover.levels(known), size)
    hits = at.join(cover.segment_cells(known, a, b, F.col("reach"), size), cover.KEY)
    return hits.withColumn("d", geom.segment_distance(F.col("p"), a, b)).where(F.col("d") < F.col("reach")).drop(*cover.KEY, "_seg")


def without_neighbours(points: DataFrame, others: DataFrame, point_id: str, reach: float = 45.0) -> DataFrame:
    """The points that have no other one less than reach away."""
    near = near_pairs(points.select("p").distinct(), others.select("q").distinct(), reach).select("p").distinct()
    return points.join(near, "p", "left_anti").select(*points.columns)


def merged_by_name(marks: DataFrame, records: DataFrame, reach: float = 45.0) -> DataFrame:
    """Each mark (id, name, p) with the first record (record_id, record_name, q, ord) of its name less than reach away,
    or with itself as a new record. Of records of a name at the same place only the first counts."""
    first = records.groupBy(F.col("record_name").alias("name"), "q").agg(F.min("ord").alias("ord"), F.min_by("record_id", "ord").alias("record_id"))
    places = marks.select("p", "name").distinct()
    near = near_pairs(places, first, reach, by=("name",)).groupBy("p", "name").agg(F.min_by("record_id", "ord").alias("found"))
    out = marks.join(near, ["p", "name"], "left")
    return out.select("id", "name", F.coalesce("found", "id").alias("record_id"), F.col("found").isNull().alias("added"))


def first_come(marks: DataFrame, reach: float = 45.0, by_name: bool = True) -> DataFrame:
    """(id, record_id) of marks(id, name, p, ord): in their order, a mark joins the first record (of its name) less than
    reach away, a record being an earlier mark that joined none; else it is a record itself. Marks (of a name) at the same
    place all lead where the first of them leads, so it alone is decided; those that lie nowhere are records."""
    by = ("name",) if by_name else ()
    placed = F.coalesce((F.abs("p.x") < float("inf")) & (F.abs("p.z") < float("inf")), F.lit(False)) & (F.col("name").isNotNull() if by_name else F.lit(True))
    at = marks.select("id", *by, "p", "ord", placed.alias("_placed"))
    first = cut(at.where("_placed").groupBy(*by, "p").agg(F.min(F.struct("ord", "id")).alias("_f")).select(F.col("_f.id").alias("id"), *by, "p", F.col("_f.ord").alias("ord")))
    other = first.select(F.col("id").alias("other"), *by, F.col("p").alias("q"), F.col("ord").alias("other_ord"))
    pairs = cut(near_pairs(first, other, reach, by=by).where("other_ord < ord or other_ord = ord and other < id").select("id", "other", "other_ord"))
    state = first_kept(first.select("id", F.struct("ord", "id").alias("order")), pairs)
    target = pairs.join(state.where("kept").select(F.col("id").alias("other")), "other").groupBy("id").agg(F.min_by("other", F.struct("other_ord", "other")).alias("record_id"))
    led = state.join(target, "id", "left").select("id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("record_id")).alias("record_id"))
    led = first.join(led, "id").select(*by, "p", "record_id")
    return at.where("_placed").join(led, [*by, "p"]).select("id", "record_id").unionByName(at.where("not _placed").select("id", F.col("id").alias("record_id")))


def nearest_by_name(marks: DataFrame, records: DataFrame, first: float = 128.0) -> DataFrame:
    """Each mark (id, name, p) with the nearest record (record_id, record_name, q, ord) of its name. Cells grow fourfold
    from round to round: a mark whose nearest record around its cell is nearer than a cell is wide is done, so a
    common name costs its near records, not all pairs. Marks of a name at the same place are asked about once, and of its
    records at one place the first is looked at. Marks that lie far from all records go down a pyramid of cells."""
    at = lambda p, size: (_cell(F.col(p)["x"], size).alias("cx"), _cell(F.col(p)["z"], size).alias("cz"))
    asked, marks = marks.select("id", "name", "p").distinct(), marks.select(F.struct("name", "p").alias("id"), "name", "p").distinct()
    records = cut(records.groupBy("record_name", "q").agg(F.min(F.struct("ord", "record_id")).alias("r")).select("r.record_id", "record_name", "q", "r.ord"))
    marks, size, done = marks.join(records.select(F.col("record_name").alias("name")).distinct(), "name", "left_semi"), first, []
    b = records.select(F.min("q.x").alias("a"), F.max("q.x").alias("b"), F.min("q.z").alias("c"), F.max("q.z").alias("d")).first()  # one row
    span = max(b["b"] - b["a"], b["d"] - b["c"]) if b["a"] is not None else 0.0
    while size <= span:
        there = records.select("record_id", F.col("record_name").alias("name"), "q", "ord", *at("q", size))
        around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
        mine = marks.select("id", "name", "p", *at("p", size)).withColumn("cx", around("cx")).withColumn("cz", around("cz"))
        best = mine.join(there, ["name", "cx", "cz"]).withColumn("d", geom.distance(F.col("p"), F.col("q"))).groupBy("id").agg(F.min(F.struct("d", "ord", "record_id")).alias("r"))
        done.append(cut(best.where(F.col("r.d") < size).select("id", "r.record_id")))
        marks = cut(marks.join(done[-1].select("id"), "id", "left_anti"))
        if marks.isEmpty():
            break
        size *= 4
    else:
        done.append(nearest_by_descent(marks, records, span))
    found = reduce(DataFrame.unionByName, done).select("id.name", "id.p", "record_id")
    return asked.join(found, ["name", "p"]).select("id", "record_id")


def nearest_by_descent(marks: DataFrame, records: DataFrame, span: float, finest: float = 1 / 32) -> DataFrame:
    """(id, record_id) as in nearest_by_name, by a pyramid: cells that have records of a name, with the bounds of those, each
    level four times as wide as the one below. A mark begins at the few cells of the top and goes down; of the cells below it
    keeps those that may hold a nearer record than any other cell must. Records are read in the finest cells that are left."""
    spots = records.groupBy(F.col("record_name").alias("name"), F.col("q.x").alias("x"), F.col("q.z").alias("z")).agg(F.min(F.struct("ord", "record_id")).alias("r"))
    spots = cut(spots.withColumn("cx", F.floor(F.col("x") / finest)).withColumn("cz", F.floor(F.col("z") / finest)))
    ends = lambda lo, hi: [F.min(f"{lo}x").alias("lx"), F.max(f"{hi}x").alias("hx"), F.min(f"{lo}z").alias("lz"), F.max(f"{hi}z").alias("hz")]
    levels, size = [cut(spots.groupBy("name", "cx", "cz").agg(*ends("", "")))], finest
    while size <= span:
        up = levels[-1].groupBy("name", F.shiftright("cx", 2).alias("cx"), F.shiftright("cz", 2).alias("cz")).agg(*ends("l", "h"))
        levels, size = [*levels, cut(up) if len(levels) % 4 == 0 else up], size * 4
    near = lambda k: F.greatest(F.lit(0.0), F.col(f"l{k}") - F.col(f"p.{k}"), F.col(f"p.{k}") - F.col(f"h{k}"))
    far = lambda k: F.greatest(F.abs(F.col(f"l{k}") - F.col(f"p.{k}")), F.abs(F.col(f"h{k}") - F.col(f"p.{k}")))

    def kept(cells: DataFrame) -> DataFrame:
        sure = F.min(F.hypot(far("x"), far("z"))).over(Window.partitionBy("id"))
        return cells.withColumn("_sure", sure).where(F.hypot(near("x"), near("z")) <= F.col("_sure") * (1 + 1e-9)).select("id", "name", "p", "cx", "cz")

    left = kept(marks.select("id", "name", "p").join(levels[-1], "name"))  # four cells a name at most
    for k, level in enumerate(reversed(levels[:-1])):
        below = level.withColumnsRenamed({"cx": "_cx", "cz": "_cz"}).withColumn("cx", F.shiftright("_cx", 2)).withColumn("cz", F.shiftright("_cz", 2))
        left = kept(left.join(below, ["name", "cx", "cz"]).drop("cx", "cz").withColumnsRenamed({"_cx": "cx", "_cz": "cz"}))
        left = cut(left) if k % 4 == 3 else left
    there = left.join(spots, ["name", "cx", "cz"]).withColumn("d", geom.distance(F.col("p"), geom.point(F.col("x"), F.col("z"))))
    return cut(there.groupBy("id").agg(F.min(F.struct("d", "r.ord", "r.record_id")).alias("r")).select("id", "r.record_id"))


def interval_lookup(points: DataFrame, ranges: DataFrame, keys: list[str], cell: int = 1 << 16) -> DataFrame:
    """Adds range_id, the range [start, end) of the same keys that holds pos, else null. Ranges don't overlap within
    the keys; starts and points are sorted together and the last start is carried on, so no range join is needed. That
    is done within cells of positions; the last start of each cell is carried on from cell to cell, a row each, so a
    key with many ranges is spread over tasks."""
    known = ranges.select(*keys, F.col("start").alias("pos"), F.lit(0).alias("_k"), F.struct("id", "end").alias("_r"), F.lit(None).cast("long").alias("_p"))
    asked = points.select(*keys, "pos", F.lit(1).alias("_k"), F.lit(None).cast(known.schema["_r"].dataType).alias("_r"), F.col("point_id").alias("_p"))
    place = F.floor(F.col("pos") / cell).alias("_c")
    both = known.unionByName(asked).withColumn("_c", place)
    lasts = both.groupBy(*keys, "_c").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("pos"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    order = Window.partitionBy(*keys, "_c").orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_k = 1")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "_c")]
    out = out.alias("o").join(lasts.withColumn("_before", before).select(*keys, "_c", "_before").alias("b"), same, "left")
    held = F.coalesce("_r", "_before")
    return out.select(F.col("_p").alias("point_id"), *[F.col(f"o.{c}") for c in keys], "pos", F.when(F.col("pos") < held["end"], held["id"]).alias("range_id"))
