"""Operators that decide or number rows in several steps, so that no key or order meets in one task."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Links of a component that one task settles.
BOUND = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A temporary one only where none is set and Spark
    runs on this machine alone; elsewhere that is an error, as executors don't see each other's disks."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parcelwise-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed and written to the shared folder. Cuts the lineage between rounds."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def first_kept(rows: DataFrame, pairs: DataFrame, bound: int = BOUND, tries: int = 3) -> DataFrame:
    """(id, kept) of rows(id, order): in that order, a row is kept unless one before it that is kept stands against it.
    pairs(id, other): what stands against each row, and comes before it.

    A few rounds decide what they can: a row with a kept one before it is out; one whose every one before it is out is kept.
    What is open then goes on as links (id, other, odd): id is out if any of its links holds, a link holding where other is
    kept, or isn't, if odd. A row with one link is its other's opposite, or equal; such chains are followed to their ends by
    pointers that double in length with each round, and their rows are replaced by their ends in all links. So a chain of n
    rows takes log(n) rounds. Components of up to `bound` links are settled within a task each; of a larger one, those rows
    that come first, with as many links, which depend on nothing later."""
    state = rows.select("id", F.lit(None).cast("boolean").alias("kept"))
    for _ in range(tries):
        seen = pairs.join(state.select(F.col("id").alias("other"), F.col("kept").alias("theirs")), "other")
        seen = seen.groupBy("id").agg(F.bool_or(F.coalesce("theirs", F.lit(False))).alias("near"), F.count_if(F.col("theirs").isNull()).alias("open"))
        now = F.coalesce("kept", F.when(F.col("near"), False).when(F.coalesce("open", F.lit(0)) == 0, True))
        state = cut(state.join(seen, "id", "left").select("id", now.alias("kept")))
        if state.where("kept is null").isEmpty():
            return state
    left = state.where("kept is null").select("id")
    theirs = state.select(F.col("id").alias("other"), F.col("kept").alias("theirs"))
    links = pairs.join(left, "id").join(theirs, "other").where("theirs is null or theirs").select("id", F.when(F.col("theirs").isNull(), F.col("other")).alias("other"), F.lit(False).alias("odd"))
    order, settled, ends = rows.join(left, "id").select("id", "order"), [], []
    links = _simple(links)
    while not links.isEmpty():
        chains = _chains(links)
        if not chains.isEmpty():
            ends.append(chains)
            links = _simple(_replaced(links.join(chains.select("id"), "id", "left_anti"), chains))
            if links.isEmpty():
                break
        of = components(links.where("other is not null").select("id", "other"))
        held = links.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
        size = held.groupBy("component", "id").agg(F.count("*").alias("n")).groupBy("component").agg(F.sum("n").alias("links"), F.max("n").alias("most"))
        held = cut(held.join(size, "component"))
        done = [_settled(held.where(F.col("links") <= bound))]
        large = held.where(F.col("links") > bound)
        if not large.isEmpty():
            first = numbered(large.select("component", "id", "most").distinct().join(order, "id"), ["component"], ["order"]).where(F.col("n") <= F.greatest(F.lit(1), F.floor(bound / F.col("most"))))
            done.append(_settled(large.join(first.select("id"), "id", "left_semi")))
        known = cut(done[0] if len(done) == 1 else done[0].unionByName(done[1]))
        settled.append(known)
        fixed = known.select("id", F.lit(None).cast(links.schema["other"].dataType).alias("to"), (~F.col("kept")).alias("flip"))
        links = _simple(_replaced(links.join(known.select("id"), "id", "left_anti"), fixed))
    found = reduce(DataFrame.unionByName, settled) if settled else None
    for chains in reversed(ends):
        theirs = chains.select("id", F.lit(None).cast("boolean").alias("theirs"), "flip") if found is None else chains.join(found.withColumnsRenamed({"id": "to", "kept": "theirs"}), "to", "left").select("id", "theirs", "flip")
        more = cut(theirs.select("id", (F.coalesce("theirs", F.lit(True)) != F.col("flip")).alias("kept")))  # nothing stands against an end without links
        found = more if found is None else found.unionByName(more)
    if found is None:
        return state.select("id", F.coalesce("kept", F.lit(True)).alias("kept"))
    return state.join(found.withColumnRenamed("kept", "later"), "id", "left").select("id", F.coalesce("kept", "later", F.lit(True)).alias("kept"))


def _simple(links: DataFrame) -> DataFrame:
    """Links without repetitions and without what is known: no other means one that is kept, as is one without links of its
    own; links that can't hold go, and a row of which one must hold has that one only."""
    own = links.select(F.col("id").alias("other"), F.lit(True).alias("_open")).distinct()
    each = links.join(own, "other", "left").select("id", F.when(F.col("_open"), F.col("other")).alias("other"), "odd")
    each = each.groupBy("id", "other").agg(F.min("odd").alias("odd"), F.max("odd").alias("_most"))
    each = cut(each.withColumn("_holds", (F.col("odd") != F.col("_most")) | (F.col("other").isNull() & ~F.col("odd"))))
    out = each.where("_holds").select("id").distinct()
    kept = each.where("not _holds and other is not null").select("id", "other", "odd").join(out, "id", "left_anti")
    return cut(kept.unionByName(out.select("id", F.lit(None).cast(links.schema["other"].dataType).alias("other"), F.lit(False).alias("odd"))))


def _chains(links: DataFrame) -> DataFrame:
    """(id, to, flip) of rows with one link: kept as `to` is, or the opposite if flip; `to` has several links or is null."""
    chains = cut(links.groupBy("id").agg(F.count("*").alias("n"), F.first("other").alias("to"), F.first("odd").alias("odd")).where("n = 1").select("id", "to", (~F.col("odd")).alias("flip")))
    while True:
        further = chains.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("flip").alias("_flip"), F.lit(True).alias("_on"))
        longer = cut(chains.join(further, "to", "left").select("id", F.when(F.col("_on"), F.col("_to")).otherwise(F.col("to")).alias("to"), (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"), F.coalesce("_on", F.lit(False)).alias("_on")))
        chains = longer.select("id", "to", "flip")
        if longer.where("_on and to is not null").isEmpty():
            return chains


def _replaced(links: DataFrame, by: DataFrame) -> DataFrame:
    """Links to rows of by(id, to, flip) as links to what those are replaced by."""
    b = by.select(F.col("id").alias("other"), "to", "flip", F.lit(True).alias("_on"))
    return links.join(b, "other", "left").select("id", F.when(F.col("_on"), F.col("to")).otherwise(F.col("other")).alias("other"), (F.col("odd") != F.coalesce("flip", F.lit(False))).alias("odd"))


def _settled(held: DataFrame) -> DataFrame:
    """(id, kept) of rows whose links lead to rows of their component only."""
    kind = held.schema["id"].dataType.simpleString()
    texts = held.select("component", F.to_json(F.struct("id")).alias("key"), F.when(F.col("other").isNotNull(), F.to_json(F.struct(F.col("other").alias("id")))).alias("other"), "odd")
    return texts.groupBy("component").applyInPandas(_settle, "key string, kept boolean").select(F.from_json("key", f"struct<id:{kind}>")["id"].alias("id"), "kept")


def _settle(held):
    import pandas as pd

    links: dict[str, list[tuple[str | None, bool]]] = {}
    for key, other, odd in zip(held["key"], held["other"], held["odd"], strict=True):
        links.setdefault(key, []).append((other, bool(odd)))
    kept: dict[str | None, bool] = {None: True}
    for start in links:
        todo = [start]
        while todo:
            key = todo[-1]
            open_ = [o for o, _ in links.get(key, ()) if o not in kept]
            if open_:
                todo += open_[:1]
                continue
            kept[key] = not any(kept[o] != odd for o, odd in links.get(key, ()))
            todo.pop()
    return pd.DataFrame({"key": list(links), "kept": [kept[k] for k in links]})


def components(links: DataFrame) -> DataFrame:
    """(id, component) of links(id, other): the smallest id that each reaches. In each round a row's larger neighbours, then
    its smaller ones, are linked to its smallest neighbour, until nothing changes: rounds are logarithmic."""
    mark, edges = None, cut(links.where("id <> other").select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        now = cut(large.join(least, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.*").where("u <> v").distinct())
        seen, edges = mark, now
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # two numbers
        if mark == seen:
            break
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(edges.select("v", F.col("v")).distinct())


def _dealt(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows dealt out by ranges of keys and order, with the number of their range, _part; written, so that it stays."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def _ahead(dealt: DataFrame, keys: list[str], ranges: DataFrame, columns: list) -> DataFrame:
    """Rows r beside what is known of their range (a row for each of the keys and ranges), r's columns and those given."""
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_part")]
    return dealt.alias("r").join(ranges.alias("c"), same).select(*columns)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """Adds a row's number (from 1) in an order within its keys."""
    one = running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name)
    return one.select(*df.columns, F.col(name).cast("long").alias(name))


def running(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of a value up to each row, itself included, in an order within its keys. What comes before a range is
    the sum of those before, a row per key and range, and rows are summed within ranges; so no key is one task's."""
    dealt = _dealt(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_held")).select(*keys, "_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_ahead"))
    own = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _ahead(dealt.withColumn("_own", own), keys, sums, [*[F.col(f"r.{c}") for c in df.columns], (F.col("_ahead") + F.col("_own")).alias(name)])


def preceding(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the value of the row before each in an order within its keys, null for the first. The first row of a range has
    the last value of the range before."""
    dealt = _dealt(df, keys, [order])
    lasts = dealt.groupBy(*keys, "_part").agg(F.max_by(value, order).alias("_last")).select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_before"))
    own = F.lag(value).over(Window.partitionBy(*keys, "_part").orderBy(order))
    return _ahead(dealt.withColumn("_own", own), keys, lasts, [*[F.col(f"r.{c}") for c in df.columns], F.coalesce("_own", "_before").alias(name)])
