"""Mixing sources to target weights with a low-discrepancy schedule, with DataFrame operations only.

Sizes are words. Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share FACTOR times all words; a
target stops at EPOCHS times its source's words, and the excess is shared again by weight until none is above. That
fixed point is found by one running sum over the sources, sorted by the level at which each would stop.

Schedule: slot k gets the point of the golden-ratio sequence, in integers, mapped through the cumulative targets to a
source. Slots are ranked per source in two steps (counts per stretch of slots, then within a stretch), so no task
ranks a whole source. A source that gets fewer slots than its blocks (its points come late) has the missing ones after
the schedule's end. Each source's documents, in the order of a hash of their ids, form a stream that is cut into
blocks of BLOCK words and repeated for each pass; the slot of rank r takes block r. Slots past a source's target are
unused and its last block is cut there, so what is taken equals the target's whole words, which is checked: a
difference is an error. The slot of a document's first word is its place in the mix (first_slot), and mixed() returns
rows in the order of their first slots, so that any stretch of the mix holds the sources in their shares. Streams are
laid out in two steps as well: sums per hash range, then within a range. Sources too, as there may be many (such as
hosts): their order and running sums are found per range of sources, then within a range. So neither a hot source nor
many sources meet in one task.

Null texts have no words and are never taken, nor are empty ones. Rows without an id are placed by a hash of their text.
An empty table gives no rows; long texts are whole. Repeated rows are documents each. The schedule
depends on ids, sources and sizes only, so reruns agree. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import pick, stored
from parcelwise.llm.sharding import BITS, id_hash

FACTOR, EPOCHS, WEIGHTS, BLOCK = 1.5, 2, (3, 1, 2), 256
STRETCH, RANGE, CELLS = 4096, 1024, 4096
WORD = r"[^\x20\x09-\x0D]+"
#: 2 ** 32 divided by the golden ratio, made odd.
GOLDEN = 2654435769


def _running(rows: DataFrame, order: list, sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds place (from 1) in an order, and before_<c>, the sum of c over the rows before, for whole numbers c. Rows are
    dealt out by range; only a row per range is brought together."""
    dealt, _ = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    each = dealt.groupBy("part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("_n", *(f"_{c}" for c in sums))])
    inner = Window.partitionBy("part").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(each), "part")  # a row per partition
    out = out.withColumn("place", F.row_number().over(inner) + F.col("_n"))
    return out.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_{c}") for c in sums}).drop("part", "_n", *(f"_{c}" for c in sums))


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, target) per source of sizes(source, size): sid counts sources in their order."""
    rows = _running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.asc_nulls_last("source")]).withColumnRenamed("place", "sid")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * EPOCHS).withColumn("r", F.col("cap") / F.col("w"))
    rows = _running(rows, ["r", "sid"], ("cap", "w"))
    whole = rows.agg(F.sum("w").alias("all_w"), (F.sum("source_size") * F.lit(FACTOR)).alias("total"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    rows = rows.withColumn("own", (F.col("total") - F.col("before_cap")) / (F.col("all_w") - F.col("before_w")))
    first = rows.where(F.col("own") <= F.col("r")).agg(F.min(F.struct("r", "sid", "own")).alias("first"))
    rows = rows.crossJoin(F.broadcast(first))  # one row
    over = F.col("first").isNull() | (F.struct("r", "sid") < F.struct(F.col("first.r"), F.col("first.sid")))
    return rows.select("sid", "source", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("first.own") * F.col("w"))).alias("target"))


def slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sid, rank, slot): the schedule's slots, each source's up to its target's whole words."""
    spark = sources.sparkSession
    edges = sources.select("sid", F.floor("target").cast("long").alias("words")).where("words > 0")
    count, words = edges.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()  # two numbers
    n = -(-words // block)
    n += n // 64 + 64 * (1 + math.ceil(math.log2(n + 1)))  # spare ones, as sources may run late
    cells = max(CELLS, 1 << (4 * count).bit_length())  # a few sources a cell
    edges = _running(edges, ["sid"], ("words",))
    upto = F.col("before_words") + F.col("words")
    edges = edges.select("sid", F.ceil(F.col("words") / block).alias("blocks"), (F.col("before_words") / F.lit(float(words))).alias("lo"), F.when(upto < words, upto / F.lit(float(words))).otherwise(2.0).alias("hi"))
    edges, _ = stored(edges, "edges")
    there = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells)))))
    point = (F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))).alias("u")
    line = spark.range(n).select("id", point).withColumn("cell", F.floor(F.col("u") * cells))
    mine = line.join(there, "cell").where("u >= lo and u < hi").select("sid", "blocks", "id", F.floor(F.col("id") / STRETCH).alias("stretch"))
    counts = _base(mine.groupBy("sid", "stretch").agg(F.count("*").alias("n")), "stretch").withColumnRenamed("base", "start")
    within = F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("id")) - 1
    ranked = mine.withColumn("within", within).join(counts, ["sid", "stretch"]).withColumn("rank", F.col("start") + F.col("within"))
    had = mine.groupBy("sid").agg(F.count("*").alias("had"))
    short = edges.join(had, "sid", "left").select("sid", "blocks", F.coalesce("had", F.lit(0).cast("long")).alias("had")).where("had < blocks").withColumn("late", F.col("blocks") - F.col("had"))
    short = _running(short, ["sid"], ("late",)).withColumn("rank", F.explode(F.sequence("had", F.col("blocks") - 1)))
    late = short.select("sid", "rank", (F.lit(n) + F.col("before_late") + F.col("rank") - F.col("had")).alias("slot"))
    return ranked.where("rank < blocks").select("sid", "rank", F.col("id").alias("slot")).union(late)


def _base(sums: DataFrame, place: str) -> DataFrame:
    """(sid, place, base) of sums(sid, place, n): the sum of n over the places of the same sid before. A running sum over
    all, less what it is where the sid begins, so that no sid's places meet in one task."""
    before, _ = stored(_running(sums.withColumnRenamed("n", "held"), ["sid", place], ("held",)).select("sid", place, "before_held"), "before")
    begin, _ = stored(before.groupBy("sid").agg(F.min("before_held").alias("begin")), "begin")  # so that a frequent sid can be split in the join
    return before.join(begin, "sid").select("sid", place, (F.col("before_held") - F.col("begin")).alias("base"))


def streams(sizes: DataFrame, n_docs: int) -> DataFrame:
    """Adds start: where each row of sizes(sid, h, doc_id, size) begins in its source's stream."""
    bits = max(0, math.ceil(math.log2(max(1, n_docs / RANGE))))
    rows = sizes.withColumn("range", F.expr(f"shiftright(h, {BITS - bits})"))
    sums = _base(rows.groupBy("sid", "range").agg(F.sum("size").alias("n")), "range")
    inner = Window.partitionBy("sid", "range").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["sid", "range"]).withColumn("start", F.col("base") + F.col("before")).drop("range", "before", "base")


def mixture(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents and the mix. Documents: (doc_id, sid, source, size, t, source_size, target, start) per row, t being a hash of the text. Mix:
    (slot, sid, doc_id, start, pass, from_word, to_word), a row per slot and stretch of a document it takes."""
    sizes = pick(docs, "doc_id", "source", "text").select("doc_id", F.col("source").cast("string").alias("source"), id_hash("doc_id", "text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("t"))
    sizes, _ = stored(sizes, "sizes")
    sources, _ = stored(targets(sizes), "targets")
    n_docs = sizes.count()
    known = sizes.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows, _ = stored(streams(known, n_docs), "streams")
    take = rows.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    take = take.withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.floor("target"))).where("lo < hi")
    cut = take.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    cut = cut.select("sid", "doc_id", "start", "pass", "rank", (F.greatest("lo", F.col("rank") * block) - F.col("lo")).alias("from_word"), (F.least("hi", (F.col("rank") + 1) * block) - F.col("lo")).alias("to_word"))
    mix = slots(sources, block).join(cut, ["sid", "rank"]).drop("rank")
    return rows, mix


def _used(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """(sid, start, pass, words, slot): the words that the mix takes of a document in a pass, and their first slot.
    Checks that each source's words are its target's whole ones."""
    got = mix.groupBy("sid", "start", "pass").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"), F.min("slot").alias("slot"))
    got, _ = stored(got, "used")
    want = rows.groupBy("sid").agg(F.floor(F.first("target")).alias("want"))
    off = want.join(got.groupBy("sid").agg(F.sum("words").alias("words")), "sid", "left").where(F.coalesce("words", F.lit(0)) != F.col("want"))
    if not off.isEmpty():
        raise RuntimeError(f"the mix misses its targets: {off.limit(5).collect()}")
    return got


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) for each row of docs(doc_id, source, text); first_slot is
    the document's place in the mix, null if nothing is taken."""
    rows, mix = mixture(docs, block)
    got = _used(rows, mix).groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = rows.join(got, ["sid", "start"], "left")  # words lie at one place of a stream; empty documents take none
    full = F.col("size") > 0
    return out.select("doc_id", "size", "source_size", "target", F.when(full, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), F.when(full, F.col("first_slot")).alias("first_slot"))


def mixed(docs: DataFrame, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(doc_id, source, text, *carry): a row per document and pass of which the mix takes words, in the mix's order. A
    text that is taken in part (where its source's target ends) is cut to its first words, joined by one space; texts
    taken as a whole stay as they are."""
    rows, mix = mixture(docs, block)
    got = _used(rows, mix)
    key = ["doc_id", "source", "t"]
    parts = rows.where("size > 0").join(got, ["sid", "start"]).groupBy(*key).agg(F.first("size").alias("size"), F.collect_list(F.struct("words", "slot")).alias("words"))
    parts = parts.toDF("k0", "k1", "k2", "size", "words")  # EPOCHS entries a row, for rows that aren't repeated
    texts = pick(docs, "doc_id", "source", "text", *carry).withColumn("source", F.col("source").cast("string")).withColumn("t", F.xxhash64("text"))
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(key)
    same = F.col("doc_id").eqNullSafe(F.col("k0")) & F.col("source").eqNullSafe(F.col("k1")) & (F.col("t") == F.col("k2"))
    out = texts.join(parts, same).withColumn("use", F.explode("words")).withColumn("words", F.col("use.words"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("words").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))).withColumn("slot", F.col("use.slot"))
    order = ["slot", "doc_id", "k2"]  # documents of one block stand together
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", "text", *carry)
