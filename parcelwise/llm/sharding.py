"""Sharding by extendible hashing, with DataFrame operations only.

A document's hash is 60 bits of the MD5 of its id. The directory is indexed by hash-prefix bits and starts with none:
one bucket holds everything, and only oversized buckets split on another bit until every shard fits, however uneven
the sizes. Instead of a pass per bit, bytes are summed once per fine prefix (STEP more bits than equal sizes would
need), and the sums of all depths above come from that table in two bands: the coarse depths from sums of sums, the
fine ones, for what is still too large, from the fine table. A fine prefix belongs to the first depth that fits;
documents are read again only for fine prefixes that are still too large. Documents and their prefixes' depths are
brought together by a shuffle join: the directory grows with the data, so it is not broadcast.

A bucket that holds one hash only can't split further: a single document larger than the limit is a shard of its
own, and rows that repeat one id beyond the limit are dealt to numbered pages of at most the limit each (overflow
pages), in the order of their sizes.

Null texts have no bytes; rows without an id hash by their text, so they don't meet in one bucket. An empty table gives
no rows; texts are never cut, however long. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import pick, stored

BITS, STEP, LIMIT = 60, 6, 1 << 20


def id_hash(column: str, text: str) -> Column:
    """60 bits of the MD5 of an id's digits, as a long; those of a text's MD5, where there is no id."""
    unknown = F.concat(F.lit("-"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), unknown).cast("binary")), 1, 15), 16, 10).cast("long")


def _up(column: str, by) -> Column:
    return F.expr(f"shiftright({column}, cast({by} as int))")


def _band(prefixes: DataFrame, lo: int, hi: int, limit: int) -> DataFrame:
    """For each of prefixes(prefix, n, lo, hi) of hi bits: the first depth of lo to hi at which its bucket fits and that
    bucket's bytes, as leaf; null if there is none."""
    deep = prefixes.select("prefix", "n", "lo", "hi", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("depth")).withColumn("at", _up("prefix", f"{hi} - depth"))
    sums = deep.groupBy("depth", "at").agg(F.sum("n").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "at", "shard_bytes")
    found = deep.select("prefix", "depth", "at").join(fits.hint("merge"), ["depth", "at"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
    return prefixes.join(found.hint("merge"), "prefix", "left")


def _leaves(rows: DataFrame, done: int, bits: int, limit: int) -> DataFrame:
    """(fine, leaf) for each prefix of `bits` bits of rows(h, n) whose buckets are too large down to the depth `done`
    (-1: none is looked at yet); leaf is null where they are too large at `bits` bits as well."""
    table = rows.groupBy(_up("h", BITS - bits).alias("prefix")).agg(F.sum("n").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    split = max(done, bits - 2 * STEP)
    if split > done:
        table, _ = stored(table, "prefixes")
        top = table.groupBy(_up("prefix", bits - split).alias("top")).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        top = _band(top.withColumnRenamed("top", "prefix"), done + 1, split, limit).select(F.col("prefix").alias("top"), F.col("leaf").alias("over"))
        table = table.withColumn("top", _up("prefix", bits - split)).join(top.hint("merge"), "top")
        coarse = table.where("over is not null").select(F.col("prefix").alias("fine"), F.col("over").alias("leaf"))
        table = table.where("over is null").select("prefix", "n", "lo", "hi")
    else:
        coarse = None
    fine = _band(table, split + 1, bits, limit).select(F.col("prefix").alias("fine"), "leaf")
    return fine.unionByName(coarse) if coarse is not None else fine


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page, shard_bytes) for each row of docs(doc_id, text); a shard is (depth,
    prefix, page), with shard_bytes bytes in all."""
    rows = pick(docs, "doc_id", "text").select("doc_id", id_hash("doc_id", "text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    rows, _ = stored(rows, "sizes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    even = math.ceil(math.log2(total / limit)) if total > limit else 0
    done, bits, known = [], min(BITS, even + STEP), -1
    left = rows
    while True:
        leaves, _ = stored(_leaves(left, known, bits, limit), "directory")
        found = left.withColumn("fine", _up("h", BITS - bits)).join(leaves.hint("merge"), "fine").select("doc_id", "h", "n", "leaf.depth", "leaf.shard_bytes")
        done.append(found.where("depth is not null"))
        if leaves.where("leaf is null").isEmpty():
            break
        left, _ = stored(found.where("depth is null").select("doc_id", "h", "n"), "oversized")
        known, bits = bits, min(BITS, bits + STEP)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    whole = out.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    # One hash only: the rows of one id.
    over = out.where(F.col("shard_bytes") > limit)
    # As many rows to a page as the largest of them allows, one at least.
    held = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("n").over(Window.partitionBy("h")), F.lit(1))))
    place = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("n")))
    over = over.withColumn("held", held).withColumn("page", F.floor((place - 1) / F.col("held"))).drop("held")
    over = over.withColumn("shard_bytes", F.sum("n").over(Window.partitionBy("h", "page")))
    return whole.unionByName(over).select("doc_id", F.col("n").alias("n_bytes"), F.col("depth").cast("int"), F.expr(f"shiftright(h, cast({BITS} - depth as int))").alias("prefix"), "page", "shard_bytes")
