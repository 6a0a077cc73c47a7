"""MinHash near-duplicate detection with tensored banding.

A document's set holds the 64-bit hashes of its distinct shingles of five words (lower-cased A-Z). Two collections
of HALF half-keys each, of R min-hashes a half-key, give HALF * HALF table keys: key (i, j) combines half-key i of
the first collection with half-key j of the second. So 2 * HALF * R min-hashes serve HALF ** 2 tables of 2 * R
min-hashes each. With R = 2 and HALF = 10, a pair of similarity 0.75 shares a key with probability 0.9995, one of
0.8 with 0.9999. Every candidate is verified on full sets.

Scale and skew. Equal sets are collapsed to one representative first, by an aggregation. A half-key that one
representative alone holds cannot be part of a shared key, so only shared half-keys are combined (exact, and it
drops most documents before the tables). Buckets are only ever grouped by partial aggregates. First each member of a
bucket is compared with one that every task agrees on, that of the smallest salted hash, which is the same in most
buckets of a group: a row per document and distinct leader, linear at any size. What is in one component then needs no
further comparison; every other pair of a bucket of three or more is compared exactly: the members are grouped by
their half-keys of the first collection, dealt into chunks, and each task compares one chunk with another on full sets,
a pair in the first half-key it shares alone. So every pair that shares a key is compared unless it is linked already,
in buckets of any size. Members of a group's most frequent component are not compared with each other; the work for
the rest grows with their number times the group's size, the rows that are made with that over CHUNK.

Null, empty and wordless texts have an empty set and link with nothing; an empty table gives no rows. Long texts are
read whole, each in one piece of its batch. Rows without doc_id link with nothing and
keep a null component; repeated rows of one doc_id count as one document (their shingles' union is not taken: any
row's links count, and its rows are in one component). Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import by_text, components, drop_path, give_back, grams, hash_words, mix, pick, small_batches, stored, text_buffer

SHINGLE, R, HALF = 5, 2, 10
#: Members and shingles of a chunk, about; columns that are multiplied at once.
CHUNK, WEIGHT, COLUMNS = 256, 1 << 17, 4096
_A = np.random.default_rng(7).integers(1, 1 << 62, 2 * HALF * R, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than n words is one shingle."""
    _, _, words, first = hash_words(raw, at, lower=True)
    g = grams(words, n, 11)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(g[lo : hi - n + 1]))
        elif hi > lo:
            short = grams(words[lo:hi], hi - lo, 100 + hi - lo)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(part: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(*text_buffer(part.column("text")))
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    keys = np.zeros((len(sets), 2 * HALF), np.int64)
    one = np.zeros(len(sets), np.int64)
    two = np.zeros(len(sets), np.int64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        one[full] = np.add.reduceat(flat, begin).view(np.int64)
        two[full] = np.bitwise_xor.reduceat(flat * _A[0], begin).view(np.int64)
        low = np.stack([np.minimum.reduceat(x ^ (x >> np.uint64(29)), begin) for x in (flat * a for a in _A)], 1)
        half = np.zeros((len(full), 2 * HALF), np.uint64)
        for r in range(R):
            half = mix(half * np.uint64(31) + low[:, r::R] + np.uint64(r))
        keys[full] = half.view(np.int64)
    lists = [None if not s else k for s, k in zip(sizes.tolist(), keys.tolist(), strict=True)]
    return pa.record_batch([part.column("doc_id"), pa.array(sizes), pa.array(one), pa.array(two), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "h1", "h2", "keys"])


def _verify(threshold: tuple[int, int]):
    num, den = threshold

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        a = shingle_sets(*text_buffer(part.column("text_a")))
        b = shingle_sets(*text_buffer(part.column("text_b")))
        keep = []
        for x, y in zip(a, b, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
        return part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Each side's text is joined by id (no copy of a text is
    gathered for a group as a whole); skewed ids are split by the adaptive skew join."""
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(by_text("text_a", _verify(threshold)), "a long, b long")


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a (rows) with sets b (columns)."""
    sizes = np.array([len(x) for x in sets])
    _, of, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    some = held[of] > 1
    row, of = row[some], (np.cumsum(held > 1) - 1)[of[some]]
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    out = np.zeros((len(a), len(b)), np.float32)  # whole numbers below 2 ** 24
    for lo in range(0, int(of[-1]) + 1 if len(of) else 0, COLUMNS):
        i, j = np.searchsorted(of, [lo, lo + COLUMNS])
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[row[i:j], of[i:j] - lo] = 1
        out += there[a] @ there[b].T
    return out.astype(np.int64)


def _across(threshold: tuple[int, int]):
    """Links between components among rows that come task by task (part, lo, hi)."""
    num, den = threshold

    def links(rows: pa.Table) -> pa.RecordBatch:
        doc, comp, n, chunk = (rows.column(c).to_numpy() for c in ("doc", "c", "n", "chunk"))
        lo, hi, i = (rows.column(c)[0].as_py() for c in ("lo", "hi", "i"))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, 2 * HALF)
        a, b = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        want = (comp[a][:, None] != comp[b]) & (den * np.minimum(n[a][:, None], n[b]) >= num * np.maximum(n[a][:, None], n[b]))
        if lo == hi:
            want = np.triu(want, 1)
        for k in range(i + 1):  # a pair belongs to the first half-key it shares
            want &= (keys[a, k][:, None] == keys[b, k]) == (k == i)
        if want.any():
            two = np.zeros(want.shape, bool)
            for k in range(HALF, 2 * HALF):
                two |= keys[a, k][:, None] == keys[b, k]
            want &= two
        x, y = np.nonzero(want)
        if len(x):
            used = np.unique(np.concatenate([a[x], b[y]]))
            sets = shingle_sets(*text_buffer(rows.column("text").combine_chunks().take(pa.array(used))))
            sizes = np.array([len(s) for s in sets])
            ax, by = np.searchsorted(used, a[x]), np.searchsorted(used, b[y])
            left, right = np.unique(ax), np.unique(by)
            both = _common(sets, left, right)[np.searchsorted(left, ax), np.searchsorted(right, by)]
            good = (both > 0) & (den * both >= num * (sizes[ax] + sizes[by] - both))
            x, y = a[x[good]], b[y[good]]
        return pa.record_batch([pa.array(np.minimum(doc[x], doc[y])), pa.array(np.maximum(doc[x], doc[y]))], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "lo", "hi")])
            first = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(first[:-1], first[1:], strict=True):
                now = tuple(keys[:, at].tolist())
                if held and now != last:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                last = now
        if held:
            yield links(pa.Table.from_batches(held))
        give_back()

    return run


def _rest(large: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, str]:
    """Links (a, b) among large(doc, n, i, part) between members of one part that are not in one component, and the path
    of a table that they read."""
    comp = found.select(F.col("id").alias("doc"), F.col("component"))
    own = large.join(comp, "doc", "left").select("doc", "n", "i", "part", F.coalesce("component", "doc").alias("c"))
    each = own.groupBy("part", "c").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    parts = each.groupBy("part").agg(
        F.max(F.struct("size", "c", "weight")).alias("main"), F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("comps")
    ).where("comps > 1")
    chunks = lambda size, weight: F.ceil(F.greatest(size / CHUNK, weight / WEIGHT))
    parts = parts.select("part", F.col("main.c").alias("main"), chunks(F.col("size") - F.col("main.size"), F.col("weight") - F.col("main.weight")).alias("others"), chunks(F.col("main.size"), F.col("main.weight")).alias("mains"))
    parts, path = stored(parts, "parts")  # so that a hot part's members can be split in the join
    dealt = own.join(parts, "part").withColumn("open", F.col("c") != F.col("main"))
    deal = F.xxhash64("doc", F.lit(1))
    dealt = dealt.withColumn("chunk", F.when(F.col("open"), F.pmod(deal, "others")).otherwise(F.col("others") + F.pmod(deal, "mains")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("open"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1)))
    rows = dealt.select("doc", "n", "c", "i", "part", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    full = rows.join(reps.select("doc", "n", "keys"), ["doc", "n"]).join(texts, "doc").repartition("part", "lo", "hi").sortWithinPartitions("part", "lo", "hi")
    return full.select("part", "lo", "hi", "i", "doc", "n", "c", "chunk", "keys", "text").mapInArrow(_across(threshold), "a long, b long"), path


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    num, den = threshold
    small_batches(docs.sparkSession)
    sig, _ = stored(docs.mapInArrow(by_text("text", _signatures), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "signatures")
    there = sig.where("doc_id is not null and n_shingles > 0")
    copies = there.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"))
    reps = copies.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), "keys")
    half = reps.select("doc", "n", F.posexplode("keys").alias("i", "key"))
    shared = half.groupBy("i", "key").agg(F.count("*").alias("held")).where("held > 1")
    mine = half.join(shared, ["i", "key"]).groupBy("doc", "n").agg(
        F.collect_list(F.when(F.col("i") < HALF, F.struct("i", "key"))).alias("one"),
        F.collect_list(F.when(F.col("i") >= HALF, F.struct("i", "key"))).alias("two"),
    )  # at most HALF entries a side
    rows, rows_at = stored(
        mine.select("doc", "n", F.explode("one").alias("x"), "two").select("doc", "n", "x", F.explode("two").alias("y"))
        .select("doc", "n", F.col("x.i").alias("i"), F.xxhash64("x.i", "x.key").alias("part"), F.xxhash64("x.i", "x.key", "y.i", "y.key").alias("bucket")),
        "tables",
    )
    member = F.struct("doc", "n")
    lead = F.min_by(member, F.struct(F.xxhash64("doc", F.lit(0)), "doc"))
    stats, stats_at = stored(rows.groupBy("bucket").agg(F.count("*").alias("size"), lead.alias("leader")).where("size > 1"), "buckets")
    # A document's buckets are brought together (at most HALF ** 2), so that what they have in common is one row.
    led = rows.select("doc", "n", "bucket").join(stats.select("bucket", "leader"), "bucket").groupBy("doc", "n").agg(F.collect_set("leader").alias("leaders"))
    led = led.select(member.alias("x"), F.explode("leaders").alias("y"))

    def candidates(df: DataFrame) -> DataFrame:
        fits = f"x.doc <> y.doc and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)"
        return df.where(fits).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()

    pairs, pairs_at = stored(candidates(led), "pairs")
    repeated = sig.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeats = not repeated.isEmpty()
    texts = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]) if repeats else docs
    links = _confirmed(pairs, texts, threshold)
    if repeats:  # a document's texts hold its copies together
        same = there.join(repeated, "doc_id").join(copies.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"]).where("doc_id <> rep")
        links = links.union(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    links, links_at = stored(links, "links")
    found, found_at = stored(components(links), "found")

    some = stats.where("size > 2").select("bucket")
    large, large_at = stored(rows.join(some, "bucket").select("doc", "n", "i", "part").distinct(), "large")
    more, parts_at = _rest(large, found, reps, texts, threshold)
    more, more_at = stored(more, "links")
    gone = [rows_at, stats_at, pairs_at, links_at, large_at, parts_at, more_at]
    if not more.isEmpty():
        gone.append(found_at)
        found, _ = stored(components(links.union(more)), "found")
    for path in gone:  # the result reads the signatures and the components only
        drop_path(docs.sparkSession, path)
    whole = copies.select("h1", "h2", "n_shingles", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sig.join(whole, ["h1", "h2", "n_shingles"], "left")
    if repeats:  # an empty row goes with the document's others
        out = out.join(found.select(F.col("id").alias("doc_id"), F.col("component").alias("own")), "doc_id", "left").withColumn("component", F.coalesce("own", "component"))
    ident = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", ident.alias("component_id"), F.coalesce(ident == F.col("doc_id"), F.lit(False)).alias("kept"))

