"""Embedding near-duplicates by lattice hashing.

Each of TABLES tables projects the unit vector on eight random orthogonal directions, scales and shifts it, and
decodes it to the nearest point of the E8 lattice (its home cell); PROBES neighbouring lattice points that lie
nearest to the projection are probed too. A pair is compared if in some table both are in one cell, as home or probe,
and some vector has it as home; all comparisons are cosines in double precision. At cosine 0.98 one table misses about
a tenth of the pairs (measured on the test tables), six tables about one in a million; more similar ones, fewer. SCALE
is for 64 components; for shorter vectors, whose projections keep more of a distance, it shrinks with the root of their
length (eight at least), so that they miss no more. Longer ones miss fewer, as their projections are closer together.

Equal vectors are collapsed to classes first, by 128 bits of hash, so copies cost no comparison. Cells are counted by
partial aggregation; only classes of cells that others share go on. Cells of more than CHUNK members are dealt into
chunks, and each task compares one chunk with another, so a hot cell spreads over tasks and no task holds more than
two chunks. A pair that shares several cells belongs to the smallest of them and counts there alone. Links are never
rows: a task adds up each class's links, and gives the edges of a star for each group that it finds connected.

An empty table gives no rows. Vectors that are null, zero or hold null or non-finite components, and rows with a null label or vec_id, link with
nothing; vectors of unequal lengths don't either. Vectors are scaled by their largest component before they are
normed, so that none is too small or large. Repeated rows of one vec_id and vector count once. A vec_id that comes
with several vectors is one node of the components, and its vectors don't link with each other; n_links is each row's
own vector's, counting other ids' vectors. Labels that aren't whole numbers are compared by 64 bits of hash. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import components, drop_path, mix, pick, small_batches, stored

TABLES, PROBES, SCALE, CHUNK = 6, 6, 3.2, 256
_NONE = np.iinfo(np.int64).min


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    r = np.floor(x + 0.5)
    d = x - r
    odd = np.flatnonzero(r.sum(1) % 2)
    k = np.abs(d[odd]).argmax(1)
    r[odd, k] += np.where(d[odd, k] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: the nearer of D8 and D8 shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cells(points: np.ndarray, table: int) -> np.ndarray:
    key = np.full(points.shape[:-1], table + 1, np.uint64)
    for i in range(8):
        key = mix(key * np.uint64(31) + (points[..., i] * 2).astype(np.int64).view(np.uint64))
    return key


def _table(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([table, dim])
    wide = rng.normal(size=(max(dim, 8), 8))
    return np.linalg.qr(wide)[0][:dim] * np.sqrt(8) * min(1.0, np.sqrt(max(dim, 8) / 64)), rng.uniform(0, 1, 8)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows whose vector has finite components only, by length: row numbers and a matrix in double precision."""
    offs = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64())
    finite = np.isfinite(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False))
    data = np.nan_to_num(flat.fill_null(0).to_numpy(zero_copy_only=False))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    n = np.diff(offs)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    good = there & (n > 0) & (bad[offs[1:]] == bad[offs[:-1]])
    out = {}
    for d in np.unique(n[good]).tolist():
        rows = np.flatnonzero(good & (n == d))
        out[d] = rows, data[offs[rows][:, None] + np.arange(d)]
    return good, out


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that aren't zero, and their unit vectors."""
    most = np.abs(x).max(1)
    rows = np.flatnonzero(most > 0)
    x = x[rows] / most[rows][:, None]
    return rows, x / np.sqrt((x * x).sum(1))[:, None]


def _digests(batches):
    """(vec_id, label, d1, d2) of all rows; d1 and d2 are null for what links with nothing."""
    for batch in batches:
        out = np.zeros((2, batch.num_rows), np.uint64)
        there = np.zeros(batch.num_rows, bool)
        for dim, (rows, x) in vectors_of(batch.column("embedding"))[1].items():
            rows, x = rows[(x != 0).any(1)], np.ascontiguousarray(x[(x != 0).any(1)] + 0.0)  # -0.0 is 0.0
            place = mix(np.arange(2 * dim, dtype=np.uint64) + np.uint64(dim << 20)).reshape(2, dim)
            for k in range(2):
                out[k, rows] = mix(x.view(np.uint64) + place[k]).sum(1, dtype=np.uint64)
            there[rows] = True
        there &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), *[pa.array(h.view(np.int64), mask=~there) for h in out]], names=["vec_id", "label", "d1", "d2"])


def _buckets(batches):
    """(bucket, vec_id, d1, home): the cells of (vec_id, d1, label, embedding)."""
    short = _minimal()
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            ids, d1, labels = (part.column(c).to_numpy() for c in ("vec_id", "d1", "label"))
            for dim, (rows, x) in vectors_of(part.column("embedding"))[1].items():
                some, x = units(x)
                rows = rows[some]
                if not len(rows):
                    continue
                for t in range(TABLES):
                    turn, shift = _table(t, dim)
                    p = x @ turn * SCALE + shift
                    home = decode_e8(p)
                    far = ((p - home)[:, None, :] - short[None]) ** 2
                    near = short[np.argpartition(far.sum(2), PROBES, axis=1)[:, :PROBES]]
                    cells = np.concatenate([home[:, None, :], home[:, None, :] + near], 1)
                    key = mix(_cells(cells, t) + mix(labels[rows].astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(dim))[:, None])
                    own = np.zeros(key.shape, bool)
                    own[:, 0] = True
                    yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[rows], PROBES + 1)), pa.array(np.repeat(d1[rows], PROBES + 1)), pa.array(own.ravel())], names=["bucket", "vec_id", "d1", "home"])


class _Links:
    """What a task has found: links by class, and which root each class hangs on."""

    names = ("vec_id", "d1", "root", "links")

    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, d1: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Links of rows i with rows j."""
        if not len(i):
            return
        names, at = np.unique(ids, return_inverse=True)
        a, b, root = at[i], at[j], np.arange(len(names))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        links = np.bincount(i, size[j], len(ids)) + np.bincount(j, size[i], len(ids))
        rows = np.flatnonzero(links)
        self.rows.append((ids[rows], d1[rows], names[root[at[rows]]], links[rows].astype(np.int64)))
        self.size += len(rows)

    def flush(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.rows, strict=True)] if self.rows else [np.zeros(0, np.int64)] * 4
        self.rows, self.size = [], 0
        found = pa.table(dict(zip(self.names, map(pa.array, columns), strict=True))).group_by(list(self.names[:3])).aggregate([("links", "sum")])
        return pa.record_batch([found.column(c).combine_chunks() if found.num_rows else pa.array([], pa.int64()) for c in (*self.names[:3], "links_sum")], names=list(self.names))


def _first_shared(keys: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j share no smaller cell than the one they are in. keys: a row's cells, filled up with _NONE."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 2048):
        a, b = keys[i[k : k + 2048]], keys[j[k : k + 2048]]
        same = ((a[:, :, None] == b[:, None, :]) & (a != _NONE)[:, :, None]).any(2)
        out[k : k + 2048] = np.where(same, a, np.iinfo(np.int64).max).min(1) == bucket[i[k : k + 2048]]
    return out


def _share_smaller(keys: np.ndarray, bucket: int) -> np.ndarray:
    """Which rows share a cell that is smaller than the one they are all in."""
    values, of, count = np.unique(keys, return_inverse=True, return_counts=True)
    use = (count > 1) & (values < bucket) & (values != _NONE)
    column, of = np.cumsum(use) - 1, of.ravel()
    row, at = np.repeat(np.arange(len(keys)), keys.shape[1])[use[of]], column[of[use[of]]]
    out = np.zeros((len(keys), len(keys)), bool)
    for lo in range(0, int(use.sum()), 4096):
        there = np.zeros((len(keys), 4096), np.float32)
        some = (at >= lo) & (at < lo + 4096)
        there[row[some], at[some] - lo] = 1
        there = there[:, : int(use.sum()) - lo]
        out |= there @ there.T > 0
    return out


def _compare(least: float):
    def links(group: pa.Table, found: _Links) -> None:
        """Links among rows that lie group by group."""
        n = group.num_rows
        ids, d1, label, chunk, size, bucket = (group.column(c).to_numpy() for c in ("vec_id", "d1", "label", "chunk", "size", "bucket"))
        cross = group.column("lo").to_numpy() != group.column("hi").to_numpy()
        marks = np.stack([group.column(c).to_numpy() for c in ("bucket", "lo", "hi")])
        first = np.flatnonzero(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(0)]))
        sizes = np.diff(np.append(first, n))
        cells = group.column("cells").combine_chunks()
        many = cells.value_lengths().to_numpy()
        keys = np.full((n, many.max()), _NONE, np.int64)
        keys[np.arange(keys.shape[1]) < many[:, None]] = cells.flatten().to_numpy()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def fit(i: np.ndarray, j: np.ndarray, cos: np.ndarray, known: bool = False) -> None:
            keep = (cos >= least) & (ids[i] != ids[j]) & (label[i] == label[j]) & (~cross[i] | (chunk[i] != chunk[j]))
            i, j = i[keep], j[keep]
            own = slice(None) if known else _first_shared(keys, bucket, i, j)
            left.append(i[own])
            right.append(j[own])

        for _, (rows, x) in vectors_of(group.column("embedding").combine_chunks())[1].items():
            some, unit = units(x)
            place = np.full(n, -1)
            place[rows[some]] = np.arange(len(some))
            of = np.repeat(np.arange(len(sizes)), sizes)
            few = sizes[of] <= 16
            for d in range(1, int(min(16, sizes.max()))):
                i = np.flatnonzero((of[:-d] == of[d:]) & few[:-d])
                i = i[(place[i] >= 0) & (place[i + d] >= 0)]
                for k in range(0, len(i), 1 << 15):
                    part = i[k : k + (1 << 15)]
                    fit(part, part + d, (unit[place[part]] * unit[place[part + d]]).sum(1))
            for g in np.flatnonzero(sizes > 16):
                own = np.arange(first[g], first[g] + sizes[g])
                own = own[place[own] >= 0]
                cos = unit[place[own]] @ unit[place[own]].T
                near = np.triu(cos >= least - 1e-9, 1)
                if near.any():
                    i, j = np.nonzero(near & ~_share_smaller(keys[own], bucket[first[g]]))
                    fit(own[i], own[j], (unit[place[own[i]]] * unit[place[own[j]]]).sum(1), known=True)
        found.add(ids, d1, size, np.concatenate(left), np.concatenate(right))

    def run(batches):
        found, rest = _Links(), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None and rest.num_rows:
                table = pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            marks = [table.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
            open_ = (marks[0] == marks[0][-1]) & (marks[1] == marks[1][-1]) & (marks[2] == marks[2][-1])
            cut = int(np.argmax(open_))
            if cut:
                links(table.slice(0, cut).combine_chunks(), found)
            rest = table.slice(cut)
            if found.size > 1 << 19:
                yield found.flush()
        if rest is not None and rest.num_rows:
            links(rest.combine_chunks(), found)
        yield found.flush()

    return run


def _classes(digests: DataFrame) -> tuple[DataFrame, list[str]]:
    """(label, d1, d2, rep, size): equal vectors, the smallest vec_id standing for them, and the columns by which a row
    finds its class. Vectors of an id that has several are classes of their own, told apart by the id."""
    there = digests.where("d1 is not null").distinct()
    odd = there.groupBy("vec_id").count().where("count > 1").select("vec_id", F.col("vec_id").alias("own"))
    key = ["label", "d1", "d2"]
    if odd.isEmpty():
        return there.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), key
    key = [*key, "own"]
    return there.join(odd, "vec_id", "left").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), key


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    vectors = pick(vectors, "vec_id", "embedding", "label")
    kind = dict(vectors.dtypes)["embedding"]
    whole = dict(vectors.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    vectors = vectors.select(
        F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<float>" if kind == "array<float>" else "array<double>")
    )
    digests, _ = stored(vectors.mapInArrow(_digests, "vec_id long, label long, d1 long, d2 long"), "digests")
    classes, key = _classes(digests)
    classes, _ = stored(classes, "classes")

    # The classes' vectors: rows of the id that stands for them, once each.
    reps = classes.select(F.col("rep").alias("vec_id"), "label", "d1", "size")
    points = vectors.join(reps.select("vec_id").distinct(), "vec_id", "left_semi").where("label is not null")
    if digests.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").isEmpty():
        points = points.join(reps.drop("label"), "vec_id")
    else:
        digest = vectors.schema["embedding"].dataType.simpleString()
        points = points.mapInArrow(_with_digests, f"vec_id long, label long, embedding {digest}, d1 long").join(reps, ["vec_id", "label", "d1"]).dropDuplicates(["vec_id", "label", "d1"])
    points, points_at = stored(points.select("vec_id", "label", "d1", "size", "embedding"), "points")

    cells = points.select("vec_id", "d1", "label", "embedding").mapInArrow(_buckets, "bucket long, vec_id long, d1 long, home boolean")
    cells, cells_at = stored(cells, "cells")
    shared = cells.groupBy("bucket").agg(F.count("*").alias("n"), F.max("home").alias("home")).where("n > 1 and home").select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    member = cells.join(shared, "bucket").groupBy("vec_id", "d1").agg(F.collect_set(F.struct("bucket", "chunks")).alias("own"))  # TABLES * (PROBES + 1) entries at most
    full = points.join(member, ["vec_id", "d1"]).withColumn("cells", F.transform("own", lambda c: c["bucket"])).withColumn("one", F.explode("own")).drop("own")
    full = full.withColumn("bucket", F.col("one.bucket")).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "d1", "bucket"), F.col("one.chunks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("one.chunks") - 1))).withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    full = full.select("bucket", "lo", "hi", "chunk", "vec_id", "d1", "label", "size", "cells", "embedding").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    links, _ = stored(full.mapInArrow(_compare(least), "vec_id long, d1 long, root long, links long"), "links")

    for path in (points_at, cells_at):
        drop_path(vectors.sparkSession, path)

    count = links.groupBy(F.col("vec_id").alias("rep"), "d1").agg(F.sum("links").alias("links"))
    found = components(links, "vec_id", "root").withColumnRenamed("id", "rep")
    whole = classes.join(count, ["rep", "d1"], "left").join(found, "rep", "left").select(*key, (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    if "own" in key:
        odd = classes.where("own is not null").select(F.col("own").alias("vec_id"), "own").distinct()
        digests = digests.join(odd, "vec_id", "left").withColumnRenamed("own", "o")
        out = digests.join(whole, [digests[c] == whole[c] for c in key[:3]] + [digests["o"].eqNullSafe(whole["own"])], "left").select("vec_id", "n_links", "component")
    else:
        out = digests.join(whole, key, "left")
    ident = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), ident.alias("component_id"), F.coalesce(ident == F.col("vec_id"), F.lit(False)).alias("kept"))


def _with_digests(batches):
    for batch in batches:
        (one,) = _digests([batch])
        yield pa.record_batch([*[batch.column(c) for c in ("vec_id", "label", "embedding")], one.column("d1")], names=["vec_id", "label", "embedding", "d1"])
